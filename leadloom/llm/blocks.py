"""Texts as blocks of numbered words, and counts that blocks ask the corpus for.

A block is a run of texts of one task, of about ``tokens`` words: its own dictionary and the numbers of its words, written
once. What a block needs to know of the corpus is how often each of its distinct n-grams occurs in all blocks. It asks for that by a hash of
each, with its own count: hashes are dealt by their value into ranges, a range adds up what all blocks have, and each block gets back the sums in
the order in which it asked, so that an answer is a few bits. An n-gram is asked for at most once a block, however often it occurs, so no
range has a hot key; nothing is broadcast or sent to the driver. Blocks and ranges bound the memory of a task.

Single words are told apart by 88 bits, longer n-grams by 56.
"""

from __future__ import annotations

import hashlib
import itertools
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parallelism

#: Words of a block, and how many ranges of hashes there are for each shuffle partition.
BLOCK_TOKENS, RANGES = 1 << 20, 2
#: Bits of a hash.
BITS = 56
_STEP = np.uint64(0x9E3779B97F4A7C15)


def pack(xs: np.ndarray) -> bytes:
    """Whole numbers, each byte plane compressed by itself, so that what small numbers leave empty takes next to nothing."""
    if not len(xs):
        return b""
    planes = [pa.compress(p.tobytes(), codec="zstd", asbytes=True) for p in np.ascontiguousarray(xs).view(np.uint8).reshape(len(xs), xs.dtype.itemsize).T]
    return np.array([len(p) for p in planes], np.uint32).tobytes() + b"".join(planes)


def unpack(data: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    out = np.zeros((n, size), np.uint8)
    if n:
        ends = 4 * size + np.append(0, np.cumsum(np.frombuffer(data, np.uint32, size).astype(np.int64)))
        for i in range(size):
            out[:, i] = np.frombuffer(pa.decompress(data[ends[i] : ends[i + 1]], decompressed_size=n, codec="zstd"), np.uint8)
    return out.view(kind).ravel()


class Dictionary:
    """Numbers of words, by kind (a language, say), in the order of their first use."""

    def __init__(self, first: tuple[bytes, ...] = ()):
        self.kinds: dict[bytes, dict[bytes, int]] = {}
        self.count = itertools.count()
        self.first = first
        for word in first:
            self.of(b"")[word]

    def of(self, kind: bytes) -> dict[bytes, int]:
        if kind not in self.kinds:
            numbers = self.kinds[kind] = _Numbers()
            numbers.count = self.count
        return self.kinds[kind]

    def entries(self) -> list[tuple[bytes, bytes]]:
        """(kind, word) by number."""
        found = sorted((i, kind, word) for kind, numbers in self.kinds.items() for word, i in numbers.items())
        return [(kind, word) for _, kind, word in found]


class _Numbers(dict):
    count: Iterator[int]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = next(self.count)
        return n


_BLOCK = (("block", pa.int64()), ("words", pa.binary()), ("words_bytes", pa.int64()), ("n_words", pa.int64()), ("ids", pa.binary()), ("n_ids", pa.int64()), ("ends", pa.binary()), ("n_ends", pa.int64()))
#: A function from a text's other columns and its bytes to (kind, lists of words): each list is a sequence, in which n-grams lie.
Reader = Callable[[tuple, bytes], tuple[bytes, Iterator[list[bytes]]]]


def write_blocks(docs: DataFrame, text: str, keep: tuple[str, ...], reader: Reader, first: tuple[bytes, ...] = (), around: tuple[int, ...] = (), tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of texts (null: empty): block, ``keep`` (lists, a value a text), its dictionary (words, with the kind before each), ids (the words' numbers) and ends (where
    each sequence ends), packed, with their sizes. ``around``: numbers of words of ``first`` that every sequence begins and ends with. Words hold no line feed."""
    src = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("__text"))
    types = [src.schema[c].dataType for c in keep]
    kinds = ", ".join(f"`{c}` array<{t.simpleString()}>" for c, t in zip(keep, types, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number = TaskContext.get().partitionId() << 32, 0
        words, ids, ends, kept = Dictionary(first), array("I"), array("Q"), [[] for _ in keep]

        def block() -> pa.RecordBatch:
            entries = words.entries()
            lists = [pa.ListArray.from_arrays(pa.array([0, sum(map(len, x))], pa.int32()), pa.concat_arrays(x)) for x in kept]
            text = b"\n".join(x for pair in entries for x in pair)
            packed = pa.compress(text, codec="zstd", asbytes=True)
            values = (base + number, packed, len(text), len(entries), pack(np.frombuffer(ids, np.uint32)), len(ids), pack(np.frombuffer(ends, np.uint64)), len(ends))
            names, sorts = tuple(zip(*_BLOCK, strict=True))
            return pa.RecordBatch.from_arrays([*lists, *(pa.array([v], t) for v, t in zip(values, sorts, strict=True))], names=[*keep, *names])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[: len(keep)]]
            since = 0
            for at, data in enumerate(batch.columns[-1]):
                kind, sequences = reader(tuple(c[at] for c in columns), data.as_py())
                get = words.of(kind).__getitem__
                for sequence in sequences:
                    if around:
                        ids.append(around[0])
                    ids.extend(map(get, sequence))
                    if around:
                        ids.append(around[1])
                    ends.append(len(ids))
                if len(ids) >= tokens:
                    for x, c in zip(kept, batch.columns, strict=False):
                        x.append(c.slice(since, at + 1 - since))
                    since = at + 1
                    yield block()
                    words, ids, ends, kept, number = Dictionary(first), array("I"), array("Q"), [[] for _ in keep], number + 1
            for x, c in zip(kept, batch.columns, strict=False):
                if since < len(c):
                    x.append(c.slice(since))
        if ends or any(kept):
            yield block()

    schema = "block long, words binary, words_bytes long, n_words long, ids binary, n_ids long, ends binary, n_ends long"
    return src.mapInArrow(run, f"{kinds + ', ' * bool(kinds)}{schema}")


class Block:
    """A block read again. n-grams are numbered by order: ``grams[k - 1][i]`` is the number of the one of k words that ends at place i (-1: it would begin
    before its sequence)."""

    def __init__(self, row: dict, order: int):
        n = row["n_words"]
        entries = pa.decompress(row["words"], decompressed_size=row["words_bytes"], codec="zstd", asbytes=True).split(b"\n") if n else []
        self.kinds, self.words = entries[::2], entries[1::2]
        self.ids = unpack(row["ids"], row["n_ids"], np.uint32).view(np.int32)
        self.ends = unpack(row["ends"], row["n_ends"], np.uint64).astype(np.int64)
        self.starts = np.append(0, self.ends[:-1]) if len(self.ends) else self.ends
        self.place = np.arange(len(self.ids), dtype=np.int32) - np.repeat(self.starts, self.ends - self.starts).astype(np.int32)
        self.digests = np.frombuffer(b"".join(hashlib.blake2b(k + b"\n" + w, digest_size=16).digest() for k, w in zip(self.kinds, self.words, strict=True)), np.uint64).reshape(n, 2)
        #: By order: hash, number of the first n - 1 words, place of one occurrence.
        mixed, self.more = self.digests[:, 0], self.digests[:, 1].astype(np.uint32)
        self.grams, self.hashes, self.heads, self.found_at = [self.ids], [mixed >> np.uint64(64 - BITS)], [None], [None]
        for k in range(2, order + 1):
            ends = np.flatnonzero(self.place >= k - 1)
            before = self.grams[-1]
            codes, at, inverse = np.unique(before[ends - 1].astype(np.int64) * n + self.ids[ends], return_index=True, return_inverse=True)
            numbers = np.full(len(self.ids), -1, np.int32)
            numbers[ends] = inverse
            heads = codes // max(n, 1)
            mixed = _mix(mixed[heads] * _STEP + self.digests[codes % max(n, 1), 0])
            self.grams.append(numbers)
            self.hashes.append(mixed >> np.uint64(64 - BITS))
            self.heads.append(heads.astype(np.int32))
            self.found_at.append(ends[at].astype(np.int32))

    def counts(self, order: int, where: np.ndarray | None = None) -> np.ndarray:
        """How often each n-gram of that order ends in the block, at the places in ``where`` only."""
        numbers = self.grams[order - 1]
        there = numbers >= 0 if where is None else (numbers >= 0) & where
        return np.bincount(numbers[there], minlength=len(self.hashes[order - 1]))

    def dealt(self, order: int, ranges: int, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The n-grams (the chosen ones) in the order of their hashes, in which the block asks for them, the ranges that these fall into, and where each range begins."""
        chosen = np.arange(len(self.hashes[order - 1])) if chosen is None else chosen
        hashes = self.hashes[order - 1][chosen]
        by_hash = np.lexsort((self.more[chosen], hashes)) if order == 1 else np.argsort(hashes, kind="stable")
        of = ((hashes[by_hash] >> np.uint64(BITS - 32)) * np.uint64(ranges)) >> np.uint64(32)
        there, begin = np.unique(of, return_index=True)
        return chosen[by_hash], there, np.append(begin, len(of))

    def asks(self, number: int, order: int, ranges: int, counts: np.ndarray, chosen: np.ndarray | None = None) -> pa.RecordBatch:
        """What the block of that number asks about n-grams: a row a range."""
        by_hash, there, begin = self.dealt(order, ranges, chosen)
        rows = []
        for r, lo, hi in zip(there.tolist(), begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            keys = self.hashes[order - 1][by_hash[lo:hi]]
            more = pack(self.more[by_hash[lo:hi]]) if order == 1 else b""
            rows.append((order, r, number, hi - lo, pack(np.diff(keys, prepend=np.uint64(0))), more, pack(counts[by_hash[lo:hi]].astype(np.uint32))))
        return _batch(rows, _ASKED)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def corpus_counts(blocks: DataFrame, orders: int, where: Callable[[Block, dict], np.ndarray] | None = None, answer: Callable[[np.ndarray, int], np.ndarray] | None = None) -> DataFrame:
    """Answers to the blocks about n-grams of up to ``orders`` words: block, gram_order, range_id, n, counts (packed sums, in the order of ``Block.dealt``), and, in the row of the
    range's first block only (else 0), occurring (how many of the range's n-grams are counted at all) and occurrences (the sum of their counts). ``where``: the
    places that count, for each block; ``answer``: what of the sums the blocks get."""
    ranges = RANGES * parallelism(blocks.sparkSession)
    columns = [c for c in blocks.columns if where is not None or c in dict(_BLOCK)]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            for at in range(len(batch)):
                row = batch.slice(at, 1).to_pylist()[0]
                block = None  # one at a time in memory
                block = Block(row, orders)
                places = where(block, row) if where else None
                for order in range(1, orders + 1):
                    yield block.asks(row["block"], order, ranges, block.counts(order, places))

    return _added_up(blocks.select(*columns).mapInArrow(ask, _schema(_ASKED)), answer)


def more_counts(blocks: DataFrame, answers: DataFrame, order: int, chosen: Callable[[Block, list[dict]], np.ndarray], answer: Callable[[np.ndarray, int], np.ndarray] | None = None) -> DataFrame:
    """Answers, as ``corpus_counts`` gives them, about those n-grams of ``order`` words that are chosen (by number) for each block from the answers that it has."""
    ranges = RANGES * parallelism(blocks.sparkSession)

    def ask(_: pa.Table, row: dict, rows: list[dict]) -> pa.Table:
        block = Block(row, order)
        return pa.Table.from_batches([block.asks(row["block"], order, ranges, block.counts(order), chosen(block, rows))])

    return _added_up(with_answers(blocks, answers, ask, _schema(_ASKED)), answer)


def _added_up(asked: DataFrame, answer: Callable[[np.ndarray, int], np.ndarray] | None) -> DataFrame:
    def add_up(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        order, r = rows[0]["gram_order"], rows[0]["range_id"]
        keys = np.concatenate([np.cumsum(unpack(x["hashes"], x["n"], np.uint64), dtype=np.uint64) for x in rows])
        more = np.concatenate([unpack(x["more"], x["n"], np.uint32) for x in rows]) if order == 1 else np.zeros(0, np.uint32)
        counts = np.concatenate([unpack(x["counts"], x["n"], np.uint32) for x in rows])
        by_key = np.lexsort((more, keys)) if order == 1 else np.argsort(keys, kind="stable")
        new = np.append(False, keys[by_key][1:] != keys[by_key][:-1])
        if order == 1:
            new[1:] |= more[by_key][1:] != more[by_key][:-1]
        inverse = np.empty(len(keys), np.int64)
        inverse[by_key] = np.cumsum(new)
        sums = np.bincount(inverse, weights=counts).astype(np.uint64)  # exact below 2 ** 53
        given = (answer(sums, order) if answer else sums)[inverse]
        out, at = [], 0
        for x in rows:
            out.append((order, r, x["block"], x["n"], pack(given[at : at + x["n"]]), *((int(np.count_nonzero(sums)), int(sums.sum())) if not at else (0, 0))))
            at += x["n"]
        return pa.Table.from_batches([_batch(out, _ANSWERED)])

    return asked.groupBy("gram_order", "range_id").applyInArrow(add_up, _schema(_ANSWERED))


_ASKED = pa.schema([("gram_order", pa.int32()), ("range_id", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("hashes", pa.binary()), ("more", pa.binary()), ("counts", pa.binary())])
_ANSWERED = pa.schema([("gram_order", pa.int32()), ("range_id", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("counts", pa.binary()), ("occurring", pa.int64()), ("occurrences", pa.int64())])


def _schema(schema: pa.Schema) -> str:
    names = {"int32": "int", "int64": "long"}
    return ", ".join(f"{f.name} {names.get(str(f.type), str(f.type))}" for f in schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def answers_of(block: Block, rows: list[dict], order: int, kind: type = np.uint64, chosen: np.ndarray | None = None) -> np.ndarray:
    """The sums of one order, by the number of the n-gram (0: not asked for), from the block's answers."""
    mine = sorted((r for r in rows if r["gram_order"] == order), key=lambda r: r["range_id"])
    numbered = np.zeros(len(block.hashes[order - 1]), kind)
    if mine:
        numbered[block.dealt(order, 1, chosen)[0]] = np.concatenate([unpack(r["counts"], r["n"], kind) for r in mine])
    return numbered


def with_answers(blocks: DataFrame, answers: DataFrame, use: Callable[[pa.Table, dict, list[dict]], pa.Table], schema: str) -> DataFrame:
    """``use`` of each block, as a table of one row and as that row, and its answers. Blocks that are written in buckets by block (``stash_bucketed``) stay where they are."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return use(left, left.to_pylist()[0], right.to_pylist())

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)
