"""Operator 8: byte-level BPE encoding and decoding by a lazily determinised finite-state transducer.

A rank file lists tokens (byte strings) by merge priority. A sequence of tokens is the BPE encoding of its
bytes exactly if each adjacent pair, encoded alone, comes back as that pair. So every prefix of a piece of
text has one last token, found from the boundaries from which a token may still grow. The transducer's state is the list of
these open boundaries: the bytes read since each, the token that ends there, and the tokens that lead to it and aren't emitted yet. A
transition reads one byte and emits the tokens that lead to all open boundaries alike. It is made when it is first wanted and kept in a table of
bounded size (a full table is emptied, as lazy automata do); the lookahead is
bounded by the longest token, as no boundary stays open longer. At a piece's end its state has what is left to emit.

Decoding feeds tokens to a UTF-8 state machine, which hands on whole characters and carries the bytes of an open one to the next token.
Bytes that aren't UTF-8 are handed on as they are, and reported.

Rows: a null text is the empty text (no ids); an empty text has no ids; repeated rows each get their result;
a text of any length is cut, only between certain pieces, into parts of about 1M characters. Extra columns of
the input are not read; ``keep`` names those to hand through.
"""

from __future__ import annotations

import base64
import gc
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bound_batches, lean, worker_cache

#: States kept in the transducer and pieces kept in the piece table before they are emptied.
MAX_STATES = 100_000
MAX_PIECES = 250_000
#: Pieces longer than this are not kept in the piece table.
LONG_PIECE = 64
#: Characters of text that are cut into pieces at once.
PART_CHARS = 1 << 20
#: Bytes of a batch. Text, ids and decoded bytes of a batch are held at once, by the worker beside its tables and by the JVM, so batches are small.
BATCH_BYTES = 512 << 10

_CUT = regex.compile(r"(?<=\S)(?=\s)")
_WIDE = re.compile("[\u0250-\U0010ffff]")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


def _ranges(chars: list[int]) -> str:
    out, i = [], 0
    while i < len(chars):
        j = i
        while j + 1 < len(chars) and chars[j + 1] == chars[j] + 1:
            j += 1
        out.append(f"\\u{chars[i]:04x}-\\u{chars[j]:04x}")
        i = j + 1
    return "".join(out)


def narrow_pattern(pattern: str) -> re.Pattern | None:
    r"""The pattern for texts below U+0250, with \p{L}, \p{N} and \s spelled out as ranges: the standard matcher is faster than the general one."""
    ranges = {
        r"\p{L}": _ranges([c for c in range(0x250) if unicodedata.category(chr(c))[0] == "L"]),
        r"\p{N}": _ranges([c for c in range(0x250) if unicodedata.category(chr(c))[0] == "N"]),
        r"\s": _ranges([c for c in range(0x250) if regex.match(r"\s", chr(c))]),
    }
    out, at, inside = "", 0, False
    for m in re.finditer(r"\\[pP]\{.*?\}|\\.|[\[\]]", pattern):
        out += pattern[at : m.start()]
        at, x = m.end(), m[0]
        inside = x == "[" or inside and x != "]"
        if x in ranges:
            x = ranges[x] if inside else f"[{ranges[x]}]"
        elif x == r"\S" and not inside:
            x = rf"[^{ranges[r'\s']}]"
        elif re.match(r"\\[a-zA-Z]", x):
            return None
        out += x
    return re.compile(out + pattern[at:])


class MergeTransducer:
    """Bytes of one piece in, token ids out."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.size = max(map(len, ranks))
        self.vocab: dict[int, bytes] = {r: t for t, r in ranks.items()}
        self.grows = {t[:i] for t in ranks for i in range(1, len(t))}  # what begins a longer token
        self.never = len(self.vocab) + max(self.vocab)
        self._spines: dict[tuple[int, bool], list[tuple[bytes, int]] | None] = {}
        self._pairs: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.states: dict[tuple, int] = {}  # open boundaries -> state
        self.open: list[tuple] = []  # state -> open boundaries (bytes since, token there, tokens that lead to it)
        self.final: list[tuple[int, ...] | None] = []  # state -> what is left to emit if the piece ends
        self.next: dict[int, int] = {}  # state and byte -> state and number of what is emitted
        self.emissions: list[tuple[int, ...]] = [()]
        self.emission_numbers: dict[tuple[int, ...], int] = {(): 0}
        self.start = self._state(((b"", -1, ()),), ())

    def _state(self, boundaries: tuple, final: tuple[int, ...] | None) -> int:
        number = self.states.get(boundaries)
        if number is None:
            number = self.states[boundaries] = len(self.open)
            self.open.append(boundaries)
            self.final.append(final)
        return number

    def merge(self, data: bytes, whole: bool = True) -> list[bytes]:
        """The encoding by its definition: merge the adjacent pair of lowest rank, the leftmost of equals, until none is left
        (or, if not ``whole``, two parts are left)."""
        parts = [data[i : i + 1] for i in range(len(data))]
        none = sys.maxsize
        while len(parts) > (1 if whole else 2):
            scores = [self.ranks.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
            low = min(scores)
            if low == none:
                break
            i = scores.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _spine(self, token: int, right: bool) -> list[tuple[bytes, int]] | None:
        """The parts that stand at a token's right (or left) end while it is merged, each with the rank of the merge that
        ends it, from the whole token down to a byte. None if a part has a higher rank than its whole."""
        key = (token, right)
        if key not in self._spines:
            out, part, ends = [], self.vocab[token], self.never
            while out is not None:
                out.append((part, ends))
                if len(part) == 1:
                    break
                ends = self.ranks[part]
                halves = self.merge(part, whole=False)
                if len(halves) != 2 or any(len(x) > 1 and self.ranks[x] >= ends for x in halves):
                    out = None
                else:
                    part = halves[1 if right else 0]
            self._spines[key] = out
        return self._spines[key]

    def follows(self, a: int, b: int) -> bool:
        """Whether token b may stand right after token a (-1: the beginning): no merge across them comes before those that make them."""
        key = (a + 1) << 24 | b
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > 8 * self.max_states:
                self._pairs.clear()
            if a < 0:
                known = len(self.merge(self.vocab[b])) == 1
            elif (left := self._spine(a, True)) is None or (right := self._spine(b, False)) is None:
                known = self.merge(self.vocab[a] + self.vocab[b]) == [self.vocab[a], self.vocab[b]]
            else:
                get, never, known = self.ranks.get, self.never, True
                for p, p_ends in left:
                    for q, q_ends in right:
                        r = get(p + q, never)
                        if r < p_ends and r <= q_ends:
                            known = False
            self._pairs[key] = known
        return known

    def _step(self, state: int, byte: int) -> int:
        """Makes a transition: its target and, from bit 32 on, the number of what it emits."""
        read = bytes((byte,))
        ranks, grows = self.ranks, self.grows
        boundaries, here = [], None
        for since, token, lead in self.open[state]:
            since += read
            if here is None and (t := ranks.get(since)) is not None and self.follows(token, t):
                here = (b"", t, (*lead, t))
            if since in grows:
                boundaries.append((since, token, lead))
        if here is not None:  # there is one wherever the ranks are those of merges
            boundaries.append(here)
        final, n, number = here[2] if here is not None else None, 0, 0
        if boundaries and boundaries[0][2]:  # else one is open from which nothing leads on
            leads = [x[2] for x in boundaries]
            first, shortest = leads[0], min(map(len, leads))
            while n < shortest and all(x[n] == first[n] for x in leads):
                n += 1
        if n:
            number = self.emission_numbers.setdefault(first[:n], len(self.emissions))
            if number == len(self.emissions):
                self.emissions.append(first[:n])
            boundaries = [(since, token, lead[n:]) for since, token, lead in boundaries]
            final = final and final[n:]
        made = self.next[state << 8 | byte] = number << 32 | self._state(tuple(boundaries), final)
        return made

    def encode(self, data: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        if len(self.open) > self.max_states:
            self._reset()
        state, out, get = self.start, [], self.next.get
        for i, byte in enumerate(data):
            made = get(state << 8 | byte)
            if made is None:
                if len(self.open) > 2 * self.max_states:  # a very long piece: forget all states but this one
                    boundaries, final = self.open[state], self.final[state]
                    self._reset()
                    get, state = self.next.get, self._state(boundaries, final)
                made = self._step(state, byte)
            if made >> 32:
                out += self.emissions[made >> 32]
            state = made & 0xFFFFFFFF
        if self.final[state] is None:  # ranks that aren't those of merges: the encoding by its definition
            return tuple(self.ranks[x] for x in self.merge(data))
        out += self.final[state]
        return tuple(out)


class Pieces(dict):
    """Piece of text -> ids (as 32-bit numbers), filled by the transducer when a piece is first met."""

    def __init__(self, transducer: MergeTransducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, piece: str) -> bytes:
        ids = array("i", self.transducer.encode(piece.encode())).tobytes()
        if len(piece) <= LONG_PIECE and len(self) < MAX_PIECES:
            self[piece] = ids
        return ids


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pieces = Pieces(MergeTransducer(ranks))
        self.wide, self.narrow = regex.compile(pattern), narrow_pattern(pattern)

    def parts(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > PART_CHARS:
            cut = _CUT.search(text, at + PART_CHARS)
            if not cut:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def encode(self, text: str) -> np.ndarray:
        found = []
        for part in self.parts(text):
            matcher = self.wide if self.narrow is None or _WIDE.search(part) else self.narrow
            found += map(self.pieces.__getitem__, matcher.findall(part))
        return np.frombuffer(b"".join(found), np.int32)


def _is_whole(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


def _utf8_table() -> list[list[int]]:
    """state x byte -> state. 0: between characters; 1-3: so many continuation bytes are due; 4-7: after E0, ED, F0, F4; 8: not UTF-8."""
    table = [[8] * 256 for _ in range(9)]
    table[0][:0x80] = [0] * 0x80
    table[0][0xC2:0xE0] = [1] * 30
    table[0][0xE0:0xF0] = [4] + [2] * 12 + [5] + [2] * 2
    table[0][0xF0:0xF5] = [6, 3, 3, 3, 7]
    for state, low, high, to in ((1, 0x80, 0xC0, 0), (2, 0x80, 0xC0, 1), (3, 0x80, 0xC0, 2), (4, 0xA0, 0xC0, 1), (5, 0x80, 0xA0, 1), (6, 0x90, 0xC0, 2), (7, 0x80, 0x90, 2)):
        table[state][low:high] = [to] * (high - low)
    return table


_UTF8 = _utf8_table()


class Utf8Stream:
    """Bytes in by pieces, whole characters out; the bytes of an open character wait for the next piece."""

    def __init__(self) -> None:
        self.state, self.open, self.whole = 0, b"", True

    def feed(self, data: bytes) -> bytes:
        data = self.open + data
        state, end = self.state, 0
        for i in range(len(self.open), len(data)):
            state = _UTF8[state][data[i]]
            if state == 8:  # the open bytes are handed on as they are; the last one may begin a character
                self.whole = False
                state = _UTF8[0][data[i]]
                end = i
                if state == 8:
                    state = 0
            if state == 0:
                end = i + 1
        self.state, self.open = state, data[end:]
        return data[:end]

    def finish(self) -> bytes:
        """What is left: the bytes of a character that was never closed."""
        left, self.whole = self.open, self.whole and not self.open
        self.state, self.open = 0, b""
        return left


class Decoder:
    """Ids in, bytes out, through a UTF-8 stream. What a token does between characters is known beforehand, so that runs of tokens that
    begin and end there are handed on together."""

    def __init__(self, ranks: dict[bytes, int]):
        self.vocab = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.vocab[r] = t
        self.closed = np.array([_is_whole(t) for t in self.vocab])

    def stream(self, ids: Iterable[int], utf8: Utf8Stream) -> Iterator[bytes]:
        """The bytes of ids as they become whole characters."""
        for i in ids:
            yield utf8.feed(self.vocab[i])
        yield utf8.finish()

    def decode(self, ids: np.ndarray) -> tuple[bytes, bool]:
        """The bytes, and whether they are whole UTF-8 characters."""
        utf8, out, done = Utf8Stream(), [], 0
        vocab, tokens = self.vocab, ids.tolist()
        for i in np.flatnonzero(~self.closed[ids]).tolist() if len(ids) else ():
            if i < done:
                continue
            out += map(vocab.__getitem__, tokens[done:i])
            out.append(utf8.feed(vocab[tokens[i]]))
            done = i + 1
            while utf8.open and done < len(tokens):
                out.append(utf8.feed(vocab[tokens[done]]))
                done += 1
        out += map(vocab.__getitem__, tokens[done:])
        out.append(utf8.finish())
        return b"".join(out), utf8.whole


def _once(kind: type, path: str, *more: str):
    """One encoder or decoder per worker process and vocabulary, until the worker takes a task of another operator."""
    key, ready = (kind, path, *more), worker_cache("byte_bpe")
    if key not in ready:
        ready[key] = kind(load_ranks(path), *more)
        gc.freeze()  # it stays for long, and what it will hold has no cycles: collections needn't go through that again and again
        gc.set_threshold(100_000, 20)
    return ready[key]


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(found) + 1, np.int32)
    np.cumsum([len(x) for x in found], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32), pa.int32()))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """``keep`` and the column ``ids`` (array of int): the text's ids by the rank file at ``path`` (a path on every executor), without special tokens."""
    bound_batches(df.sparkSession, BATCH_BYTES)
    src = df.select(*keep, df[text].cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _once(Encoder, path, pattern)
        for batch in batches:
            found = [encoder.encode(x or "") for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], _lists(found)], names=[*keep, ids])

    schema = T.StructType([src.schema[c] for c in keep] + [T.StructField(ids, T.ArrayType(T.IntegerType()))])
    return src.mapInArrow(lean("byte_bpe", run), schema)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """encode() and decode() of its ids in one pass through Python: ``keep``, ids, decoded, whole_utf8. A task then needs one worker, not two."""
    bound_batches(df.sparkSession, BATCH_BYTES)
    src = df.select(*keep, df[text].cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _once(Encoder, path, pattern), _once(Decoder, path)
        for batch in batches:
            found = [encoder.encode(x or "") for x in batch.column(len(keep)).to_pylist()]
            out = [decoder.decode(ids) for ids in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], _lists(found), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.bool_())], names=[*keep, "ids", "decoded", "whole_utf8"])

    schema = T.StructType([src.schema[c] for c in keep] + [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType()), T.StructField("whole_utf8", T.BooleanType())])
    return src.mapInArrow(lean("byte_bpe", run), schema)


def decode(df: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), decoded: str = "decoded", whole: str = "whole_utf8") -> DataFrame:
    """``keep``, the ids, ``decoded`` (binary: the tokens' bytes) and ``whole`` (whether these are whole UTF-8 characters). Null ids: empty."""
    bound_batches(df.sparkSession, BATCH_BYTES)
    src = df.select(*keep, df[ids].cast("array<int>").alias(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _once(Decoder, path)
        for batch in batches:
            lists = batch.column(len(keep))
            flat = np.asarray(lists.values, np.int32) if len(lists) else np.zeros(0, np.int32)
            at = lists.offsets.to_pylist()
            there = lists.is_valid().to_pylist()
            out = [decoder.decode(flat[a:b] if t else flat[:0]) for a, b, t in zip(at, at[1:], there, strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.bool_())], names=[*keep, ids, decoded, whole])

    schema = T.StructType([src.schema[c] for c in keep] + [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.BinaryType()), T.StructField(whole, T.BooleanType())])
    return src.mapInArrow(lean("byte_bpe", run), schema)
