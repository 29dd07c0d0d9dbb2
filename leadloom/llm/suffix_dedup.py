"""Operator 7: removal of long repeated byte strings by suffix arrays of shards.

A byte is removed if a string of ``length`` bytes that covers it starts anywhere else, in the same text or another. Shards
are made by content: in each window of ``length`` bytes the smallest hash of its ``gram``-byte strings is the window's anchor, so equal
windows have equal anchors. A run of windows with one anchor is a region. Regions whose anchor
occurs once hold nothing repeated and go no further. Nor do those that share none of a few longer strings around the anchor with another region: two regions that
share a window share one of these. Identical regions of an anchor (equal 64-bit digests under equal 64-bit anchors) are repeated as a whole and are
represented by one. The regions that are left are packed, anchor by anchor, into shards of about ``shard_bytes``; in a shard a suffix array (induced
sorting) and permuted common prefixes give every class of equal windows, and a window is repeated if its
class has more than one occurrence.

A hot anchor, one with more than ``max_regions`` different regions, is dealt over several shards, each with a suffix array of its own; these also give one window of each class,
and classes of different shards are matched by 128-bit digests. Nothing is capped.

Of equal texts (equal digests) one is compressed, shuffled once, and kept in buckets by digest, where later joins leave it; the copies are repeated as a whole.

Rows: a null text is empty; texts shorter than ``length`` are kept whole; equal texts of that length or more lose everything, also if ids are
equal or null; very long texts are hashed in pieces of 128 KB. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, new_path, parallelism, stash
from .suffix_array import permuted_prefixes, suffix_array

LENGTH, GRAM, SHARD_BYTES, MAX_REGIONS, PIECE = 400, 100, 512 << 10, 4096, 1 << 17
#: Strings around an anchor by which its regions are told apart before they are sorted; keys of texts that a task remembers.
PARTS, SEEN = 3, 100_000
#: Bytes of texts in a bucket, and how many buckets there are at most.
BUCKET_BYTES, MAX_BUCKETS = 64 << 20, 100_000
_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _powers:
        up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[n] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers[n]


def _slide(h: np.ndarray, w: int, best, fill) -> np.ndarray:
    """best over each window of w items, by running bests of blocks from both ends."""
    n = len(h) - w + 1
    padded = np.append(h, np.full(-len(h) % w, fill, h.dtype)).reshape(-1, w)
    forth = best.accumulate(padded, 1).ravel()
    back = best.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return best(back[:n], forth[w - 1 : w - 1 + n])


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: the anchor's place and hash, and the starts of the run's first and last window. A window's anchor is its
    gram-byte string with the smallest hash, the leftmost of equals."""
    return regions_of(data, length, gram)[:4]


def regions_of(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``anchors``, and PARTS hashes of strings around each anchor (a row each; 0 where the region has no such window). A window that two regions of one
    anchor share begins left of it by a number of bytes that is in one of PARTS ranges; string j is what all windows of range j have in common."""
    up, down = _tables(PIECE + length)
    found = []
    w = length - gram + 1
    cuts = [w * j // PARTS for j in range(PARTS + 1)]
    low_bits = np.uint64((1 << 18) - 1)

    def mixed(h: np.ndarray) -> np.ndarray:
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return h

    for at in range(0, len(data) - length + 1, PIECE):
        piece = np.frombuffer(data, np.uint8, min(PIECE + length - 1, len(data) - at), at).astype(np.uint64)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece + np.uint64(1)) * up[: len(piece)], out=sums[1:])
        h = mixed((sums[gram:] - sums[:-gram]) * down[: len(piece) - gram + 1])
        placed = (h & ~low_bits) | np.arange(len(h), dtype=np.uint64)  # a piece has fewer than 2**18 places
        place = (_slide(placed, w, np.minimum, np.uint64(2**64 - 1)) & low_bits).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.append(first[1:], len(place)) - 1
        place = place[first]
        around = np.zeros((PARTS, len(first)), np.uint64)
        for j, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            lo, hi = place - a, place + length - b + 1
            fits = (lo >= first) & (hi <= last + length)
            around[j, fits] = mixed((sums[hi[fits]] - sums[lo[fits]]) * down[lo[fits]]) | np.uint64(1)
        found.append((place + at, h[place], first + at, last + at, around))
    if not found:
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none, none, np.zeros((PARTS, 0), np.uint64)
    return tuple(np.concatenate(x, axis=-1) for x in zip(*found, strict=True))


def repeated_starts(regions: list[bytes], texts: np.ndarray, starts: np.ndarray, many: np.ndarray, length: int = LENGTH) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each region (bytes from ``starts`` of text number ``texts``; ``many``: occurs elsewhere as a whole), the places of its windows that are
    also somewhere else, and the places of those that stand for their class of equal windows."""
    m = len(regions)
    sizes = np.array([len(r) for r in regions])
    ends = np.cumsum(sizes + 1) - 1
    s = np.zeros(int(sizes.sum()) + m, np.int32)
    inside = np.ones(len(s), bool)
    inside[ends] = False
    s[inside] = np.frombuffer(b"".join(regions), np.uint8).astype(np.int32) + m
    s[ends] = np.arange(1, m + 1) % m  # every region ends with a symbol of its own, the last with 0
    sa = suffix_array(s, m + 256)
    prefixes = permuted_prefixes(s, sa)
    region = np.repeat(np.arange(m), sizes + 1)
    place = np.arange(len(s)) - np.repeat(ends - sizes, sizes + 1)
    whole = place + length <= sizes[region]
    first = np.flatnonzero(prefixes[sa] < length)  # where a class of equal windows begins
    occurrence = texts[region].astype(np.int64) << 40 | (starts[region] + place)
    ordered = occurrence[sa]
    other = (np.minimum.reduceat(ordered, first) != np.maximum.reduceat(ordered, first)) | np.maximum.reduceat(many[region][sa].astype(np.int8), first).astype(bool)
    found = np.empty(len(s), bool)
    found[sa] = np.repeat(other, np.diff(np.append(first, len(sa))))
    found &= whole
    stands = np.zeros(len(s), bool)
    stands[sa[first]] = True
    stands &= whole
    return tuple([place[a - n : a][x[a - n : a]] for a, n in zip(ends.tolist(), sizes.tolist(), strict=True)] for x in (found, stands))


def join_spans(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The union of spans, as disjoint spans that don't touch."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > ends[:-1]]))
    return list(zip(starts[new].tolist(), ends[np.append(new[1:] - 1, len(ends) - 1)].tolist(), strict=True))


def _packed(docs: DataFrame) -> DataFrame:
    """key, packed (compressed bytes) of texts (key, text); of equal texts one row a task, so that a text's copies don't meet in one task later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        seen: set[bytes] = set()
        for batch in batches:
            keys, packed = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key not in seen:
                    seen.add(key)
                    keys.append(key)
                    packed.append(pack(text.encode("utf-8", "surrogatepass")))
            if len(seen) > SEEN:  # what is forgotten is only sent twice
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(packed, pa.binary())], names=["key", "packed"])

    return docs.mapInArrow(run, "key binary, packed binary")


def _bucketed(df: DataFrame, name: str, buckets: int) -> DataFrame:
    """Written in buckets by key, of equal keys one row: joins by key with other tables then leave this one where it is."""
    spark = df.sparkSession
    path = new_path(spark, name)
    table = f"leadloom_{name}_{path.rpartition('-')[2]}"
    rows = df.repartition(buckets, "key").dropDuplicates(["key"])
    rows.write.bucketBy(buckets, "key").sortBy("key").option("path", path).saveAsTable(table)
    return spark.table(table)


def _anchor_rows(packed: DataFrame, length: int, gram: int) -> DataFrame:
    """hash, region (digest), key, lo, hi and around0, ... (see ``regions_of``) of every region of texts (key, packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), *[pa.int64()] * PARTS)
        names = ["hash", "region", "key", "lo", "hi", *(f"around{j}" for j in range(PARTS))]
        for batch in batches:
            cols: list[list] = [[] for _ in kinds]

            def rows(cols: list[list] = cols) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

            for key, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = unpack(packed)
                at, hashes, first, last, around = regions_of(data, length, gram)
                at, first, ends = at.tolist(), first.tolist(), (last + length).tolist()
                digests = [xxhash.xxh3_64_intdigest(data[a:b], p - a) for a, b, p in zip(first, ends, at, strict=True)]
                for c, x in zip(cols, (hashes.view(np.int64).tolist(), np.array(digests, np.uint64).view(np.int64).tolist(), [key] * len(at), first, ends, *around.view(np.int64).tolist()), strict=True):
                    c += x
                if len(cols[0]) > 100_000:
                    yield rows()
                    for c in cols:
                        c.clear()
            yield rows()

    more = ", ".join(f"around{j} long" for j in range(PARTS))
    return packed.mapInArrow(run, f"hash long, region long, key binary, lo int, hi int, {more}")


def _cut(texts: DataFrame) -> DataFrame:
    """The regions of texts (key, packed, wanted: structs of hash, lo, hi, many, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        kinds = (pa.int64(), pa.binary(), pa.int32(), pa.bool_(), pa.int64(), pa.binary())
        for batch in batches:
            rows = []
            for key, packed, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = unpack(packed)
                rows += [(x["hash"], key, x["lo"], x["many"], x["n"], data[x["lo"] : x["hi"]]) for x in wanted]
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["hash", "key", "lo", "many", "n", "bytes"])

    return texts.mapInArrow(run, "hash long, key binary, lo int, many boolean, n long, bytes binary")


def _shard_spans(length: int):
    """Spans (key, lo, hi) of a shard's windows that are also somewhere else. In a shard that holds only a part of a hot anchor's regions, also, for each class of
    equal windows, its digest with one of the windows, which the other parts' are compared with."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        regions, (texts, keys) = pdf["bytes"].tolist(), pd.factorize(pdf["key"])
        starts, many, hot = pdf["lo"].to_numpy(np.int64), pdf["many"].to_numpy(bool), bool(pdf["hot"].iloc[0])
        found, single = repeated_starts(regions, texts, starts, many, length)
        out: list[tuple] = []
        for i, at in enumerate(found):
            if len(at) and not many[i]:
                out += [(keys[texts[i]], a, b, None) for a, b in join_spans(at + starts[i], at + starts[i] + length)]
            if hot:
                out += [(keys[texts[i]], starts[i] + a, starts[i] + a + length, xxhash.xxh3_128_digest(regions[i][a : a + length])) for a in single[i].tolist()]
        return pd.DataFrame(out, columns=["key", "lo", "hi", "digest"]).astype({"lo": "int32", "hi": "int32"})

    return run


def _remove(texts: DataFrame) -> DataFrame:
    """key, spans (removed, disjoint, in order) and kept (the other bytes) of texts (key, packed, spans)."""
    kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            spans_out, kept = [], []
            for packed, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = unpack(packed)
                joined = join_spans(np.array([s["lo"] for s in spans], np.int64), np.array([s["hi"] for s in spans], np.int64))
                at, rest = 0, []
                for a, b in joined:
                    rest.append(data[at:a])
                    at = b
                kept.append(b"".join(rest) + data[at:])
                spans_out.append([{"lo": a, "hi": b} for a, b in joined])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans_out, kind), pa.array(kept, pa.binary())], names=["key", "spans", "kept"])

    return texts.mapInArrow(run, "key binary, spans array<struct<lo:bigint,hi:bigint>>, kept binary")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, max_regions: int = MAX_REGIONS) -> DataFrame:
    """A row a document: id_col, n_bytes, sha256 (of the whole text), spans (removed runs of bytes: array of lo, hi; null if none) and kept (the remaining bytes; null if nothing is
    removed: then the text itself)."""
    spark = df.sparkSession
    bound_batches(spark)
    t = F.coalesce(F.col(text), F.lit(""))
    docs = df.select(F.col(id_col).alias("id"), F.sha2(t, 256).alias("sha"), F.octet_length(t).cast("long").alias("n_bytes"), t.alias("text"))
    key = F.unhex(F.substring("sha", 1, 32)).alias("key")
    base = stash(docs.select("id", "sha", "n_bytes", key), "texts")
    long = docs.where(F.col("n_bytes") >= length).select(key, "text")
    total = base.agg(F.sum("n_bytes")).first()[0] or 0
    packed = _bucketed(_packed(long), "packed", min(MAX_BUCKETS, max(parallelism(spark), math.ceil(total / BUCKET_BYTES))))

    found = stash(_anchor_rows(packed, length, gram), "anchors")
    again = stash(found.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "repeated")
    found = stash(found.join(again, "hash", "left_semi"), "occurrences")
    around = F.array(*(f"around{j}" for j in range(PARTS)))
    place = F.struct("key", "lo")
    regions = stash(found.groupBy("hash", "region").agg(F.min(place).alias("first"), (F.count(F.lit(1)) > 1).alias("many"), F.min(around).alias("around")), "regions")
    strings = regions.select("hash", "region", F.posexplode("around").alias("part", "string")).where("string <> 0")
    shared = stash(strings.groupBy("hash", "part", "string").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash", "part", "string"), "shared")
    close = stash(strings.join(shared, ["hash", "part", "string"], "left_semi").select("hash", "region").distinct(), "close")
    regions = regions.drop("around").join(close.withColumn("close", F.lit(True)), ["hash", "region"], "left").where("many OR close")
    # only hot anchors need their sizes; these are few, so the regions of one needn't meet in a task for it
    sizes = stash(close.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_regions), "hot-anchors")
    regions = stash(regions.join(sizes, "hash", "left").select("hash", "region", "first", "many", F.coalesce("close", F.lit(False)).alias("close"), "n"), "regions")

    marked = found.join(regions, ["hash", "region"])
    wanted = F.when(F.col("close") & (place == F.col("first")), F.struct("hash", "lo", "hi", "many", "n"))
    spans = F.when(F.col("many"), F.struct("lo", "hi"))
    items = stash(marked.groupBy("key").agg(F.collect_set(wanted).alias("wanted"), F.collect_set(spans).alias("spans")), "items")
    cut = stash(_cut(packed.join(items.where("size(wanted) > 0").select("key", "wanted"), "key").select("key", "packed", "wanted")), "cut")

    shards = max(1, math.ceil((cut.agg(F.sum(F.length("bytes"))).first()[0] or 0) / shard_bytes))
    hot = F.col("n").isNotNull()
    # a hot anchor's regions are dealt over parts of at most max_regions; others are in the shard of their anchor
    part = F.when(hot, F.xxhash64("hash", F.pmod(F.xxhash64("key", "lo"), F.ceil(F.col("n") / max_regions)))).otherwise(F.pmod("hash", F.lit(shards)))
    dealt = cut.select("key", "lo", "many", "bytes", hot.alias("hot"), part.alias("shard"))
    parts = dealt.repartition(max(shards // 4, parallelism(spark)), "hot", "shard").groupBy("hot", "shard").applyInPandas(_shard_spans(length), "key binary, lo int, hi int, digest binary")
    parts = stash(parts, "spans")
    classes = parts.where("digest IS NOT NULL")
    more = stash(classes.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"), "classes")
    parts = parts.where("digest IS NULL").select("key", "lo", "hi").unionByName(classes.join(more, "digest", "left_semi").select("key", "lo", "hi"))
    parts = parts.unionByName(items.select("key", F.explode("spans").alias("s")).select("key", "s.lo", "s.hi"))
    spans = stash(parts.groupBy("key").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "joined-spans")
    removed = stash(_remove(packed.join(spans, "key").select("key", "packed", "spans")).withColumnsRenamed({"key": "k"}), "removed")
    copies = stash(base.groupBy(F.col("key").alias("c")).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "copies")
    out = base.join(removed, F.col("key") == F.col("k"), "left").join(copies, F.col("key") == F.col("c"), "left")
    gone = F.col("c").isNotNull() & (F.col("n_bytes") >= length)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("n_bytes").alias("hi")))
    return out.select(F.col("id").alias(id_col), "n_bytes", F.col("sha").alias("sha256"), F.when(gone, whole).otherwise(F.col("spans")).alias("spans"), F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept"))
