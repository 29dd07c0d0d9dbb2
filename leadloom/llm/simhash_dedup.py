"""Operator 4: SimHash near-duplicates by tiled exact comparison.

A fingerprint bit is set if it is set in over half of the hashes (XXH64, seed 42) of the text's word shingles, repeats
included. Fingerprints at ``radius`` or fewer differing bits are linked; classes are the connected components of these links.

Fingerprints are compared exactly, in tiles: numpy exclusive-or of two runs of fingerprints in order of their
population counts, then bit counts; pairs of runs whose counts differ by more than the radius are skipped. So that tiles needn't
cover all pairs of a large corpus, distinct fingerprints are cut into bands of bits and first put into buckets by every choice of
all but ``radius`` bands: two within the radius agree in one such choice at least, so no link is lost, whatever the number of bands. More bands make
wider choices (4: 4 of 16 bits; 5: 10 of 25; 6: 20 of 32; 7: 35 of 36; 8: 56 of 40), and as many are taken as keep a bucket of evenly spread fingerprints within half a tile. Buckets are packed into tiles of about
``tile`` rows. A bucket larger than that is cut by population count (and, if need be, by a hash), and only
pairs of parts whose counts are within the radius are compared, each in a task of its own. A tile reports no pairs but a
spanning forest of its links, so a group of n near copies gives fewer than n rows a tile.

Copies with one fingerprint are one node, whatever their number. Rows: a null text is empty; a text without words has
fingerprint zero and is linked like any other; fewer words than a shingle make one shingle; repeated rows get equal results; rows
without an id take part, but don't name a component (its id is null if it has no other). Long texts are read in pieces of 1 MB.
Other columns are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, lean, stash, word_runs
from .components import star_components

TILE, HOT_TILE, RUN = 4096, 16_384, 256
SEED, SHINGLE, RADIUS = 42, 3, 3


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint, unsigned."""
    ones, n, left = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for words in word_runs((text or "").encode("utf-8", "surrogatepass").lower()):
        words = left + words
        if len(words) >= shingle:
            joined = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
            hashes = np.fromiter((digest(s, SEED) for s in joined), np.uint64)
            ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            n += len(hashes)
        left = words[max(0, len(words) - shingle + 1) :]
    if not n and left:
        return digest(b" ".join(left), SEED)
    bits = 2 * ones > n if n else np.zeros(64, bool)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), shingle: int = SHINGLE) -> DataFrame:
    """``keep`` and fp, the fingerprint as a signed long."""
    bound_batches(df.sparkSession)
    src = df.select(*keep, F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x, shingle) for x in batch.column(len(keep)).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found.view(np.int64))], names=[*keep, "fp"])

    return src.mapInArrow(lean("simhash_dedup", run), T.StructType([src.schema[c] for c in keep] + [T.StructField("fp", T.LongType())]))


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def tile_links(values: np.ndarray, side: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the fingerprints of side 0, and between those of side 1 and side 2, as (member, smallest member)."""
    counts = np.bitwise_count(values)
    order = np.lexsort((values, counts))
    values, counts, side = values[order], counts[order].astype(np.int64), side[order]
    label = np.arange(len(values))
    parent = label.tolist()
    groups = [(np.flatnonzero(side == 0),) * 2, (np.flatnonzero(side == 1), np.flatnonzero(side == 2))]
    for left, right in groups:
        same = left is right
        for a in range(0, len(left), RUN):
            i = left[a : a + RUN]
            for b in range(a if same else 0, len(right), RUN):
                j = right[b : b + RUN]
                if counts[j[0]] - counts[i[-1]] > radius or counts[i[0]] - counts[j[-1]] > radius:
                    continue
                near = np.bitwise_count(values[i][:, None] ^ values[j][None, :]) <= radius
                x, y = np.nonzero(near)
                x, y = label[i[x]], label[j[y]]
                apart = x != y
                if apart.any():
                    for p, q in np.unique(np.stack([x[apart], y[apart]], 1), axis=0).tolist():
                        p, q = _find(parent, p), _find(parent, q)
                        parent[max(p, q)] = min(p, q)
                    label = np.array([_find(parent, k) for k in range(len(parent))])
    signed = values.view(np.int64)
    out = []
    linked = np.flatnonzero(np.bincount(label, minlength=len(values))[label] > 1)
    smallest: dict[int, int] = {}
    for k in linked.tolist():
        smallest[label[k]] = min(smallest.get(label[k], int(signed[k])), int(signed[k]))
    for k in linked.tolist():
        if int(signed[k]) != smallest[label[k]]:
            out.append((int(signed[k]), smallest[label[k]]))
    return out


def band_masks(radius: int, bands: int) -> list[int]:
    """The bits of every choice of ``bands`` - ``radius`` bands, as signed longs."""
    ends = [64 * i // bands for i in range(bands + 1)]
    parts = [(1 << b) - (1 << a) for a, b in itertools.pairwise(ends)]
    masks = [sum(chosen) for chosen in itertools.combinations(parts, bands - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def bands_for(n: int, radius: int, tile: int = TILE) -> int:
    """The fewest bands whose choices hold ``n`` evenly spread fingerprints in buckets of half a tile, or eight more than the radius."""
    fits = (b for b in range(radius + 1, radius + 9) if n / 2 ** (64 * (b - radius) // b) <= tile / 2)
    return next(fits, radius + 9)


def fingerprint_links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE, hot_tile: int = HOT_TILE, bands: int | None = None) -> DataFrame:
    """Links (a, b) whose connected components are those of all pairs of distinct fingerprints ``fp`` within the radius."""
    n = nodes.count()
    masks = band_masks(radius, bands or bands_for(n, radius, tile))
    mask = F.posexplode(F.array(*(F.lit(m).cast("long") for m in masks))).alias("choice", "mask")
    rows = nodes.select("fp", F.bit_count("fp").alias("ones"), mask)
    rows = rows.select("fp", "ones", F.xxhash64("choice", F.col("fp").bitwiseAND(F.col("mask"))).alias("bucket"))
    hot = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > tile)
    hot = stash(hot.select(F.col("bucket").alias("hot"), F.ceil(F.col("size") / hot_tile).cast("int").alias("parts")), "hot-buckets")
    rows = rows.join(hot, F.col("bucket") == F.col("hot"), "left")
    tiles = max(1, math.ceil(n * len(masks) / tile))
    cold = rows.where("hot IS NULL").select(F.pmod("bucket", F.lit(tiles)).alias("tile"), F.lit(0).alias("side"), "fp")
    dealt = rows.where("hot IS NOT NULL").withColumn("part", F.pmod(F.xxhash64("fp", "bucket"), F.col("parts")).cast("int"))
    other = F.expr(f"explode(flatten(transform(sequence(-{radius}, {radius}), d -> transform(sequence(0, parts - 1), p -> struct(ones + d AS ones, p AS part)))))")
    pairs = dealt.select("fp", "bucket", F.struct("ones", "part").alias("own"), other.alias("other"))
    pairs = pairs.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"), F.lit("hot")).alias("tile"), F.expr("CASE WHEN own = other THEN 0 WHEN own < other THEN 1 ELSE 2 END").alias("side"), "fp")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates()
        return pd.DataFrame(tile_links(pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["side"].to_numpy(), radius), columns=["a", "b"], dtype="int64")

    return cold.unionByName(pairs).groupBy("tile").applyInPandas(compare, "a long, b long")


def near_duplicates(df: DataFrame, text: str = "text", id_col: str = "doc_id", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """A row a document: id_col, fp (signed long), component_id (the smallest id of its component)."""
    docs = stash(fingerprints(df.select(F.col(id_col).alias("__id"), F.col(text).alias("__t")), "__t", ("__id",), shingle), "fingerprints")
    nodes = stash(docs.groupBy("fp").agg(F.min("__id").alias("first")), "nodes")
    roots = star_components(fingerprint_links(nodes, radius))
    members = stash(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "members")
    least = stash(members.groupBy("root").agg(F.min("first").alias("component_id")), "classes")
    classes = stash(members.join(least, "root").select(F.col("fp").alias("f"), "component_id"), "classes")
    return docs.join(classes, F.col("fp") == F.col("f")).select(F.col("__id").alias(id_col), "fp", "component_id")
