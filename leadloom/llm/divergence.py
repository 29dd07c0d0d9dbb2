"""Operator 12: how far the term distributions of a language's sources lie apart, from one-hot products of count levels.

Every term of a language has a level in each source: the smoothed share that its count gives it there. A term is a row with
one 1 for each source, in the column of (source, level); the product of these indicator columns with their transpose holds, for each two
sources, how many terms have each pair of levels: their joint table. All that a comparison of two sources needs can be priced from
their table, both ways.

Terms with equal levels in all sources are one row with a weight. Rows are dealt into blocks, terms of like frequency together, so that a
block has few different levels; within a block the product is taken tile by tile, in floating point numbers that hold whole numbers
exactly, and the tables of blocks are added up. Counts, shares and prices are whole numbers (decimals where 64 bits might not do).

Rows: null texts, languages and sources are ''; a source without a term is a group too; equal rows count each; an empty table gives no row. Extra
columns are not read. A term's levels, one number a source, are one row, and every two sources of a language are rows of the result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound_batches, stash

#: Documents of its language that a term must be in, the whole that shares are of, terms of a source that are reported.
LEAST_DOCS, WHOLE, FIRST = 3, 1_000_000_000, 200
#: Terms of a block of rows, columns of a tile, and counts that a task holds before it passes them on.
BLOCK, TILE, HELD = 4096, 1024, 600_000
#: Of lower-cased UTF-8 bytes: letters, and whatever isn't ASCII.
_TERM = re.compile(rb"[a-z\x80-\xff]+")


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, term, c (occurrences), docs (documents with the term). A row with term null stands for each source."""
    bound_batches(docs.sparkSession)
    lang, source, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang, source, text))
    src = docs.select(lang.alias("lang"), source.alias("source"), text.cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        n = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), (counts, docs) in held.items():
                terms = pa.array([None, *counts], pa.binary()).cast(pa.string())
                groups = [pa.repeat(pa.scalar(x, pa.string()), len(terms)) for x in (lang, source)]
                numbers = [pa.array([0, *c], pa.int64()) for c in (counts.values(), map(docs.__getitem__, counts))]
                yield pa.RecordBatch.from_arrays([*groups, terms, *numbers], names=["lang", "source", "term", "c", "docs"])

        for batch in batches:
            for at in range(len(batch)):
                group = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                found = _TERM.findall(batch.column(2)[at].as_py().lower())  # of bytes: A-Z
                counts, docs = held.setdefault(group, (Counter(), Counter()))
                n -= len(counts)
                counts.update(found)
                docs.update(set(found))
                n += len(counts)
                if n >= HELD:
                    yield from rows()
                    held, n = {}, 0
        yield from rows()

    found = src.mapInArrow(run, "lang string, source string, term string, c long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("docs").alias("docs"))


def _share(count: Column | str, size: Column | str) -> Column:
    """1 + floor(WHOLE * (count + 1) / size)."""
    whole = F.lit(WHOLE).cast("decimal(10,0)") * (F.col(count) if isinstance(count, str) else count).cast("decimal(20,0)")
    size = (F.col(size) if isinstance(size, str) else size).cast("decimal(20,0)")
    more = F.lit(WHOLE).cast("decimal(31,0)")
    return (F.call_function("div", (whole + more).cast("decimal(38,0)"), size) + 1).cast("long")


def _price(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are no larger than WHOLE + 1, so a square has 64 bits at most."""
    return F.call_function("div", (p - q) * (p - q), q)


def levels(counts: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """From ``term_counts``: (lang, term, total, cells: source and c of the sources that have it) of the kept terms, and a row a language: lang, v (its kept
    terms), size (its kept occurrences and v), groups (source and size, in order)."""
    rows = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("c").alias("total"), F.collect_list(F.struct("source", "c")).alias("cells"))
    kept = stash(rows.where(F.col("docs") >= least_docs).select("lang", "term", "total", "cells"), "kept-terms")
    sums = kept.select("lang", F.explode("cells").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.c").alias("n"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("n"))
    groups = counts.where("term IS NULL").select("lang", "source").join(sums, ["lang", "source"], "left").select("lang", F.struct("source", F.coalesce("n", F.lit(0)).alias("n")).alias("g"))
    groups = groups.groupBy("lang").agg(F.array_sort(F.collect_list("g")).alias("groups")).join(langs, "lang", "left")
    v = F.coalesce("v", F.lit(0))
    sized = F.transform("groups", lambda g: F.struct(g["source"].alias("source"), (g["n"] + v).alias("size")))
    return kept, stash(groups.select("lang", v.alias("v"), (F.coalesce("n", F.lit(0)) + v).alias("size"), sized.alias("groups")), "languages")


def joint_tables(kept: DataFrame, langs: DataFrame, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """lang, a, b (places of two sources in the language's list, a < b), level_a, level_b, n: how many terms have these levels."""
    rows = kept.join(langs.select("lang", "v", "groups"), "lang").withColumn("cells", F.map_from_entries("cells"))
    vector = F.transform("groups", lambda g: _share(F.coalesce(F.try_element_at("cells", g["source"]), F.lit(0)), g["size"]))
    like = F.floor(F.log2("total")).cast("int")
    weighted = rows.select("lang", "v", like.alias("like"), vector.alias("vector")).groupBy("lang", "v", "like", "vector").agg(F.count(F.lit(1)).alias("w"))
    dealt = weighted.withColumn("part", F.pmod(F.xxhash64("vector"), F.ceil(F.col("v") / block)))

    def product(table: pa.Table) -> pa.Table:
        lang = table["lang"][0].as_py()
        vectors = np.array(table["vector"].to_pylist(), np.int64)
        w = table["w"].to_numpy().astype(np.float64)
        n, g = vectors.shape
        columns = [np.unique(vectors[:, i], return_inverse=True) for i in range(g)]
        # tiles of whole sources, of about ``tile`` columns
        tiles, at = [[]], 0
        for i, (values, _) in enumerate(columns):
            if tiles[-1] and at + len(values) > tile:
                tiles.append([])
                at = 0
            tiles[-1].append(i)
            at += len(values)

        def indicators(group: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            starts = np.append(0, np.cumsum([len(columns[i][0]) for i in group]))
            ones = np.zeros((n, starts[-1]))
            for i, start in zip(group, starts, strict=False):
                ones[np.arange(n), start + columns[i][1]] = 1
            return ones, np.repeat(group, np.diff(starts)), np.concatenate([columns[i][0] for i in group])

        found = []
        for i, first in enumerate(tiles):
            left, of_left, level_left = indicators(first)
            left = np.ascontiguousarray((left * w[:, None]).T)
            for second in tiles[i:]:
                right, of_right, level_right = indicators(second)
                table = left @ right  # whole numbers under 2 ** 53
                x, y = np.nonzero(table)
                apart = of_left[x] < of_right[y]
                x, y = x[apart], y[apart]
                found.append((of_left[x], of_right[y], level_left[x], level_right[y], table[x, y]))
        a, b, level_a, level_b, n_terms = (np.concatenate(c).astype(np.int64) for c in zip(*found, strict=True))
        return pa.table([pa.array([lang] * len(a), pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(level_a), pa.array(level_b), pa.array(n_terms)], names=["lang", "a", "b", "level_a", "level_b", "n"])

    found = dealt.groupBy("lang", "like", "part").applyInArrow(product, "lang string, a int, b int, level_a long, level_b long, n long")
    return found.groupBy("lang", "a", "b", "level_a", "level_b").agg(F.sum("n").alias("n"))


def compare_sources(joint: DataFrame, langs: DataFrame) -> DataFrame:
    """lang, source, item, value for every two sources of a language: the priced table of the source against the other, item."""
    p, q, n = F.col("level_a"), F.col("level_b"), F.col("n").cast("decimal(19,0)")
    priced = joint.groupBy("lang", "a", "b").agg(F.sum(n * _price(p, q)).alias("ab"), F.sum(n * _price(q, p)).alias("ba"))
    groups = langs.select("lang", F.posexplode(F.col("groups.source")).alias("at", "source"))
    left, right = (groups.select("lang", F.col("at").alias(x), F.col("source").alias(name)) for x, name in (("a", "source"), ("b", "item")))
    two = left.join(right, "lang").where("a < b").join(priced, ["lang", "a", "b"], "left")
    value = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    both = F.array(F.struct("source", "item", value("ab").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), value("ba").alias("value")))
    return two.select("lang", F.explode(both).alias("x")).select("lang", "x.*")


def telling_terms(kept: DataFrame, langs: DataFrame) -> DataFrame:
    """lang, source, item, value of each term that a source has and uses more than its language does."""
    cells = kept.select("lang", "term", "total", F.explode("cells").alias("x")).select("lang", "term", "total", "x.*")
    sizes = langs.select("lang", F.col("size").alias("lang_size"), F.explode("groups").alias("g")).select("lang", "lang_size", "g.source", "g.size")
    rows = cells.join(sizes, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), _share("c", "size").alias("p"), _share("total", "lang_size").alias("q"))
    return rows.where("p > q").select("lang", "source", "item", _price(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS, first: int = FIRST) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank: every other source by how far its terms lie apart, and the ``first`` terms that tell a source from its language."""
    kept, langs = levels(stash(term_counts(docs, lang, source, text), "term-counts"), least_docs)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = compare_sources(joint_tables(kept, langs), langs).withColumn("rank", rank)
    terms = telling_terms(kept, langs).withColumn("rank", rank).where(F.col("rank") <= first)
    columns = ("lang", "source", "part", "item", "value", "rank")
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(terms.withColumn("part", F.lit("term")).select(*columns))
