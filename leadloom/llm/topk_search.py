"""Operator 1: exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are taken as sparse rows: dimension i is a term, its non-zero integer the weight. Candidates and queries
are dealt into blocks by a hash of their row; a task holds one candidate block as postings (per term: the rows
that have it, and their weights) and one query block. For each term it scatters query weight x posting weight
into a dense array of scores, then a partition selection takes each query's k best of that block. Only these
k rows a query and block are shuffled once more and merged.

Each query block meets each candidate block, so the work is queries x candidates, as exhaustive search is; memory a
task is one block of each and a tile of scores, whatever the input's size.

Rows: vectors that are null, or hold null or non-finite components, take no part, nor do rows without an id. A
shorter vector lacks the other terms (weight 0); an empty one scores 0. Ties go to the smaller id. Rows that
repeat an id are candidates of their own; a query never meets rows of its own id; equal query rows are one query.
Sums beyond 64 bits rank by their exact value and are reported as the nearest 64-bit number. Other columns are
not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import parallelism

#: Rows of a candidate block, of a query block, and queries whose scores are held at once. Each candidate is sent once a query block and each query once a
#: candidate block, so blocks are as large as a task's memory allows; only where that gives fewer tasks than cores are candidates cut into SMALL rows.
CANDIDATES, QUERIES, TILE, SMALL = 16_384, 16_384, 256, 4096
_FAR = 1 << 62


def integer_terms(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component, as double arithmetic; null where the vector takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))

    def whole(x: Column) -> Column:  # from 2**53 on every double is a whole number, and floor() gives 64 bits only
        return F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)

    return F.when(~bad, F.transform(vector, lambda x: whole(x.cast("double") * scale)))


def _postings(rows: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    width = max(map(len, rows), default=0)
    dense = np.zeros((len(rows), width))
    for i, row in enumerate(rows):
        dense[i, : len(row)] = row
    exact = width * float(np.abs(dense).max(initial=0)) ** 2 < _FAR
    out = []
    for t in range(width):
        at = np.flatnonzero(dense[:, t])
        w = dense[at, t]
        out.append((at, w.astype(np.int64) if exact else np.array([int(x) for x in w], object)))
    return out


def accumulate(queries: list[tuple[np.ndarray, np.ndarray]], n_queries: int, postings: list[tuple[np.ndarray, np.ndarray]], n_rows: int) -> np.ndarray:
    """Scores of queries x rows from both sides' postings, term at a time."""
    whole = all(w.dtype != object for _, w in (*queries, *postings)) and sum(int(np.abs(a[1]).max(initial=0)) * int(np.abs(b[1]).max(initial=0)) for a, b in zip(queries, postings, strict=False)) < _FAR
    scores = np.zeros((n_queries, n_rows), np.int64 if whole else object)
    for (qs, q), (rows, w) in zip(queries, postings, strict=False):
        if len(qs) and len(rows):
            if len(qs) == n_queries and len(rows) == n_rows:
                scores += q[:, None] * w[None, :]
            else:
                scores[np.ix_(qs, rows)] += q[:, None] * w[None, :]
    return scores


def _best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Rows of the k highest scores, ties to the smaller id (rows are in order of id), without the query's own id."""
    free = np.flatnonzero(ids != own)
    s = scores[free]
    if len(s) > k:
        least = np.partition(s, len(s) - k)[len(s) - k]
        over = np.flatnonzero(s > least)
        level = np.flatnonzero(s == least)[: k - len(over)]
        at = np.concatenate([over, level])
    else:
        at = np.arange(len(s))
    order = sorted(at.tolist(), key=lambda i: (-int(s[i]), i))
    return free[order]


def _beyond(score: int) -> str:
    """'' within 64 bits; beyond, text whose order is that of the scores."""
    if -(1 << 63) <= score < 1 << 63:
        return ""
    digits = f"{len(str(abs(score))):06d}{abs(score)}"
    return digits if score > 0 else "".join(str(9 - int(c)) for c in digits)


def _search(k: int):
    def run(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(queries) and len(rows):
            rows = rows.sort_values("row_id", kind="stable")
            ids = rows["row_id"].to_numpy(np.int64)
            postings = _postings([np.asarray(x, float) for x in rows["row_terms"]])
            for at in range(0, len(queries), TILE):
                part = queries.iloc[at : at + TILE]
                scores = accumulate(_postings([np.asarray(x, float) for x in part["terms"]]), len(part), postings, len(rows))
                for i, (q, row_key) in enumerate(zip(part["id"].tolist(), part["row"].tolist(), strict=True)):
                    for j in _best(scores[i], ids, q, k):
                        s = int(scores[i][j])
                        out.append((q, row_key, int(ids[j]), _beyond(s), max(-(1 << 63), min((1 << 63) - 1, s))))
        return pd.DataFrame(out, columns=["query_id", "row", "vec_id", "exact", "score"]).astype({"query_id": "int64", "row": "int64", "vec_id": "int64", "exact": "str", "score": "int64"})

    return run


def topk_search(df: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector: str = "embedding", candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """The k highest inner products of every query row (``is_query``) with all other rows: query_id, rank (from 1), vec_id, score."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), integer_terms(F.col(vector), scale).alias("terms"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where("id IS NOT NULL AND terms IS NOT NULL")
    n, n_asks = df.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    row_blocks, query_blocks = max(1, math.ceil(n / candidates)), max(1, math.ceil(n_asks / queries))
    row_blocks = max(row_blocks, min(math.ceil(n / SMALL), math.ceil(parallelism(df.sparkSession) / query_blocks)))
    hashed = F.xxhash64("id", "terms")
    asks = rows.where("asks").select("id", "terms", hashed.alias("row")).dropDuplicates(["id", "row"])
    asks = asks.select("id", "terms", "row", F.pmod("row", F.lit(query_blocks)).cast("long").alias("qb"), F.explode(F.expr(f"sequence(0L, {row_blocks - 1}L)")).alias("cb"))
    # equal rows are dealt apart, too: the partition's number is a salt, and which block a candidate is in doesn't matter
    dealt = F.pmod(F.xxhash64("id", "terms", F.spark_partition_id()), F.lit(row_blocks)).cast("long")
    cands = rows.select(F.col("id").alias("row_id"), F.col("terms").alias("row_terms"), dealt.alias("cb"), F.explode(F.expr(f"sequence(0L, {query_blocks - 1}L)")).alias("qb"))
    found = asks.groupBy("cb", "qb").cogroup(cands.groupBy("cb", "qb")).applyInPandas(_search(k), "query_id long, row long, vec_id long, exact string, score long")
    best = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), F.desc("exact"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
