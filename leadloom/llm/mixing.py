"""Operator 9: mixing sources to target weights by Pfair scheduling, in native expressions only.

A source's documents, in the order of a hash of their ids, form blocks of ``block_docs``. Target weights become whole parts p
of a period of P slots. Block i (from 0) of a source may take a slot from its release floor(i P / p) on and must by its deadline
ceil((i + 1) P / p); in each slot the released block with the earliest deadline goes first. As the parts fill the
period, every deadline is met, so after any number of slots a source is less than one block from its share. A period
leaves nothing over, so the slots of one period are worked out once and repeat; every document gets its slot by a join with
that table, whose size is bounded by ``parts`` + ``max_sources``.

All documents are scheduled, each once. Where a source runs out its slots stay empty, and the others keep their
order and their proportions.

Positions inside a source are not counted in one task: documents are dealt to hash ranges of about ``range_docs``, counted
there, and offset by the counts of the ranges before.

Rows: a null source is a source; a null id sorts as the empty id; repeated rows are documents of their own; an empty table gives
none. Weights: parameter ``weights`` (source -> weight; sources without one share ``rest``), or, without it, each source's
number of documents to the power ``alpha``; a weight under one part counts one part. More than ``max_sources`` sources
raise a ValueError. Texts aren't read unless they are to be carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK_DOCS, PARTS, ALPHA, MAX_SOURCES, RANGE_DOCS = 16, 1000, 0.5, 4096, 4096


def target_parts(df: DataFrame, weights: dict[str, float] | None = None, rest: float = 0.0, alpha: float = ALPHA, parts: int = PARTS, max_sources: int = MAX_SOURCES, source: str = "source") -> DataFrame:
    """A row a source: source, n, lane (its number, by name, null first), p (parts), period."""
    counts = df.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    n_sources = counts.count()
    if n_sources > max_sources:
        raise ValueError(f"{n_sources} sources; at most {max_sources} can be mixed")
    if weights is None:
        w = F.pow(F.col("n").cast("double"), F.lit(alpha))
    else:
        given = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)) if weights else F.lit(None).cast("map<string,double>")
        w = F.coalesce(F.get(F.filter(F.map_values(F.map_filter(given, lambda k, _: k.eqNullSafe(F.col("source")))), lambda x: x.isNotNull()), F.lit(0)), F.lit(rest))
    lanes = counts.withColumn("w", w.cast("double"))
    everything = Window.partitionBy()  # at most max_sources rows
    lanes = lanes.withColumn("p", F.greatest(F.lit(1), F.floor(F.col("w") / F.sum("w").over(everything) * parts + 0.5)).cast("long"))
    order = Window.partitionBy().orderBy(F.col("source").asc_nulls_first())
    return lanes.select("source", "n", (F.row_number().over(order) - 1).alias("lane"), "p", F.sum("p").over(everything).alias("period"))


def period_slots(lanes: DataFrame) -> DataFrame:
    """The period's earliest-deadline-first order: lane, i (the block's number within the period), slot."""
    one = lanes.groupBy().agg(F.sort_array(F.collect_list(F.struct("lane", "p"))).alias("lanes"), F.max("period").alias("period")).where("size(lanes) > 0")
    order = F.expr("""
        aggregate(sequence(0L, period - 1),
          named_struct('done', transform(lanes, l -> 0L), 'slots', cast(array() AS array<struct<lane: int, i: bigint>>)),
          (a, t) -> transform(array(
              array_min(transform(filter(arrays_zip(lanes, a.done), z -> z.done < z.lanes.p AND (z.done * period) div z.lanes.p <= t),
                z -> named_struct('deadline', ((z.done + 1) * period + z.lanes.p - 1) div z.lanes.p, 'lane', z.lanes.lane, 'i', z.done)))),
            b -> named_struct(
              'done', transform(a.done, (d, k) -> CASE WHEN k = b.lane THEN d + 1 ELSE d END),
              'slots', concat(a.slots, array(named_struct('lane', b.lane, 'i', b.i)))))[0],
          a -> a.slots)""")
    return one.select(F.posexplode(order).alias("slot", "b")).select(F.col("b.lane").alias("lane"), F.col("b.i").alias("i"), F.col("slot").cast("long").alias("slot"))


def mix(df: DataFrame, weights: dict[str, float] | None = None, rest: float = 0.0, alpha: float = ALPHA, parts: int = PARTS, block_docs: int = BLOCK_DOCS, range_docs: int = RANGE_DOCS, max_sources: int = MAX_SOURCES, id_col: str = "doc_id", source: str = "source", keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """``keep`` and each document's block (within its source), block_pos, slot, release and deadline (in slots)."""
    lanes = target_parts(df.select(source), weights, rest, alpha, parts, max_sources, source)
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    docs = df.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(id_col).alias("__id"), F.col(source).alias("__source"), key.alias("__key"))
    docs = docs.join(F.broadcast(lanes), F.col("__source").eqNullSafe(F.col("source")))  # at most max_sources rows
    ranges = F.ceil(F.col("n") / range_docs)
    docs = docs.withColumn("__range", F.floor(F.conv(F.substring("__key", 1, 8), 16, 10).cast("long") * ranges / F.lit(1 << 32)))
    sizes = docs.groupBy("lane", "__range").agg(F.count(F.lit(1)).alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("lane").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("lane").alias("l"), F.col("__range").alias("r"), before.alias("before"))
    order = [F.col("__key"), F.col("__id").asc_nulls_first()]
    docs = docs.withColumn("__rank", F.row_number().over(Window.partitionBy("lane", "__range").orderBy(*order)) - 1)
    docs = docs.join(offsets, (F.col("lane") == F.col("l")) & (F.col("__range") == F.col("r")))
    docs = docs.withColumn("__rank", F.col("__rank") + F.col("before"))
    docs = docs.withColumn("block", F.floor(F.col("__rank") / block_docs)).withColumn("block_pos", (F.col("__rank") % block_docs).cast("long"))
    docs = docs.withColumn("__i", F.col("block") % F.col("p"))
    slots = period_slots(lanes).select(F.col("lane").alias("sl"), "i", F.col("slot").alias("s"))
    docs = docs.join(F.broadcast(slots), (F.col("lane") == F.col("sl")) & (F.col("__i") == F.col("i")))  # at most parts + max_sources rows
    start = F.floor(F.col("block") / F.col("p")) * F.col("period")
    release = start + F.expr("(__i * period) div p")
    deadline = start + F.expr("((__i + 1) * period + p - 1) div p")
    return docs.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), F.col("block").cast("long").alias("block"), "block_pos", (start + F.col("s")).cast("long").alias("slot"), release.cast("long").alias("release"), deadline.cast("long").alias("deadline"))
