"""What is known of a session's originals, for leads that come in batches: their keys, and an index of their names.

Earlier leads aren't read again: a batch meets the stored keys that equal its own, and, by the index, the stored names that may be similar to its own. An index row is a name and one of its
rarest pairs of letters, as many as any similar name must share one of. Rarity is an order that must be the same for all names of an index, so it is stored with it; each base (see
``sources.versions``) counts it anew over all names and writes their rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import versions
from ..sources.scratch import stash
from .dedup import KINDS, THRESHOLD, letter_pairs, pair_rarity, posts, resolve_against
from .ingest import dedup_keys

KEYS, NAMES, RARITY = "kind int, key string, orig long", "name_key string, orig long, meet long", "pair long, seen long"


def _partners(threshold: int) -> Column:
    """For a name of length n: the lengths m that a similar one may have, with lost, the pairs of letters it may lack of the name's, and kept, those they have in common."""
    span = F.expr(f"sequence(cast(ceil(n * {threshold} / {200 - threshold}) AS int), cast(floor(n * {200 - threshold} / {max(threshold, 1)}) AS int))")
    edits = lambda m: F.floor((100 - threshold) * (F.col("n") + m) / 100).cast("int")

    def partner(m: Column) -> Column:
        even = edits(m) - F.pmod(F.col("n") + m - edits(m), F.lit(2))
        apart, least = F.abs(F.col("n") - m), F.least(F.col("n"), m)
        fewer, more = ((even - apart) / 2).cast("int"), ((even + apart) / 2).cast("int")  # edits of the longer name's kind, and of the shorter's
        lost = F.when(F.col("n") <= m, 2 * fewer + more).otherwise(2 * more + fewer)
        return F.struct(m.alias("m"), even.alias("edits"), (even - apart).alias("spare"), lost.alias("lost"), (least - 1 - 2 * fewer - more).alias("kept"))

    return F.filter(F.transform(span, partner), lambda p: p["spare"] >= 0)


def _length_mark(n: Column) -> Column:
    return F.xxhash64(F.lit("length"), n.cast("int"))


def _meetings(names: DataFrame, rarity: DataFrame, threshold: int, stored: bool) -> DataFrame:
    """Names (name_key and others) once for each ``meet`` by which they find similar ones. Names so short that similar ones need share no pair of letters are met by their length: stored names have a
    row of theirs, others a row for each such length."""
    rows = letter_pairs(names.withColumn("n", F.length("name_key")), rarity).withColumn("partners", _partners(threshold))
    first = F.slice("pairs", F.lit(1), F.array_max(F.transform("partners", lambda p: F.greatest(p["lost"], F.lit(0)) + 1)))
    short = F.filter("partners", lambda p: (p["kept"] <= 0) & (p["m"] > 0) & (p["edits"] > 0))
    marks = F.array(_length_mark(F.col("n"))) if stored else F.transform(short, lambda p: _length_mark(p["m"]))
    return rows.select(*names.columns, F.explode(F.array_distinct(F.concat(first, marks))).alias("meet"))


def _near(names: DataFrame, index: DataFrame, threshold: int) -> DataFrame:
    """Names of the index (name_key, orig) that meet one of ``names`` and that no more edits keep apart than similar names may have."""
    met = names.select(F.col("name_key").alias("x"), "meet").join(index.withColumnRenamed("name_key", "y"), "meet")
    edits = f"cast({100 - threshold} * (length(x) + length(y)) div 100 AS int)"
    near = met.where(f"abs(length(x) - length(y)) <= {edits} AND levenshtein(x, y, {edits}) >= 0")
    return near.groupBy(F.col("y").alias("name_key")).agg(F.min("orig").alias("orig"))


def resolve_batch(leads: DataFrame, path: str, number: int, threshold: int | None = THRESHOLD) -> DataFrame:
    """``resolve`` of a batch's leads against the originals of the batches before it, stored under ``path``, to which the batch's are added. Ids must grow from batch to
    batch, and ``threshold`` must stay as it is. A batch that is run again reads what it read before, and replaces what it wrote."""
    spark = leads.sparkSession
    at = {t: f"{path.rstrip('/')}/{t}" for t in ("keys", "names", "rarity")}
    leads = stash(leads.select("id", "email", "domain_normalized", "company_name"), "batch")
    own = posts(dedup_keys(leads), KINDS if threshold is not None else KINDS[:2])
    known = versions.read(spark, at["keys"], KEYS, number)
    met = known.join(own.select("kind", "key").distinct(), ["kind", "key"], "left_semi")
    versions.compact(spark, at["keys"], KEYS, number)
    if threshold is not None:
        names = own.where("kind = 2").groupBy(F.col("key").alias("name_key")).agg(F.min("id").alias("orig"))
        indexed = versions.read(spark, at["names"], NAMES, number)
        if versions.due(number) or not any(n <= number for n in versions.numbers(spark, at["rarity"])):
            every = indexed.select("name_key", "orig").distinct()
            versions.write(pair_rarity(every.unionByName(names).select("name_key").distinct()), at["rarity"], number)
            versions.compact(spark, at["names"], NAMES, number, lambda rows: _meetings(every, _rarity(spark, at["rarity"], number), threshold, True))
            indexed = versions.read(spark, at["names"], NAMES, number)
        rarity = _rarity(spark, at["rarity"], number)
        near = _near(_meetings(names.select("name_key"), rarity, threshold, False), indexed, threshold)
        met = met.unionByName(near.select(F.lit(2).alias("kind"), F.col("name_key").alias("key"), "orig"))
    found = stash(resolve_against(leads, met, threshold), "resolved")
    fresh = own.join(found.where("is_duplicate = 0").select("id"), "id", "left_semi").groupBy("kind", "key").agg(F.min("id").alias("orig"))
    versions.write(fresh, at["keys"], number)
    if threshold is not None:
        new = fresh.where("kind = 2").select(F.col("key").alias("name_key"), "orig")
        versions.write(_meetings(new, rarity, threshold, True), at["names"], number)
    return found


def _rarity(spark: SparkSession, path: str, number: int) -> DataFrame:
    """The order of the index that a batch reads and adds to: the newest one up to it."""
    newest = max(n for n in versions.numbers(spark, path) if n <= number)
    return spark.read.schema(RARITY).parquet(f"{path}/batch={newest}")
