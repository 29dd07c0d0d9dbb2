"""Contact lists to leads: header aliases, normalised columns, flags, stamps and ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed_values as V
from ..functions.text import fold, strip, text
from ..functions.urls import domains_related, email_domain, site_domain
from ..sources.scratch import stash


def pick_columns(df: DataFrame, aliases: dict[str, tuple[str, ...]] = V.HEADER_ALIASES) -> DataFrame:
    """The canonical columns: of a column's aliases (headers stripped, case folded, a byte order mark removed; the last of equal headers counts) the first that isn't
    empty in the row, then stripped. Headers that are missing give ''."""
    names = [f"c{i}" for i in range(len(df.columns))]
    by_name = {c.lstrip("﻿").strip().lower(): n for c, n in zip(df.columns, names, strict=True)}
    df = df.toDF(*names)

    def picked(options: tuple[str, ...]) -> Column:
        there = [F.nullif(F.col(by_name[a]).cast("string"), F.lit("")) for a in options if a in by_name]
        return strip(F.coalesce(*there, F.lit("")))

    return df.select(*(picked(options).alias(name) for name, options in aliases.items()))


def normalize(df: DataFrame) -> DataFrame:
    """Adds domain_normalized, email_domain, domain_mismatch (0/1) and domain_mismatch_reason to rows with email and website_url."""
    mail, site = email_domain("email"), site_domain("website_url")
    df = df.withColumns({"domain_normalized": site, "email_domain": mail})
    odd = (F.col("email_domain") != "") & ~F.col("email_domain").isin(*V.FREE_MAIL) & (F.col("domain_normalized") != "") & ~domains_related(F.col("email_domain"), F.col("domain_normalized"))
    reason = F.concat(F.lit("email domain '"), F.col("email_domain"), F.lit("' does not match website domain '"), F.col("domain_normalized"), F.lit("'"))
    return df.withColumns({"domain_mismatch": F.when(odd, 1).otherwise(0), "domain_mismatch_reason": F.when(odd, reason)})


def with_website(df: DataFrame) -> DataFrame:
    return df.where(strip("website_url") != "")


def _counts() -> list[Column]:
    there = strip("website_url") != ""
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return [count(there).alias("inserted"), count(~there).alias("skipped_no_website")]


def ingest_counts(df: DataFrame) -> DataFrame:
    """One row: inserted and skipped_no_website."""
    return df.agg(*_counts())


def with_ids(df: DataFrame, after: int = 0) -> DataFrame:
    """Consecutive ids in the order of the rows, without gathering them in one partition."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    marked = stash(df.withColumn("__at", F.monotonically_increasing_id()), "rows")  # the partition's number, and 33 bits of the place in it
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = marked.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.partitionBy().orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    starts = sizes.select("__part", before.alias("__before"))
    ids = (F.col("__before") + place + 1 + after).cast("long").alias("id")
    return marked.withColumn("__p", part).join(F.broadcast(starts), F.col("__p") == F.col("__part")).select(ids, *columns)


def stamp(df: DataFrame, session_id: int, batch_id: str, at: str | None = None) -> DataFrame:
    """Session, batch, status NEW and one time for the whole batch."""
    return df.withColumns({
        "session_id": F.lit(session_id).cast("long"),
        "batch_id": F.lit(batch_id),
        "status": F.lit("NEW"),
        "is_duplicate": F.lit(0),
        "duplicate_of_id": F.lit(None).cast("long"),
        "duplicate_reason": F.lit(None).cast("string"),
        "created_at": F.to_timestamp(F.lit(at)) if at else F.date_trunc("second", F.current_timestamp()),
    })


def ingest(raw: DataFrame, session_id: int, batch_id: str, after: int = 0, at: str | None = None, counts: Observation | None = None) -> DataFrame:
    """A contact list as read (all headers as they are) to lead rows. ``counts``, if given, has the numbers of ``ingest_counts`` when this returns: they are taken in the pass that writes the rows, not in one of their own."""
    rows = pick_columns(raw)
    if counts is not None:
        rows = rows.observe(counts, *_counts())
    return stamp(with_ids(normalize(with_website(rows)), after), session_id, batch_id, at)


def dedup_keys(df: DataFrame) -> DataFrame:
    """id with the keys that duplicates are found by; '' never matches."""
    tokens = F.array_sort(F.filter(F.split(fold("company_name"), r"(?U)\s+"), lambda x: x != ""))
    return df.select("id", fold("email").alias("email_key"), fold(text("domain_normalized")).alias("domain_key"), F.array_join(tokens, " ").alias("name_key"))
