"""All changes of leads as one log, and its fold to the current state.

An event has a lead, a sequence number, a value for every field of the log, and a mask that says which fields it sets: a field that is set to null
differs from one that isn't set. The state of a field is its value in the last event that sets it. One aggregation folds all fields: for each, the
largest (sequence number, value) of the events whose mask has it, so that what is shuffled is a row a lead and task, and no lead's events are sorted or gathered.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields of the log, in the order of their bits.
FIELDS = {
    "status": "string", "last_error": "string", "scrape_seconds": "double", "score_seconds": "double", "review_status": "string", "review_segment_override": "string", "reviewed_at": "string",
    "is_duplicate": "int", "duplicate_of_id": "bigint", "duplicate_reason": "string",
}
BITS = {field: 1 << i for i, field in enumerate(FIELDS)}


def events(rows: DataFrame, lead: str | Column, seq: str | Column, **values: str | Column | tuple[Column, Column | str]) -> DataFrame:
    """The log's rows of ``rows``. ``values``: for each field that they set, its value (a column), or the condition under which it is set and its value."""
    unknown = set(values) - set(FIELDS)
    if unknown:
        raise ValueError(f"not in the log: {', '.join(sorted(unknown))}")
    column = lambda c: F.col(c) if isinstance(c, str) else c
    mask, out = F.lit(0).cast("long"), {}
    for field, kind in FIELDS.items():
        given = values.get(field)
        when, value = given if isinstance(given, tuple) else (F.lit(given is not None), given)
        when = F.coalesce(when, F.lit(False))
        mask = mask.bitwiseOR(F.when(when, F.lit(BITS[field]).cast("long")).otherwise(F.lit(0).cast("long")))
        out[field] = F.when(when, column(value)).cast(kind) if given is not None else F.lit(None).cast(kind)
    return rows.select(column(lead).cast("long").alias("lead_id"), column(seq).cast("long").alias("seq"), mask.alias("present"), *(c.alias(f) for f, c in out.items()))


def of_progress(progress: DataFrame) -> DataFrame:
    """Progress events: a status also sets the error (and so clears it); times are set where there are any."""
    there = F.col("status").isNotNull()
    times = {c: (F.col(c).isNotNull(), c) for c in ("scrape_seconds", "score_seconds") if c in progress.columns}
    return events(progress, "lead_id", "seq", status=(there, "status"), last_error=(there, "error"), **times)


def of_reviews(decisions: DataFrame) -> DataFrame:
    """Decisions, of which only approvals and rejections set anything."""
    counts = F.col("review_status").isin("APPROVED", "REJECTED")
    fields = [c for c in ("review_status", "review_segment_override", "reviewed_at") if c in decisions.columns]
    return events(decisions, "lead_id", "seq", **{c: (counts, c) for c in fields})


def of_marks(leads: DataFrame, seq: str | Column = "seq") -> DataFrame:
    """Leads (id, duplicate_of_id, duplicate_reason) marked as duplicates by hand."""
    return events(leads, "id", seq, is_duplicate=F.lit(1), duplicate_of_id="duplicate_of_id", duplicate_reason="duplicate_reason")


def of_overrides(leads: DataFrame, seq: str | Column = "seq") -> DataFrame:
    """Duplicates (id) that become originals again, as new leads."""
    none = F.lit(None)
    return events(leads, "id", seq, is_duplicate=F.lit(0), duplicate_of_id=none, duplicate_reason=none, status=F.lit("NEW"))


def of_statuses(leads: DataFrame, status: str, seq: str | Column = "seq") -> DataFrame:
    """Leads (id) whose status is set, without an error: those chosen for another scoring, or skipped."""
    return events(leads, "id", seq, status=F.lit(status), last_error=F.lit(None))


def merged(*logs: DataFrame) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, logs)


def fold(log: DataFrame) -> DataFrame:
    """lead_id, present (the fields that were ever set) and the fields' last values. Of events with one number, the largest value counts, null the least. Events without a number come first."""
    last = []
    for field, bit in BITS.items():
        there = F.col("present").bitwiseAND(F.lit(bit)) != 0
        last.append(F.max(F.when(there, F.struct("seq", field)))[field].alias(field))
    return log.groupBy("lead_id").agg(F.bit_or("present").alias("present"), *last)


def apply(leads: DataFrame, folded: DataFrame) -> DataFrame:
    """Leads (id) with the fields that the log sets; they keep what it never sets, and fields that they don't have are added."""
    renamed = folded.select(F.col("lead_id").alias("__lead"), F.col("present").alias("__present"), *(F.col(f).alias(f"__{f}") for f in FIELDS))
    df = leads.join(renamed, F.col("id") == F.col("__lead"), "left")
    out = {}
    for field, bit in BITS.items():
        own = F.col(field) if field in leads.columns else F.lit(None).cast(FIELDS[field])
        out[field] = F.when(F.coalesce(F.col("__present"), F.lit(0)).bitwiseAND(F.lit(bit)) != 0, F.col(f"__{field}")).otherwise(own)
    return df.withColumns(out).drop("__lead", "__present", *(f"__{f}" for f in FIELDS))
