"""Changes as rows that are added, and folds of them to the current state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from . import verdicts
from .leads import latest


def fold_progress(events: DataFrame) -> DataFrame:
    """Per lead_id: status and last_error of its last event with a status (which also clears an error), scrape_seconds and score_seconds of the last events that have them."""
    timed = [c for c in ("scrape_seconds", "score_seconds") if c in events.columns]
    last = F.max(F.when(F.col("status").isNotNull(), F.struct("seq", "status", "error")))
    kept = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in timed]
    out = events.groupBy("lead_id").agg(last.alias("s"), F.count(F.lit(1)).alias("events"), *kept)
    return out.select("lead_id", F.col("s.status").alias("status"), F.col("s.error").alias("last_error"), "events", *timed)


def fold_reviews(decisions: DataFrame) -> DataFrame:
    """Per lead_id the last decision (APPROVED or REJECTED; others don't count): review_status, segment override, reviewed_at."""
    return latest(decisions.where(F.col("review_status").isin("APPROVED", "REJECTED")), "lead_id", ["seq"]).drop("seq")


def fold_sessions(events: DataFrame) -> DataFrame:
    """Per session_id: the last status, and the last completed_at that isn't null."""
    return events.groupBy("session_id").agg(F.max_by("status", "seq").alias("status"), F.max_by("completed_at", F.when(F.col("completed_at").isNotNull(), F.col("seq"))).alias("completed_at"))


def latest_progress(events: DataFrame) -> DataFrame:
    """Per session_id its last event; also a streaming aggregation."""
    fields = ("seq", "lead_id", "step", "status", "error")
    return events.groupBy("session_id").agg(F.max(F.struct(*fields)).alias("e")).select("session_id", *(F.col(f"e.{c}").alias(c) for c in fields))


#: Sums of some of a session's events; those of all its parts add up.
PARTS = "session_id long, processed long, events long, first timestamp, last timestamp"


def count_parts(events: DataFrame) -> DataFrame:
    done = F.coalesce(F.sum(F.when(F.col("step") == "done", 1).otherwise(0)), F.lit(0)).cast("long")
    ts = F.col("ts").cast("timestamp")
    return events.groupBy("session_id").agg(done.alias("processed"), F.count(F.lit(1)).alias("events"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def added(parts: DataFrame) -> DataFrame:
    """The parts, one a session."""
    return parts.groupBy("session_id").agg(F.sum("processed").alias("processed"), F.sum("events").alias("events"), F.min("first").alias("first"), F.max("last").alias("last"))


def counts_of_parts(parts: DataFrame) -> DataFrame:
    seconds = (F.unix_micros("last") - F.unix_micros("first")) / 1e6
    return added(parts).select("session_id", "processed", "events", seconds.alias("seconds"))


def progress_counts(events: DataFrame) -> DataFrame:
    """Per session_id: processed (finished leads' events), events, duration in seconds."""
    return counts_of_parts(count_parts(events))


def apply_state(leads: DataFrame, folded: DataFrame, key: str = "lead_id") -> DataFrame:
    """Leads with the folded columns where there are any."""
    new = [c for c in folded.columns if c != key]
    renamed = folded.select(F.col(key).alias("__lead"), *(F.col(c).alias(f"__{c}") for c in new))
    df = leads.join(renamed, F.col("id") == F.col("__lead"), "left")
    there = F.col("__lead").isNotNull()
    return df.withColumns({c: F.when(there, F.col(f"__{c}")).otherwise(F.col(c) if c in leads.columns else F.lit(None)) for c in new}).drop("__lead", *(f"__{c}" for c in new))


def rescore_reset(leads: DataFrame, scores: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Status events for the chosen leads (id), and the verdicts without theirs."""
    own = leads.join(chosen.select("id"), "id", "left_semi")
    events = own.select(F.col("id").alias("lead_id"), F.lit("RESCORE_PENDING").alias("status"), F.lit(None).cast("string").alias("error"))
    return events, scores.join(own.select(F.col("id").alias("lead_id")), "lead_id", "left_anti")


def rescore(raw: DataFrame, pages: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """New verdicts of raw ones (lead_id, body) against stored pages and, if given, evidence. Leads without stored pages are RESCORE_FAILED with the empty verdict; those whose
    pages hold no text, and that have no evidence, get the empty verdict of leads without content."""
    stored = pages.select("lead_id").distinct().withColumn("__stored", F.lit(True))
    df = raw.join(stored, "lead_id", "left").join(verdicts.site_context(pages), "lead_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    if evidence is not None:
        df = df.join(verdicts.evidence_block(evidence), "lead_id", "left")
    there = F.col("__stored").isNotNull()
    scored = verdicts.finish(df.where(there)).drop("__stored")
    failed = df.where(~there).withColumns(verdicts.empty_verdict(V.NO_PAGES)).withColumns({"parse_failed": F.lit(False), "status": F.lit("RESCORE_FAILED")})
    return scored.unionByName(failed.select(*scored.columns))


def session_settings(events: DataFrame) -> DataFrame:
    """Per session_id the last settings: criteria (a list of text) and batch (a list of ids); text that is no such list gives an empty one."""
    last = events.groupBy("session_id").agg(F.max_by("criteria", F.when(F.col("criteria").isNotNull(), F.col("seq"))).alias("criteria"), F.max_by("batch", F.when(F.col("batch").isNotNull(), F.col("seq"))).alias("batch"))
    parsed = lambda c, kind: F.coalesce(F.from_json(c, kind), F.array().cast(kind))
    return last.select("session_id", parsed("criteria", "array<string>").alias("criteria"), parsed("batch", "array<bigint>").alias("batch"))


def mark_duplicate(lead_ids: DataFrame, of: str = "duplicate_of_id", reason: str = "duplicate_reason") -> DataFrame:
    """Events that mark leads as duplicates by hand."""
    return lead_ids.select(F.col("id").alias("lead_id"), F.lit(1).alias("is_duplicate"), F.col(of).cast("long").alias("duplicate_of_id"), F.col(reason).alias("duplicate_reason"))
