"""Queries over leads, sessions and versions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import some, text


def n(c: Column) -> Column:
    """How many rows satisfy a condition (0 for none)."""
    return F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")


def original() -> Column:
    return F.coalesce("is_duplicate", F.lit(0)) == 0


def scan(leads: DataFrame, include_duplicates: bool = True, session_id: int | None = None, sessions: DataFrame | None = None, owner_id: int | None = None) -> DataFrame:
    """Leads, optionally without duplicates, of one session, or of one owner's sessions (a null owner is nobody's). Order by id where it is shown."""
    df = leads if include_duplicates else leads.where(original())
    if session_id is not None:
        df = df.where(F.col("session_id") == session_id)
    if owner_id is not None:
        own = sessions.where(F.col("owner_id") == owner_id).select(F.col("id").alias("session_id"))
        df = df.join(own, "session_id", "left_semi")
    return df


def by_status(leads: DataFrame, status: str) -> DataFrame:
    return leads.where(original() & (F.col("status") == status))


def to_process(leads: DataFrame) -> DataFrame:
    return leads.where(original() & F.col("status").isin(*V.NOT_YET_SCORED))


def latest(rows: DataFrame, key: str, order: Iterable[str]) -> DataFrame:
    """Of each key the row that is greatest by ``order``, then by its other columns. The maximum of a struct is aggregated before the shuffle."""
    order = list(order)
    rest = [c for c in rows.columns if c != key and c not in order]
    best = rows.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("__v"))
    return best.select(key, *(F.col(f"__v.{c}").alias(c) for c in (*order, *rest)))


def with_latest(leads: DataFrame, versions: DataFrame, key: str = "lead_id", order: Iterable[str] = ("id",)) -> DataFrame:
    """Leads with the columns of their latest version (null without one); the version's id isn't kept."""
    order = list(order)
    best = latest(versions, key, order)
    clash = [c for c in best.columns if c in leads.columns and c != key]
    return leads.join(best.drop(*clash).withColumnRenamed(key, "__lead"), F.col("id") == F.col("__lead"), "left").drop("__lead")


def of_leads(rows: DataFrame, leads: DataFrame, key: str = "lead_id") -> DataFrame:
    """The rows (pages, evidence) that belong to the leads."""
    return rows.join(leads.select(F.col("id").alias(key)), key, "left_semi")


def session_overview(sessions: DataFrame, leads: DataFrame, owner_id: int | None = None, limit: int = 50) -> DataFrame:
    """The latest sessions with their counts of leads, duplicates, scored and pending ones."""
    if owner_id is not None:
        sessions = sessions.where(F.col("owner_id") == owner_id)
    newest = sessions.orderBy(F.desc("id")).limit(limit)
    shown = F.broadcast(newest.select(F.col("id").alias("session_id")))  # ``limit`` ids at most
    per = leads.join(shown, "session_id", "left_semi").groupBy(F.col("session_id").alias("__s")).agg(
        F.count_distinct("id").alias("total_leads"),
        n(F.col("is_duplicate") == 1).alias("duplicates"),
        n(F.col("status").isin("SCORED", "LOW_CONFIDENCE")).alias("scored"),
        n(F.col("status") == "NEW").alias("pending"),
    )
    counts = ("total_leads", "duplicates", "scored", "pending")
    return newest.join(per, F.col("id") == F.col("__s"), "left").select(*sessions.columns, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts))


def summary_counters(rows: DataFrame) -> DataFrame:
    """One row over leads with verdicts."""
    status = F.col("status")
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        n(original()).alias("ready"),
        n(~original()).alias("duplicates"),
        n(text("segment") != "").alias("scored"),
        n(F.col("needs_human_review") == 1).alias("needs_review"),
        n(status == "FETCH_FAILED").alias("fetch_failed"),
        n(status == "SCORE_FAILED").alias("score_failed"),
        n(status == "LOW_CONFIDENCE").alias("low_confidence"),
    )


def home_counters(summary: DataFrame) -> DataFrame:
    """to_review counts leads twice that need a review and have low confidence, as the two are shown together."""
    return summary.select((F.col("needs_review") + F.col("low_confidence")).alias("to_review"), (F.col("fetch_failed") + F.col("score_failed")).alias("failures"))


def status_histogram(leads: DataFrame) -> DataFrame:
    return leads.groupBy(F.coalesce(some("status"), F.lit("UNKNOWN")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


CATEGORIES = ("approved", "to_review", "out_of_target", "not_selected", "pending")


def categorize(rows: DataFrame) -> DataFrame:
    """Leads with verdicts and their category; duplicates go, but for those exported before, which are marked."""
    exported = ~original() & F.col("duplicate_of_id").isNull() & F.col("duplicate_reason").eqNullSafe(F.lit(V.ALREADY_EXPORTED))
    status = F.coalesce("status", F.lit("NEW"))
    category = (
        F.when(status == "SKIPPED", "not_selected")
        .when(status.isin(*V.NOT_YET_SCORED), "pending")
        .when(F.coalesce(F.col("needs_human_review").cast("int"), F.lit(0)) != 0, "to_review")
        .when(F.col("segment").isin(*V.TARGET_SEGMENTS), "approved")
        .when(F.col("segment").isin(*V.OUT_OF_TARGET_SEGMENTS), "out_of_target")
        .otherwise("to_review")
    )
    return rows.where(original() | exported).withColumns({"category": category, "already_exported": F.when(exported, 1).otherwise(0)})


def category_summary(rows: DataFrame) -> DataFrame:
    """One row: total and scored over all rows, and a count for each category."""
    there = F.coalesce(F.col("category"), F.lit(""))
    return rows.agg(F.count(F.lit(1)).alias("total"), n(text("segment") != "").alias("scored"), *(n(there == c).alias(c) for c in CATEGORIES))


def ordered_lookup(ids: DataFrame, rows: DataFrame, *by: str, id_list: str = "ids") -> DataFrame:
    """Rows by a stored list of ids, with their place in it (pos), and whose list it is (the columns ``by``): ids without a row are left out, repeated ones repeat."""
    return ids.select(*by, F.posexplode(id_list).alias("pos", "__id")).join(rows, F.col("__id") == F.col("id")).drop("__id")


def dashboard_filter(rows: DataFrame, segments: Iterable[str] = (), review_only: bool = False, hide_duplicates: bool = True) -> DataFrame:
    segments = list(segments)
    if segments:
        rows = rows.where(F.col("segment").isin(*segments))
    if review_only:
        rows = rows.where(F.col("needs_human_review") == 1)
    return rows.where(original()) if hide_duplicates else rows


def segments(rows: DataFrame) -> DataFrame:
    return rows.where("segment <> ''").select("segment").distinct().orderBy("segment")


def rescore_selection(rows: DataFrame) -> DataFrame:
    """Leads that need a review and whose verdict isn't an error of scoring."""
    reason = F.lower(text("disqualify_reason"))
    failed = F.contains(reason, F.lit("api_error")) | F.contains(reason, F.lit("no_content_scraped"))
    due = (F.coalesce("status", F.lit("NEW")) == "LOW_CONFIDENCE") | (F.coalesce(F.col("needs_human_review").cast("int"), F.lit(0)) != 0)
    return rows.where(original() & ~failed & due)


def pending_reset(leads: DataFrame, session_id: int) -> DataFrame:
    return leads.where((F.col("session_id") == session_id) & F.col("status").isin("SKIPPED", "NEW") & original())


def skip_unselected(leads: DataFrame, chosen: DataFrame) -> DataFrame:
    """New leads that aren't chosen (id), with status SKIPPED."""
    return leads.where(original() & (F.col("status") == "NEW")).join(chosen.select("id"), "id", "left_anti").withColumn("status", F.lit("SKIPPED"))


def latest_session(sessions: DataFrame, owner_id: int | None = None) -> DataFrame:
    if owner_id is not None:
        sessions = sessions.where(F.col("owner_id") == owner_id)
    return latest_sessions(sessions, 1)


def latest_sessions(sessions: DataFrame, n: int = 3) -> DataFrame:
    """The newest sessions, which stand beside the home counters."""
    return sessions.orderBy(F.desc("id")).limit(n)


def delete_session(rows: DataFrame, session_id: int, column: str = "session_id") -> DataFrame:
    """A table without a session's rows."""
    return rows.where(~F.col(column).eqNullSafe(F.lit(session_id)))
