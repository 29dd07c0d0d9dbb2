"""Report tables and their CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import col, joined, label, some, text
from . import pages as P
from .evidence import HITS, snippet, titles
from .leads import CATEGORIES, original, with_latest

SIGNAL_COLUMNS = ("generator_fingerprint", "generator_meta_tag", "trend_fonts", "visual_patterns", "build_tool_phrases", "repo_url", "repo_check", "style_phrases", "style_density", "disclosures")


def _cell(df: DataFrame, c: str) -> Column:
    """A report cell: lists joined, objects as JSON, '' for null or a missing column."""
    if c not in df.columns:
        return F.lit("").alias(c)
    kind = df.schema[c].dataType.simpleString()
    value = joined(c) if kind.startswith("array") else text(F.to_json(c)) if kind.startswith("struct") else F.coalesce(F.col(c).cast("string"), F.lit(""))
    return value.alias(c)


def page_report(leads: DataFrame, pages: DataFrame, signals: DataFrame) -> DataFrame:
    """A row a lead and page with the lead's latest signals; a lead without pages has one row. The error is the lead's last one."""
    content = pages.select(F.col("lead_id").alias("__lead"), F.col("source").alias("page_source"), F.col("url").alias("page_url"), "content")
    df = with_latest(leads, signals).join(content, F.col("id") == F.col("__lead"), "left")
    head = [F.col("id").alias("lead_id"), *(_cell(df, c) for c in ("company_name", "website_url", "status")), text("last_error").alias("error")]
    page = [text("page_source").alias("source"), text("page_url").alias("url"), F.length(text("content")).cast("long").alias("content_chars"), text("content").alias("content")]
    return df.select(*head, *page, *(_cell(df, c) for c in SIGNAL_COLUMNS))


SCORE_COLUMNS = ("segment", "confidence", "needs_human_review", "company_stage", "recommended_offer", "disqualify_reason", "built_with_ai_signals", "technical_signals", "pain_signals", "evidence_quotes", "personalization_hooks", "scored_at")


def score_report(rows: DataFrame) -> DataFrame:
    """A row a lead (duplicates and unscored ones too) with its latest verdict."""
    lead = [_cell(rows, c) for c in ("first_name", "last_name", "title", "company_name", "email", "website_url", "status")]
    return rows.select(F.col("id").alias("lead_id"), *lead, (text("last_error") if "last_error" in rows.columns else F.lit("")).alias("error"), F.coalesce("is_duplicate", F.lit(0)).alias("is_duplicate"), _cell(rows, "duplicate_reason"), *(_cell(rows, c) for c in SCORE_COLUMNS))


def readable_report(rows: DataFrame, pages: DataFrame, signals: DataFrame, evidence: DataFrame, n: int = 400) -> DataFrame:
    """A row a lead with short previews of its pages."""
    short = pages.select(F.col("lead_id").alias("__site"), "id", "source", P.preview("content", n).alias("preview"))  # texts are cut before the shuffle
    wide = short.groupBy("__site").pivot("source", list(V.SOURCES)).agg(F.max_by("preview", "id"))
    wide = wide.select("__site", *(F.col(s).alias(f"{s}_preview") for s in V.SOURCES))
    named = evidence.select(F.col("lead_id").alias("__ev"), "id", "source", titles("source", "results").alias("titles"))  # contents of hits stay out of the shuffle
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("id", "source", "titles"))), lambda x: x["titles"])
    found = named.groupBy("__ev").agg(F.array_join(ordered, " ||| ").alias("search_evidence"))
    df = with_latest(rows, signals.withColumn("has_signals", F.lit(True)))
    df = df.join(wide, F.col("id") == F.col("__site"), "left").join(found, F.col("id") == F.col("__ev"), "left")
    check = P.repo_summary(F.col("repo_check")) if "repo_check" in df.columns else F.lit("")
    previews = [F.coalesce(f"{s}_preview", F.lit("(page not found / not scraped)")).alias(f"{s}_preview") for s in ("homepage", "about", "product", "pricing", "careers")]
    return df.select(
        F.col("id").alias("lead_id"),
        *(_cell(df, c) for c in ("company_name", "website_url", "status", "segment", "confidence", "needs_human_review", "recommended_offer", "disqualify_reason")),
        P.signals_summary(F.coalesce("has_signals", F.lit(False))).alias("signals_summary"),
        check.alias("repo_check_summary"),
        *previews,
        *(_cell(df, c) for c in ("evidence_quotes", "personalization_hooks")),
        text("search_evidence").alias("search_evidence"),
    )


def search_report(leads: DataFrame, evidence: DataFrame) -> DataFrame:
    """A row a hit of leads that are no duplicates, and one for each error."""
    own = leads.where(original()).select("id", text("company_name").alias("company_name"), text("website_url").alias("website_url"))
    rows = own.join(evidence.select("lead_id", "source", "query", "results", "error"), F.col("id") == F.col("lead_id"))
    head = [F.col("lead_id"), "company_name", "website_url", text("source").alias("source"), text("query").alias("query")]
    hits = rows.select(*head, F.explode(F.col("results").cast(HITS)).alias("h"))
    hits = hits.select("lead_id", "company_name", "website_url", "source", "query", text("h.url").alias("result_url"), text("h.title").alias("result_title"), snippet(F.col("h.content")).alias("result_snippet"))
    errors = rows.where("results IS NULL AND error IS NOT NULL").select(*head, F.lit("").alias("result_url"), F.lit("ERROR").alias("result_title"), F.col("error").alias("result_snippet"))
    return hits.unionByName(errors)


def category_report(categorized: DataFrame) -> DataFrame:
    """Leads of all categories but the pending ones, with the category's place in the report, ordered by that and id."""
    rank = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category")).cast("int")
    columns = [c for c in ("company_name", "website_url", "segment", "confidence", "company_stage", "recommended_offer", "status", "disqualify_reason") if c in categorized.columns]
    return categorized.where("category <> 'pending'").select(rank.alias("rank"), "category", "id", *columns).orderBy("rank", "id")


def segment_label(c: Column | str) -> Column:
    return label(col(c), V.SEGMENT_LABELS, F.coalesce(some(c), F.lit("Not evaluated")))


def offer_label(c: Column | str) -> Column:
    return label(col(c), V.OFFER_LABELS, F.lit("—"))


def status_label(c: Column | str) -> Column:
    return label(col(c), V.STATUS_LABELS, F.coalesce(some(c), F.lit("—")))


def confidence_band(c: Column | str) -> Column:
    c = col(c)
    return F.when(c.isNull(), "muted").when(c >= V.CONFIDENCE_THRESHOLD, "success").when(c < V.CONFIDENCE_CAP, "danger").otherwise("warning")


def shown_time(c: Column | str) -> Column:
    """'3 Feb 2024, 07:05'; text that is no time as it is; '' for null."""
    c = col(c).cast("string")
    return F.when(text(c) == "", "").otherwise(F.coalesce(F.date_format(F.try_to_timestamp(c), "d MMM yyyy, HH:mm"), c))


def reason_text(status: Column, reason: Column, last_error: Column | None = None, n: int = 160) -> Column:
    """A lead's reason (a pending one's last error first), else its status label, cut at a word's end; up to 5 characters more are left."""
    first = [some(last_error)] if last_error is not None else []
    whole = F.coalesce(*first, some(reason), status_label(status))
    cut = F.substring(whole, 1, n - 3)
    cut = F.when(F.contains(cut, F.lit(" ")), F.regexp_replace(cut, r" [^ ]*$", "")).otherwise(cut)
    return F.when(F.length(whole) <= n + 5, whole).otherwise(F.concat(cut, F.lit("...")))


def error_class(c: Column | str) -> Column:
    """quota, rate_limit, connection, malformed_json or other; null for no error."""
    low = F.lower(text(c))
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    return F.when(low == "", F.lit(None)).when(has(V.QUOTA_PHRASES), "quota").when(has(V.RATE_LIMIT_PHRASES), "rate_limit").when(has(V.CONNECTION_PHRASES), "connection").when(has(("json",)), "malformed_json").otherwise("other")


def retry_after(c: Column | str) -> Column:
    """Seconds to wait, one more than an error says."""
    return F.regexp_extract(text(c), r"(?i)retry after\s+([\d.]+)\s*s", 1).try_cast("double") + 1


def error_report(rows: DataFrame, error: str = "last_error") -> DataFrame:
    classed = rows.select(error_class(error).alias("class"), retry_after(error).alias("wait")).where(F.col("class").isNotNull())
    return classed.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.max("wait").alias("max_wait"))


def write_csv(df: DataFrame, path: str, order: list[str] | None = None, mode: str = "errorifexists") -> None:
    """CSV with a header and doubled quotes, written in parallel; ordered across files if ``order`` is given."""
    (df.orderBy(*order) if order else df).write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
