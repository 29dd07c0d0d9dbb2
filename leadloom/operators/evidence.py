"""Search queries and their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import col, strip, text
from ..functions.urls import contact_name

HITS = "array<struct<url:string,title:string,content:string>>"


def search_queries(leads: DataFrame) -> DataFrame:
    """id, source and query: a query for each lead with a company and each template; those that name a founder only where there is one."""
    company, founder = strip("company_name"), contact_name("first_name", "last_name")
    filled = lambda t: F.replace(F.replace(F.lit(t), F.lit("{company}"), F.col("company")), F.lit("{founder}"), F.col("founder"))
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("source"), filled(t).alias("query"), F.lit("{founder}" in t).alias("needs")) for s, t in V.QUERY_TEMPLATES.items())))
    rows = leads.select("id", company.alias("company"), founder.alias("founder")).where("company <> ''")
    return rows.select("id", "founder", each.alias("q")).where("NOT q.needs OR founder <> ''").select("id", "q.source", "q.query")


def parse_results(df: DataFrame, results: str = "results") -> DataFrame:
    """JSON results to hits (array of url, title, content) and error (of an object with one)."""
    hits = F.when(strip(results).startswith("["), F.from_json(results, HITS))
    error = F.when(strip(results).startswith("{"), F.get_json_object(results, "$.error"))
    return df.withColumns({results: hits, "error": error})


def clean_hits(hits: Column) -> Column:
    """Hits with an address; missing fields are ''."""
    full = F.transform(hits, lambda h: F.struct(text(h["url"]).alias("url"), text(h["title"]).alias("title"), text(h["content"]).alias("content")))
    return F.filter(full, lambda h: h["url"] != "")


def best_profile(hits: Column) -> Column:
    """The first hit that is a company's profile, else the first."""
    company = F.filter(hits, lambda h: F.contains(F.lower(h["url"]), F.lit("/company/")) | F.contains(F.lower(h["content"]), F.lit("/company/")))
    return F.coalesce(F.get(company, F.lit(0)), F.get(hits, F.lit(0)))


def merge_by_source(evidence: DataFrame) -> DataFrame:
    """lead_id, source and all hits of the source in order of id; results that are errors don't count."""
    lists = evidence.where(F.col("results").isNotNull())
    ordered = F.array_sort(F.collect_list(F.struct("id", "results")))
    return lists.groupBy("lead_id", "source").agg(F.flatten(F.transform(ordered, lambda x: x["results"])).alias("results"))


def leads_with_evidence(leads: DataFrame, evidence: DataFrame) -> DataFrame:
    """Leads that are no duplicates and have evidence, with their evidence in order of id."""
    grouped = evidence.groupBy(F.col("lead_id").alias("__lead")).agg(F.array_sort(F.collect_list(F.struct("id", "source", "query", "results", "error"))).alias("evidence"))
    return leads.where(F.coalesce("is_duplicate", F.lit(0)) == 0).join(grouped, F.col("id") == F.col("__lead")).drop("__lead")


def titles(source: Column | str, results: Column | str) -> Column:
    """'source: title | title' of one search; '?' where its source is null."""
    hits = F.coalesce(col(results), F.array().cast(HITS))
    return F.concat(F.coalesce(col(source), F.lit("?")), F.lit(": "), F.array_join(F.transform(hits, lambda h: text(h["title"])), " | "))


def titles_summary(evidence: Column) -> Column:
    """The titles of all searches, joined by ' ||| '."""
    return F.coalesce(F.array_join(F.transform(evidence, lambda e: titles(e["source"], e["results"])), " ||| "), F.lit(""))


def snippet(content: Column, view: bool = False) -> Column:
    """Cut at 500 characters, or, in a view, at 300 with dots."""
    content = text(content)
    return F.when(F.length(content) > 300, F.concat(F.substring(content, 1, 300), F.lit("..."))).otherwise(content) if view else F.substring(content, 1, 500)
