"""Views that turn the driver's tables into leads, pages, verdicts, sessions and events. One text for Spark and DuckDB."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession

TABLES = ("customer", "documents", "events", "lineitem", "orders", "pages")

SQL = {
    "leads": r"""
        SELECT page_id AS id, page_id % 5 AS session_id,
          CASE WHEN page_id % 17 = 0 THEN '' ELSE url END AS website_url,
          CASE page_id % 4
            WHEN 0 THEN concat('U', page_id % 25, '@gmail.com')
            WHEN 1 THEN concat(' u', page_id % 9, '@', split_part(regexp_replace(replace(replace(lower(url), 'https://', ''), 'http://', ''), '^www[.]', ''), '/', 1))
            WHEN 2 THEN concat('u', page_id % 40, '@other.example.com')
            ELSE '' END AS email,
          regexp_extract(html, '<title>(.*?)</title>', 1) AS company_name
        FROM pages""",
    "pages_marked": r"""
        SELECT page_id, url, concat(html, CASE page_id % 16
            WHEN 0 THEN '<script src="https://cdn.lovable.dev/x.js"></script>'
            WHEN 1 THEN '<meta name="generator" content="v0.dev">'
            WHEN 2 THEN '<div class="bg-gradient-to-r backdrop-blur data-radix-x">'
            WHEN 3 THEN '<p>Built with Cursor, vibe coded</p>'
            WHEN 4 THEN '<link href="/f?family=Space Grotesk|Geist">'
            WHEN 5 THEN '<a href="https://github.com/acme/shop">code</a>'
            WHEN 6 THEN '<p>cutting-edge seamless integration, effortlessly a game-changer</p>'
            WHEN 7 THEN '<p>Frequently asked questions. Peace of mind</p>'
            WHEN 8 THEN '<p>Senior backend engineer, sales, data scientist</p>'
            WHEN 9 THEN '<p>Sign up. $ 19 per month. Book a demo</p>'
            WHEN 10 THEN '<p>Contact us</p>'
            WHEN 11 THEN '<p>404 - page not found</p>'
            WHEN 12 THEN '<a href="/pricing">p</a><a href="/about#team">a</a>'
            WHEN 13 THEN '<p>Written with AI. dive into, elevate your</p>'
            WHEN 14 THEN '<a href="//cdn.example.com/a">c</a><a href="team">t</a><a href="?q=1">q</a><a href="../up">u</a>'
            ELSE '' END) AS html
        FROM pages""",
    "site_pages": r"""
        SELECT page_id AS id,
          split_part(regexp_replace(replace(replace(lower(url), 'https://', ''), 'http://', ''), '^www[.]', ''), '/', 1) AS site,
          CASE page_id % 5 WHEN 0 THEN 'homepage' WHEN 1 THEN 'about' WHEN 2 THEN 'pricing' WHEN 3 THEN 'careers' ELSE 'product' END AS source,
          url, CASE WHEN page_id % 6 = 0 THEN '  Same   shell text repeated on every route of this site  ' ELSE html END AS content
        FROM pages""",
    "raw_verdicts": r"""
        SELECT doc_id AS lead_id, doc_id % 3 AS attempt,
          CASE WHEN doc_id % 31 = 7 THEN 'not json' ELSE concat(
            '{"segment":"', CASE doc_id % 8 WHEN 0 THEN 'ai_solo_founder' WHEN 1 THEN 'technical_founder' WHEN 2 THEN 'small_agency_scaling' WHEN 3 THEN 'too_big' WHEN 4 THEN 'wrong_field' WHEN 5 THEN 'unclear' WHEN 6 THEN 'startup' ELSE 'technical_founder' END,
            '","confidence":', CASE WHEN doc_id % 37 = 3 THEN '"high"' ELSE concat('0.', doc_id % 10) END,
            ',"company_stage":"', CASE doc_id % 5 WHEN 0 THEN 'early' WHEN 1 THEN 'scaling' WHEN 2 THEN 'established' WHEN 3 THEN 'pre-launch' ELSE 'huge' END,
            '","recommended_offer":"', CASE doc_id % 6 WHEN 0 THEN 'ai_audit' WHEN 1 THEN 'general_audit' WHEN 2 THEN 'pipeline' WHEN 3 THEN 'none' WHEN 4 THEN 'none' ELSE 'free_lunch' END,
            '","evidence_quotes":["', upper(regexp_extract(text, '^[A-Za-z ,.]{0,60}', 0)), '"', CASE WHEN doc_id % 4 = 0 THEN ',"zzz not in the text"' WHEN doc_id % 4 = 1 THEN ', 5, true, null, {"a": "1"}' ELSE '' END,
            '],"disqualify_reason":null,"needs_human_review":', CASE doc_id % 11 WHEN 0 THEN '"yes"' WHEN 1 THEN '""' WHEN 2 THEN '0' WHEN 3 THEN '2' WHEN 4 THEN '[]' WHEN 5 THEN 'null' WHEN 6 THEN 'true' ELSE 'false' END, '}') END AS body
        FROM documents""",
    "sessions": r"""
        SELECT c_custkey AS id, c_nationkey AS owner_id, c_name AS label,
          CASE c_mktsegment WHEN 'FURNITURE' THEN 'running' ELSE 'completed' END AS status
        FROM customer""",
    "leads_large": r"""
        SELECT o_orderkey AS id, o_custkey AS session_id,
          CASE WHEN o_orderkey % 19 = 0 THEN 'SKIPPED' WHEN o_orderpriority = '1-URGENT' THEN 'NEW' WHEN o_orderpriority = '2-HIGH' THEN 'LOW_CONFIDENCE' WHEN o_orderpriority = '5-LOW' THEN 'FETCH_FAILED' ELSE 'SCORED' END AS status,
          CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS is_duplicate,
          CASE WHEN o_orderkey % 14 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN o_orderkey - 1 END AS duplicate_of_id,
          CASE WHEN o_orderkey % 14 = 0 THEN 'already_exported_previous_batch' WHEN o_orderkey % 7 = 0 THEN 'domain_match' END AS duplicate_reason
        FROM orders""",
    "scores_large": r"""
        SELECT l_orderkey AS lead_id, l_linenumber AS version, l_partkey, l_suppkey,
          CASE l_suppkey % 7 WHEN 0 THEN 'ai_solo_founder' WHEN 1 THEN 'technical_founder' WHEN 2 THEN 'small_agency_scaling' WHEN 3 THEN 'too_big' WHEN 4 THEN 'wrong_field' WHEN 5 THEN 'unclear' END AS segment,
          l_discount * 10 AS confidence,
          CASE WHEN l_discount < 0.07 THEN 1 ELSE 0 END AS needs_human_review
        FROM lineitem""",
    "progress_events": r"""
        SELECT user_id AS session_id, event_id AS seq, user_id * 1000 + event_id % 50 AS lead_id,
          CASE event_type WHEN 'view' THEN 'scraping' WHEN 'click' THEN 'scraping_done' WHEN 'error' THEN 'scoring' ELSE 'done' END AS step,
          CASE event_type WHEN 'click' THEN 'PARSED' WHEN 'error' THEN 'SCORE_FAILED' WHEN 'signup' THEN 'LOW_CONFIDENCE' WHEN 'purchase' THEN 'SCORED' END AS status,
          CASE WHEN event_type = 'error' THEN 'rate limit, retry after 14s' END AS error, ts
        FROM events""",
    "search_results": r"""
        SELECT doc_id AS id, CAST((doc_id - doc_id % 4) / 4 AS BIGINT) AS lead_id, CASE doc_id % 3 WHEN 0 THEN 'linkedin' WHEN 1 THEN 'github' ELSE 'interviews' END AS source, concat('q', doc_id) AS query,
          CASE WHEN doc_id % 11 = 0 THEN '{"error":"boom"}' ELSE concat('[{"url":"', CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat('https://x.io/', CASE WHEN doc_id % 3 = 0 THEN 'p/' ELSE '' END, doc_id) END,
            '","title":"t', doc_id, '","content":"', regexp_extract(text, '^[A-Za-z ,.]{0,60}', 0), '"},{"url":"https://y.io/company/c","title":"u","content":" "}]') END AS results
        FROM documents""",
    "commits": r"""
        SELECT concat('https://github.com/u', user_id, '/r') AS repo_url, ts, concat(event_type, event_id) AS message FROM events""",
    "reviews": r"""
        SELECT o_custkey AS lead_id, o_orderkey AS seq, CASE o_orderstatus WHEN 'O' THEN 'APPROVED' WHEN 'F' THEN 'REJECTED' ELSE 'OTHER' END AS review_status, CASE WHEN o_orderkey % 3 = 0 THEN 'too_big' END AS review_segment_override, o_orderdate AS reviewed_at
        FROM orders""",
    "session_events": r"""
        SELECT user_id AS session_id, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, CASE WHEN event_type = 'purchase' THEN ts END AS completed_at,
          CASE WHEN event_id % 7 = 0 THEN concat('["c', event_id, '","d"]') WHEN event_id % 7 = 1 THEN 'bad' END AS criteria, CASE WHEN event_id % 5 = 0 THEN concat('[', event_id, ',1]') END AS batch
        FROM events""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view over the tables of a folder."""

    def table(m: re.Match) -> str:
        known = f"driver_{zlib.crc32(sf_dir.encode()):08x}_{m[1]}"
        spark.read.parquet(f"{sf_dir}/{m[1]}.parquet").createOrReplaceTempView(known)
        return f"FROM {known}"

    return spark.sql(re.sub(rf"FROM ({'|'.join(TABLES)})\b", table, SQL[name]))


def with_views(*names: str) -> str:
    """The beginning of a DuckDB query that uses the views."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({SQL[n]})" for n in names)
