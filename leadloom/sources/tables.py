"""Reading and adding to the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evidence import parse_results
from ..operators.ingest import ingest
from .split_csv import read_split_csv


def read_contact_csv(spark: SparkSession, path: str, spanning: bool = True) -> DataFrame:
    """A contact list as text columns: header row, quoted fields that may span lines, doubled quotes. Here a file whose fields may span lines
    is one task (``read_split_csv`` reads such files in parts); without such fields (``spanning`` False) large files are read in parts."""
    return spark.read.csv(path, header=True, multiLine=spanning, quote='"', escape='"', inferSchema=False, encoding="UTF-8")


def import_contacts(spark: SparkSession, path: str, session_id: int, batch_id: str, after: int = 0, at: str | None = None, split: bool = False) -> DataFrame:
    """``split``: the files are large, and are read in parts."""
    return ingest(read_split_csv(spark, path) if split else read_contact_csv(spark, path), session_id, batch_id, after, at)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("lead_id long, id long, session_id long, source string, url string, content string, html string").parquet(path)


def read_raw_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """Attempts as ``choose_attempt`` takes them: a failed one has the error's text."""
    return spark.read.schema("lead_id long, attempt long, body string, error string").json(path)


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """Search results with their JSON parsed."""
    return parse_results(spark.read.schema("id long, lead_id long, source string, query string, results string").json(path))


def append(rows: DataFrame, leads: DataFrame, path: str, key: str = "lead_id") -> None:
    """Add rows to a table, stamped with their lead's session and stored by it."""
    stamped = rows.drop("session_id").join(leads.select(F.col("id").alias(key), "session_id"), key)
    stamped.write.mode("append").partitionBy("session_id").parquet(path)


#: The tables with rows of leads, each stored by session.
SESSION_TABLES = ("lead_search_evidence", "lead_scores", "lead_technical_signals", "lead_content", "export_history", "leads")


def drop_session(spark: SparkSession, paths: list[str], session_id: int) -> list[str]:
    """Takes a session out of tables that are stored by session, as ``append`` writes them: its folder goes from each, so no row, its own or another's, is read or written. Tables without
    it stay as they are. Returns the folders that went; a call that was broken off can be made again."""
    gone = []
    for path in paths:
        folder = f"{path.rstrip('/')}/session_id={int(session_id)}"
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True):
            gone.append(folder)
    return gone


def delete_session_tables(spark: SparkSession, root: str, session_id: int) -> list[str]:
    """A session goes from all tables of leads under ``root``, and from what intake knows of it, the leads last, so that what is left after a failure still has its leads."""
    return drop_session(spark, [f"{root.rstrip('/')}/{t}" for t in ("leads-known", *SESSION_TABLES)], session_id)
