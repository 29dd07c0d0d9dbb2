"""Streams: progress of sessions and its counts, and intake of contact lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import ingest
from ..operators.known_keys import resolve_batch
from ..operators.leads import latest
from ..operators.state import PARTS, added, count_parts, counts_of_parts, latest_progress
from ..sources import versions

PROGRESS = "session_id long, seq long, lead_id long, step string, status string, error string, ts timestamp"
LAST = "session_id long, seq long, lead_id long, step string, status string, error string"


def progress_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(PROGRESS).parquet(path)


def follow_progress(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each session's last event, as versions under ``path``: a trigger writes the sessions that changed; nothing is sent to the driver, and the state is one row a session. A trigger that is
    run again replaces its own rows."""
    newest = lambda rows: latest(rows, "session_id", ["seq"])

    def write(batch: DataFrame, number: int) -> None:
        versions.compact(batch.sparkSession, path, LAST, number, newest)
        versions.write(batch, path, number)

    return latest_progress(events).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_progress(spark: SparkSession, path: str) -> DataFrame:
    """Of the versions that ``follow_progress`` wrote, each session's newest. As a session's last event only moves on, that is the one with the largest number."""
    return latest(versions.read(spark, path, LAST), "session_id", ["seq"])


def follow_counts(events: DataFrame, path: str, checkpoint: str, late: str = "1 day") -> StreamingQuery:
    """Counts of progress events, for ``current_counts``. An event (session_id, seq) that comes again within ``late`` of its time counts once; older events than that, behind the newest seen, are left out, so that the
    state holds the events of that time only. A trigger writes sums of its own events for each session, which add up in any order."""

    def write(batch: DataFrame, number: int) -> None:
        versions.compact(batch.sparkSession, path, PARTS, number, added)
        versions.write(count_parts(batch), path, number)

    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["session_id", "seq"])
    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_counts(spark: SparkSession, path: str) -> DataFrame:
    """``progress_counts`` of all events that ``follow_counts`` took in."""
    return counts_of_parts(versions.read(spark, path, PARTS))


def intake_stream(spark: SparkSession, folder: str, header: list[str]) -> DataFrame:
    """New CSV files of a folder, all with the given header."""
    return spark.readStream.schema(", ".join(f"`{h}` string" for h in header)).csv(folder, header=True, multiLine=True, quote='"', escape='"')


def take_in(stream: DataFrame, leads_path: str, session_id: int, checkpoint: str, threshold: int | None = 90, known_path: str | None = None, after: int = 0) -> StreamingQuery:
    """Each batch of contacts is ingested, checked for duplicates against the session's originals so far (which aren't decided again), and added to ``leads_path``, stored by session and batch. What is
    known of the originals (keys, an index of names, the last id) is kept under ``known_path`` (``leads_path`` and "-known" unless given), stored by session too; no batch reads earlier leads. Ids
    begin after ``after``. A batch that is run again replaces its own rows."""
    known = f"{(known_path or leads_path.rstrip('/') + '-known').rstrip('/')}/session_id={int(session_id)}"

    def add(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        last = versions.read(spark, f"{known}/last", "id long", number).agg(F.max("id")).first()[0]
        fresh = ingest(batch, session_id, f"batch-{number}", after if last is None else last)
        found = resolve_batch(fresh, known, number, threshold)
        out = fresh.drop("is_duplicate", "duplicate_of_id", "duplicate_reason", "session_id").join(found, "id")
        out.write.mode("overwrite").parquet(f"{leads_path.rstrip('/')}/session_id={int(session_id)}/batch_number={number}")
        top = lambda rows: rows.agg(F.max("id").alias("id")).where("id IS NOT NULL")
        versions.compact(spark, f"{known}/last", "id long", number, top)
        versions.write(top(found), f"{known}/last", number)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
