"""Contact lists whose quoted fields span lines, read by many tasks.

Where a line of a file begins, a record begins too if the file has an even number of quotes before it. One pass counts the quotes of each split; their running sums say for each split
whether it begins inside a quoted field. A second pass puts the lines of each split together to records. Only what a split has before its first and after its last whole
record goes on, to be joined with its neighbours.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_PIECES = pa.schema([("file", pa.string()), ("split", pa.int64()), ("at", pa.int64()), ("kind", pa.string()), ("text", pa.string())])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the lines of splits (file, split, inside, value), in their order: whole records, and what belongs to records that begin before (``end``: up to where one ends, ``middle``: all
    of the split) or end after (``begin``) their split."""
    where, inside, open_before, at, lines = None, False, False, 0, []
    out: list[tuple] = []

    def rest() -> None:
        nonlocal at
        if lines:
            out.append((*where, at, "middle" if open_before else "begin", "\n".join(lines)))
            lines.clear()

    for batch in batches:
        for file, split, begins_inside, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (file, split) != where:
                rest()
                where, inside, open_before, at = (file, split), begins_inside, begins_inside, 0
            lines.append(line)
            inside ^= line.count('"') % 2 == 1
            if not inside:
                out.append((*where, at, "end" if open_before else "whole", "\n".join(lines)))
                open_before, at = False, at + 1
                lines.clear()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 5, _PIECES.types, strict=True)], schema=_PIECES)
        out.clear()
    rest()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _PIECES.types, strict=True)], schema=_PIECES)


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, split and at (the record's place), text: the records of UTF-8 files, also those that span lines or splits. A quote may stand in quoted fields (doubled) and around them only."""
    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counted = lines.groupBy("file", "split").agg(F.sum(quotes).alias("quotes"))
    before = F.sum("quotes").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    starts = counted.select("file", "split", (F.coalesce(before, F.lit(0)) % 2 == 1).alias("inside"))
    # a row a split, so broadcast; the lines stay in their order
    placed = lines.join(F.broadcast(starts), ["file", "split"]).select("file", "split", "inside", "value")
    pieces = placed.mapInArrow(_pieces, "file string, split long, at long, kind string, text string")
    # at most two pieces of a split aren't whole
    number = F.sum(F.when(F.col("kind") == "begin", 1).otherwise(0)).over(Window.partitionBy("file").orderBy("split", "at"))
    parts = pieces.where("kind <> 'whole'").withColumn("number", number)
    parts = parts.groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("split", "at", "text"))).alias("p"))
    joined = parts.select("file", F.col("p")[0]["split"].alias("split"), F.col("p")[0]["at"].alias("at"), F.array_join(F.col("p.text"), "\n").alias("text"))
    return pieces.where("kind = 'whole'").select("file", "split", "at", "text").unionByName(joined)


def read_split_csv(spark: SparkSession, path: str) -> DataFrame:
    """The contact list as text columns in the order of its files' records, as ``read_contact_csv`` gives them (where a record ends with carriage return and line feed, those within its fields
    become line feeds). Each file begins with the same header."""
    windows = F.col("text").endswith("\r")
    found = records(spark, path).withColumn("text", F.when(windows, F.replace(F.regexp_replace("text", "\r$", ""), F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("text")))
    first = (F.col("split") == 0) & (F.col("at") == 0)
    header = found.where(first).orderBy("file").select("text").first()
    if header is None:
        return spark.createDataFrame([], "empty string").select()
    names = next(csv.reader([header["text"].removeprefix("﻿")], doublequote=True), [])
    columns = ", ".join(f"c{i} string" for i in range(len(names)))
    body = found.where(~first & (F.col("text") != "")).orderBy("file", "split", "at")
    row = F.from_csv("text", columns, {"quote": '"', "escape": '"', "multiLine": "true"})
    return body.select(row.alias("r")).select(*(F.col(f"r.c{i}").alias(name) for i, name in enumerate(names)))
