"""Operator 3: a content-addressed WARC archive.

Writing makes two tables. ``payloads`` has each payload's bytes once, under its SHA-256; ``records`` has each record's
exact header block (WARC/1.1 lines with CRLF), the HTTP head of its block, its record id and its payload's digest. Of records with equal payloads of
at least ``min_bytes`` the one with the smallest page id is a response, the others are revisits that refer to it (with an empty block);
records with smaller payloads are all responses. Reading joins the two, puts the records together, and takes every field from the record's own
bytes: the header to its blank line, the block by its length, the payload behind the HTTP head; a revisit's payload is the stored one.

Digests are verified: one digest whose payloads differ in length or in a second, unrelated hash stops the write,
and reading recomputes the digest of the bytes. Only digests and ids are grouped; page bytes are shuffled once, by
digest and id, so that copies of one payload don't meet in one task (rows equal in both are combined before the shuffle); the reading join is between two written tables
and Spark may split its hot digests.

Rows: a null payload is empty; a null url is '', and line ends in urls are percent-escaped; rows without an id become responses (or, if another row has the payload,
revisits) with an empty record id; rows that repeat the smallest id of their payload are responses, all of them; an empty
table gives two empty tables. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path

CRLF = "\r\n"


def _header(fields: list[tuple[str, Column | str, Column | None]]) -> Column:
    lines = []
    for name, value, when in fields:
        value = F.lit(value) if isinstance(value, str) else value
        line = F.concat(F.lit(f"{name}: "), F.coalesce(value, F.lit("")), F.lit(CRLF))
        lines.append(line if when is None else F.when(when, line).otherwise(""))
    return F.concat(F.lit(f"WARC/1.1{CRLF}"), *lines, F.lit(CRLF))


def write_archive(pages: DataFrame, path: str, min_bytes: int = 100, id_col: str = "page_id", url: str = "url", html: str = "html", at: str | None = None) -> None:
    """Write the tables ``path``/payloads and ``path``/records. ``at``: the time of the capture (yyyy-MM-ddTHH:mm:ssZ; default: now)."""
    keyed = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    keyed = keyed.select("page_id", "url", "payload", F.sha2("payload", 256).alias("digest"), F.length("payload").cast("long").alias("bytes"))
    facts = keyed.select("page_id", "digest", "bytes", F.xxhash64("payload").alias("check"), F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A").alias("url"))
    facts.write.parquet(f"{path}/facts")
    facts = pages.sparkSession.read.parquet(f"{path}/facts")
    firsts = facts.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"), (F.min("check") != F.max("check")).alias("clash"), (F.min("bytes") != F.max("bytes")).alias("clash_bytes"))
    firsts = firsts.withColumn("first_id", F.when(F.col("clash") | F.col("clash_bytes"), F.raise_error(F.concat(F.lit("payloads differ under digest "), "digest"))).otherwise(F.col("first_id"))).select("digest", "first_id", "n")
    firsts.write.parquet(f"{path}/firsts")
    firsts = pages.sparkSession.read.parquet(f"{path}/firsts")

    # joined by one column, so that repeated rows are dropped on the way there
    place = lambda page: F.concat_ws(":", "digest", F.coalesce(F.col(page).cast("string"), F.lit("")))
    stored = keyed.select("digest", "payload", place("page_id").alias("place")).dropDuplicates(["place"]).join(firsts.select(place("first_id").alias("place")), "place")
    stored.select("digest", "payload").write.parquet(f"{path}/payloads")

    shared = (F.col("n") > 1) & (F.col("bytes") >= min_bytes)
    again = shared & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    record_id = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    records = facts.join(firsts, "digest").withColumn("again", again)
    records = records.withColumn("http", F.when(F.col("again"), "").otherwise(http))
    header = _header(
        [
            ("WARC-Type", F.when(F.col("again"), "revisit").otherwise("response"), None),
            ("WARC-Record-ID", record_id, None),
            ("WARC-Target-URI", F.coalesce("url", F.lit("")), None),
            ("WARC-Date", F.lit(at) if at else now, None),
            ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest"), None),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", F.col("again")),
            ("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("first_id").cast("string"), F.lit("")), F.lit(">")), F.col("again")),
            ("Content-Type", "application/http;msgtype=response", ~F.col("again")),
            ("Content-Length", F.when(F.col("again"), F.lit("0")).otherwise((F.col("bytes") + F.length("http")).cast("string")), None),
        ]
    )
    records.select(record_id.alias("record_id"), "digest", header.alias("header"), "http").write.parquet(f"{path}/records")


def _to_blank_line(data: Column) -> Column:
    """What stands before the first blank line, and that, as text; '' if there is none."""
    text = F.decode(data, "UTF-8")
    at = F.instr(text, CRLF + CRLF)
    return F.when(at > 0, F.substr(text, F.lit(1), at + 3)).otherwise("")


def _field(header: Column, name: str) -> Column:
    return F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)", 1)


def parse_record(df: DataFrame, record: str = "record") -> DataFrame:
    """Adds what a WARC record's bytes say: page_id, url, record_type, refers_to, payload_digest, date, header, body (the payload within the block; empty in a revisit)."""
    df = df.withColumn("header", _to_blank_line(F.col(record)))
    field = lambda name: _field(F.col("header"), name)
    page = lambda name: F.nullif(F.regexp_extract(field(name), "^<urn:page:(-?[0-9]*)>$", 1), F.lit("")).cast("long")
    df = df.withColumn("__block", F.substr(record, F.octet_length("header") + 1, field("Content-Length").cast("int")))
    body = F.substr("__block", F.octet_length(_to_blank_line(F.col("__block"))) + 1, F.octet_length("__block"))
    return df.withColumns({
        "page_id": page("WARC-Record-ID"),
        "url": field("WARC-Target-URI"),
        "record_type": field("WARC-Type"),
        "refers_to": page("WARC-Refers-To"),
        "payload_digest": F.regexp_extract(field("WARC-Payload-Digest"), "^sha256:([0-9a-f]+)$", 1),
        "date": field("WARC-Date"),
        "body": F.when(field("Content-Type").startswith("application/http"), body).otherwise(F.col("__block")),
    }).drop("__block")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archive: page_id, url, record_type, refers_to, payload_digest, date, payload (full bytes, revisits too), header, and
    ``record``, the WARC record (header block, block, closing CRLFs)."""
    records, payloads = spark.read.parquet(f"{path}/records"), spark.read.parquet(f"{path}/payloads")
    whole = records.join(payloads, "digest")
    block = F.when(F.col("http") == "", F.lit(b"")).otherwise(F.concat(F.encode("http", "UTF-8"), "payload"))
    whole = whole.select(F.concat(F.encode("header", "UTF-8"), block, F.lit(b"\r\n\r\n")).alias("record"), F.col("payload").alias("stored"))
    read = parse_record(whole)
    read = read.withColumn("payload", F.when(F.col("record_type") == "revisit", F.col("stored")).otherwise(F.col("body")))
    good = F.sha2("payload", 256) == F.col("payload_digest")
    payload = F.when(good, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("bytes don't have digest "), "payload_digest")).cast("binary"))
    return read.select("page_id", "url", "record_type", "refers_to", "payload_digest", "date", payload.alias("payload"), "header", "record")


def archive(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write an archive of ``pages`` (in the shared folder, if no path is given) and read it back."""
    path = path or new_path(pages.sparkSession, "warc")
    write_archive(pages, path, **options)
    return read_archive(pages.sparkSession, path)
