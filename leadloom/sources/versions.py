"""Tables that grow by a folder a batch.

A batch writes ``batch=n``, which a batch that is run again replaces. Now and then a batch first writes ``base=n``, all that came before it in one folder, so that a reader takes
the newest whole base and the few batches after it, however many there were. Bases grow further apart up to ``EVERY`` batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

EVERY = 32


def due(number: int) -> bool:
    """Whether the batch of this number writes a base: 1, 2, 4 and so on, then each that ``EVERY`` divides."""
    return number > 0 and (number % EVERY == 0 or number & (number - 1) == 0)


def _path(spark: SparkSession, folder: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def numbers(spark: SparkSession, path: str, kind: str = "batch") -> list[int]:
    """The numbers of the whole folders of a kind, in order."""
    at, files = _path(spark, f"{path.rstrip('/')}/{kind}=*/_SUCCESS")
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in files.globStatus(at) or [])


def folders(spark: SparkSession, path: str, before: int | None = None) -> list[str]:
    """The newest base, and the batches after it; only of what came before a batch, if ``before`` is given."""
    fits = lambda n: before is None or n <= before
    base = max(filter(fits, numbers(spark, path, "base")), default=None)
    batches = [n for n in numbers(spark, path, "batch") if (base is None or n >= base) and (before is None or n < before)]
    return [f"{path.rstrip('/')}/{kind}={n}" for kind, n in [*([("base", base)] if base is not None else []), *(("batch", n) for n in batches)]]


def read(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """The table's rows; none if nothing was written."""
    found = folders(spark, path, before)
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def write(rows: DataFrame, path: str, number: int, kind: str = "batch") -> None:
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{kind}={number}")


def compact(spark: SparkSession, path: str, schema: str, number: int, fold: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
    """Writes the base of a batch, folded, if one is due and not there. What is older than the base before it goes; that one stays for those who read it now."""
    older = numbers(spark, path, "base")
    if not due(number) or number in older:
        return
    older = [n for n in older if n < number]
    write(fold(read(spark, path, schema, number)), path, number, "base")
    for kind in ("batch", "base"):
        for n in numbers(spark, path, kind):
            if older and n < older[-1]:
                at, files = _path(spark, f"{path.rstrip('/')}/{kind}={n}")
                files.delete(at, True)
