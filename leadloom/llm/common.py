"""What the training-data operators share: written intermediate tables in the shared folder, text pieces, what Python workers keep."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import new_path, shared_dir, stash

__all__ = ["BATCH_BYTES", "bound_batches", "lean", "new_path", "parallelism", "shared_dir", "stash", "stash_bucketed", "word_runs", "worker_cache"]

#: Bytes of text that one Arrow batch hands to a Python worker; bounds a worker's memory when texts are long.
BATCH_BYTES = 8 << 20

_WORD_BREAK = re.compile(rb"[\x20\x09-\x0d]")


def bound_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Bound Arrow batches by bytes as well as by rows, so that a batch of very long texts stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


_kept: dict[str, dict] = {}


def hand_back() -> None:
    """Gives what this process has freed back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def worker_cache(operator: str) -> dict:
    """What this Python worker keeps from task to task for an operator. Workers outlive stages, so what another operator kept goes first."""
    if operator not in _kept:
        _kept.clear()
        hand_back()
    return _kept.setdefault(operator, {})


def lean(operator: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` in a worker that keeps nothing of other operators and hands freed memory back after each batch."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache(operator)
        for batch in run(batches):
            yield batch
            del batch
            hand_back()
        hand_back()

    return of_task


def stash_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """``stash`` in buckets by key: what groups or joins by it later leaves these rows where they are. The catalog's entry is dropped at once; the files stay, as those of ``stash``."""
    spark = df.sparkSession
    path = new_path(spark, name)
    table = f"leadloom_{path.rpartition('/')[2].replace('-', '_')}"
    df.write.bucketBy(buckets, key).option("path", path).saveAsTable(table)
    found = spark.table(table)
    found.schema  # noqa: B018  resolved before its entry goes
    spark.sql(f"DROP TABLE {table}")
    return found


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_runs(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words (runs of bytes other than 0x20 and 0x09-0x0D) of ``data`` in order, in lists from pieces of about ``size`` bytes."""
    if len(data) <= size:
        yield data.split()
        return
    at = 0
    while at < len(data):
        cut = _WORD_BREAK.search(data, min(at + size, len(data)))
        end = cut.start() if cut else len(data)
        yield data[at:end].split()
        at = end if end > at else at + 1
