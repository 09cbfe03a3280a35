"""What the training-data operators share: reading, word splitting, Arrow batches."""

from __future__ import annotations

import zlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch: a batch of the longest texts still fits a Python worker.
BATCH_ROWS = 256

#: A-Z to a-z; the six white-space bytes 09-0D and 20 are what bytes.split() cuts at.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows of an Arrow batch of this session from above."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def utf8(text: str | None) -> bytes:
    """UTF-8 bytes; null is the empty text."""
    return text.encode("utf-8", "surrogatepass") if text else b""


def crc_bucket(doc_id: Column, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``; null ids have no bucket."""
    return F.crc32(doc_id.cast("string").cast("binary")) % buckets


def crc_of(values: Iterable[object]) -> list[int]:
    """The same checksum in Python, for tests."""
    return [zlib.crc32(str(v).encode()) for v in values]
