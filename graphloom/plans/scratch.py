"""Intermediate tables in the folder that driver and executors share.

Iterative operators cut lineage by writing a small Parquet table and reading it
again.  The folder is the session's ``spark.checkpoint.dir``; only when the
session has none (unit tests, notebooks) a temporary one is made, which is right
for a single machine and nothing else.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: list[str] = []
_RUNS: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The shared folder of this session, without a trailing slash."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append("file://" + tempfile.mkdtemp(prefix="graphloom-"))
    return _LOCAL_ROOT[0]


class Scratch:
    """Tables of one operator run; those no longer needed can be dropped early."""

    def __init__(self, spark: SparkSession, label: str = "run"):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        _RUNS.append(self.root)

    def save(self, df: DataFrame, **options: str) -> DataFrame:
        """Write ``df``, with these options of the writer, and return the written table (lineage ends here)."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # kept with the frame, so drop() can find it
        return out

    def release(self) -> None:
        """Have the driver forget finished plans, so that Spark's cleaner deletes their shuffle files now, not when memory runs low."""
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *frames: DataFrame | None) -> None:
        """Delete the files of tables returned by save()."""
        for df in frames:
            path = getattr(df, "_scratch_path", None)
            if path:
                delete_path(self.spark, path)


def clean(spark: SparkSession) -> None:
    """Delete all run folders that this process has made; for when results are written and no frame of them is read again."""
    while _RUNS:
        delete_path(spark, _RUNS.pop())


def delete_path(spark: SparkSession, path: str) -> None:
    """Recursively delete through Hadoop's file system layer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
