"""Result files: CSV parts, gzip by default; what the path held before is replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, gzip: bool = True, columns: list[str] | None = None, single_file: bool = False) -> None:
    """Rows as ``a,b,c``; arrays are joined by ':'.  ``single_file`` is for small results."""
    cols = [F.array_join(F.transform(c, lambda v: v.cast("string")), ":").alias(c) if t.startswith("array") else F.col(c) for c, t in df.select(*(columns or df.columns)).dtypes]
    out = df.select(*cols)
    (out.coalesce(1) if single_file else out).write.mode("overwrite").option("compression", "gzip" if gzip else "none").csv(path)


def write_shells(shells: DataFrame, path: str, gzip: bool = True) -> None:
    """(coreness, src, dst) as one folder ``coreness=<k>`` for each k."""
    shells.write.mode("overwrite").partitionBy("coreness").option("compression", "gzip" if gzip else "none").csv(path)


def write_paths(lines: DataFrame, path: str, gzip: bool = True) -> None:
    """One text line per row of a column ``value``."""
    lines.select("value").write.mode("overwrite").option("compression", "gzip" if gzip else "none").text(path)
