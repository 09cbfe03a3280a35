"""Readers of edge and vertex files: CSV, gzip by suffix, one file or a folder, any file system Spark reads.

Fields are trimmed, empty lines and rows without a valid src or dst are skipped, columns after
the payload are ignored.  Ids that are no number are skipped too (some programs read them as 0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Payload types and the Spark types that hold them (unsigned 64-bit values need a decimal).
PAYLOADS = {
    "float": "float",
    "double": "double",
    "uint8": "short",
    "uint16": "int",
    "uint32": "long",
    "int64": "long",
    "uint64": "decimal(20,0)",
}
_MOST = {"uint8": 2**8 - 1, "uint16": 2**16 - 1, "uint32": 2**32 - 1, "uint64": 2**64 - 1}


def decode(field: Column, payload: str) -> Column:
    """A text field as its type; null if it is none, or out of range."""
    value = F.trim(field).try_cast(PAYLOADS[payload])
    return F.when((value >= 0) & (value <= F.lit(_MOST[payload]).cast("decimal(20,0)")), value) if payload in _MOST else value


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "")


def load_edges(spark: SparkSession, path: str, payload: str | None = None, default: float | None = None) -> DataFrame:
    """(src, dst[, weight]); with a payload, rows without a valid one are skipped, or get the default."""
    part = F.split("value", ",")
    cols = [F.trim(F.get(part, i)).try_cast("long").alias(c) for i, c in ((0, "src"), (1, "dst"))]
    if payload:
        w = decode(F.get(part, 2), payload)
        cols.append((w if default is None else F.coalesce(w, F.lit(default))).alias("weight"))
    out = _lines(spark, path).select(*cols).where("src is not null and dst is not null")
    return out.where("weight is not null") if payload else out


def load_vertices(spark: SparkSession, path: str, payload: str | None = None) -> DataFrame:
    """(vid, value): all after the first comma is the value; decoded if a payload type is given, else text."""
    part = F.split("value", ",", 2)
    value = F.trim(F.get(part, 1))
    out = _lines(spark, path).select(F.trim(F.get(part, 0)).try_cast("long").alias("vid"), (decode(value, payload) if payload else value).alias("value"))
    return out.where("vid is not null and value is not null" if payload else "vid is not null")


def load_lists(spark: SparkSession, path: str, separator: str = ":") -> DataFrame:
    """(vid, items) of lines ``vid,a:b:c``; items that are no number are skipped."""
    import re

    raw = F.split("value", re.escape(separator))
    items = F.filter(F.transform(raw, lambda x: F.trim(x).try_cast("long")), lambda x: x.isNotNull())
    return load_vertices(spark, path).select("vid", F.coalesce(F.when(F.coalesce("value", F.lit("")) != "", items), F.array().cast("array<bigint>")).alias("items"))


def load_behaviours(spark: SparkSession, path: str, sums: int = 0) -> DataFrame:
    """(vid, behaviour_id, s1..sk) of lines split by commas, blanks or tabs; short lines are skipped."""
    part = F.split(F.trim("value"), r"[,\s]+")
    names = ["vid", "behaviour_id", *(f"s{i + 1}" for i in range(sums))]
    out = _lines(spark, path).select(*(F.get(part, i).try_cast("long").alias(n) for i, n in enumerate(names)))
    return out.where(" and ".join(f"{n} is not null" for n in names))


def parse_libsvm(vertices: DataFrame, size: int | None = None) -> DataFrame:
    """(vid, label, features) of values ``label index:value ...`` with indices from 0.

    Sparse features are array<struct<index, value>>; with ``size`` they are dense, zero-filled.
    """
    part = F.split(F.trim("value"), r"\s+")
    cells = F.transform(F.slice(part, 2, F.greatest(F.size(part) - 1, F.lit(0))), lambda c: F.struct(F.split(c, ":")[0].try_cast("int").alias("index"), F.get(F.split(c, ":"), 1).try_cast("float").alias("value")))
    out = vertices.select("vid", F.get(part, 0).try_cast("int").alias("label"), F.filter(cells, lambda c: c["index"].isNotNull() & c["value"].isNotNull()).alias("features")).where("label is not null")
    if size is None:
        return out
    by = F.map_from_entries(F.filter("features", lambda c: c["index"] < size))
    dense = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at(F.col("by"), i), F.lit(0.0).cast("float")))
    return out.withColumn("by", by).select("vid", "label", dense.alias("features"))
