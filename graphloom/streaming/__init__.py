"""Degree counts over a stream of edge files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def edge_stream(spark: SparkSession, path: str) -> DataFrame:
    """Edges (src, dst) of CSV files as they arrive in a folder."""
    raw = spark.readStream.schema("src long, dst long").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    return raw.where("src is not null and dst is not null")


def running_degrees(edges: DataFrame) -> DataFrame:
    """(vid, out_degree, in_degree) so far, by the same grouped sum as for a table."""
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    ends = F.array(F.struct(F.col("src").alias("vid"), one.alias("o"), zero.alias("i")), F.struct(F.col("dst").alias("vid"), zero.alias("o"), one.alias("i")))
    return edges.select(F.explode(ends).alias("e")).groupBy("e.vid").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))
