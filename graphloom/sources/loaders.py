"""Files to graphs and back: loading with dense ids, and results with the ids of the file again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators.encode import encode
from graphloom.sources.readers import load_edges


def load_graph(spark: SparkSession, path: str, directed: bool = True, payload: str | None = None, default: float | None = None) -> Graph:
    """The graph of an edge file; Graph.info() tells its size."""
    return Graph(load_edges(spark, path, payload, default), directed)


def load_encoded(spark: SparkSession, path: str, directed: bool = True, payload: str | None = None, default: float | None = None) -> tuple[Graph, DataFrame]:
    """The graph over dense ids, and the map (vid, code) for decoded()."""
    return encode(load_graph(spark, path, directed, payload, default))


def decoded(result: DataFrame, codes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A result whose columns of codes have the file's ids again; null stays null."""
    out = result
    for c in columns:
        names = codes.select(F.col("code").alias(c), F.col("vid").alias("__vid"))
        out = out.join(names, c, "left").drop(c).withColumnRenamed("__vid", c)
    return out.select(*result.columns)
