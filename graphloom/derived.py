"""Graphs made from relational tables; each has a DataFrame form and a SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.plans.parts import widen

#: Ids of the two sides of a bipartite graph: even for the first, odd for the second.
_TEXT = {
    "g_cs": "SELECT DISTINCT 2 * o_custkey AS src, 2 * l_suppkey + 1 AS dst FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey",
    "g_ps": "SELECT DISTINCT 2 * l_partkey AS src, 2 * l_suppkey + 1 AS dst FROM {lineitem}",
    "g_pp": "SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey "
    "AND a.l_partkey < b.l_partkey",
    "g_tree": "SELECT CAST(0 AS BIGINT) AS src, CAST(1 + r_regionkey AS BIGINT) AS dst FROM {region} UNION ALL "
    "SELECT CAST(1 + n_regionkey AS BIGINT), CAST(10 + n_nationkey AS BIGINT) FROM {nation} UNION ALL "
    "SELECT CAST(10 + c_nationkey AS BIGINT), 100 + c_custkey FROM {customer}",
    "g_thin": "SELECT DISTINCT 2 * l_partkey AS src, 2 * l_suppkey + 1 AS dst FROM {lineitem} WHERE l_linenumber = 7 AND l_quantity >= 48",
    "g_ev": "SELECT CAST(s AS BIGINT) AS src, CAST(d AS BIGINT) AS dst, CAST(count(*) AS DOUBLE) AS weight FROM ("
    "SELECT length(event_type) * 100 + ascii(event_type) AS s, lead(length(event_type) * 100 + ascii(event_type)) "
    "OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM {events}) AS steps WHERE d IS NOT NULL GROUP BY s, d",
}

TABLES = ("region", "nation", "customer", "orders", "lineitem", "events")

#: The statements over plain table names.
SQL = {name: text.format(**{t: t for t in TABLES}) for name, text in _TEXT.items()}


def edges(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Edge rows of a derived graph; the statements are the same in both engines."""
    text = _TEXT[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text}
    widen(spark, *tables.values())
    return spark.sql(text, **tables)


def graph(spark: SparkSession, sf_dir: str, name: str, directed: bool = False) -> Graph:
    return Graph(edges(spark, sf_dir, name), directed)


def behaviours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vid, behaviour_id, quantity): parts, the suppliers they came from, and how many."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.groupBy(F.col("l_partkey").alias("vid"), F.col("l_suppkey").alias("behaviour_id")).agg(F.sum("l_quantity").cast("long").alias("quantity"))
