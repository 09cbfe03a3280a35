"""Vertex subsets and keyed state as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("vid").unionByName(b.select("vid")).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("vid").distinct().join(b.select("vid").distinct(), "vid", "left_semi")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("vid").distinct().join(b.select("vid").distinct(), "vid", "left_anti")


def size_and_last(a: DataFrame) -> DataFrame:
    """One row: members, greatest id."""
    return a.select("vid").distinct().agg(F.count("*").alias("members"), F.max("vid").alias("last"))


def total(state: DataFrame, value: Column, active: DataFrame | None = None) -> DataFrame:
    """One row: the sum of a value over the (active) vertices, 0 if there are none."""
    if active is not None:
        state = state.join(active.select("vid").distinct(), "vid", "left_semi")
    return state.agg(F.coalesce(F.sum(value), F.lit(0)).alias("total"))


def fill(vertices: DataFrame, value: object, column: str = "value") -> DataFrame:
    """(vid, value): every vertex with the same value."""
    return vertices.select("vid").withColumn(column, F.lit(value))


def upsert(state: DataFrame, new: DataFrame, how: str = "last", column: str = "value") -> DataFrame:
    """(vid, value): new values reduced into the state per key; how: min, max, sum, or last (the new one wins)."""
    both = state.select("vid", column, F.lit(0).alias("age")).unionByName(new.select("vid", column, F.lit(1).alias("age")))
    reduce = {"min": F.min(column), "max": F.max(column), "sum": F.sum(column), "last": F.max_by(column, F.struct("age", column))}[how]
    return both.groupBy("vid").agg(reduce.alias(column))


def update_if(state: DataFrame, new: DataFrame, better: Column, column: str = "value") -> DataFrame:
    """(vid, value): a known key takes the new value where ``better`` holds, an expression over ``old`` and ``new`` (compare and swap).

    Keys that the state lacks are ignored; of several new values of a key the least is tried.
    """
    tried = new.groupBy("vid").agg(F.min(column).alias("new"))
    both = state.select("vid", F.col(column).alias("old")).join(tried, "vid", "left")
    return both.select("vid", F.when(F.col("new").isNotNull() & better, F.col("new")).otherwise(F.col("old")).alias(column))


def insert_missing(state: DataFrame, new: DataFrame, column: str = "value") -> DataFrame:
    """The state and those new rows whose key it lacks (the least value of several)."""
    absent = new.join(state.select("vid"), "vid", "left_anti").groupBy("vid").agg(F.min(column).alias(column))
    return state.select("vid", column).unionByName(absent)


def find(state: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of the asked keys."""
    return state.join(keys.select("vid").distinct(), "vid", "left_semi")
