"""Mergeable distinct-count sketches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sketch(value: Column | str, bits: int = 12) -> Column:
    """Aggregate: a sketch of 2^bits registers of the values of a group."""
    return F.hll_sketch_agg(value, F.lit(bits))


def merged(sketches: Column | str) -> Column:
    """Aggregate: the sketch of everything that the sketches of a group have seen."""
    return F.hll_union_agg(sketches)


def estimate(sketch_column: Column | str) -> Column:
    return F.hll_sketch_estimate(sketch_column)
