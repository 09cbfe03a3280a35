"""Bounded, repeatable samples of labelled rows for fitting classifiers on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CLASSES = 1000
_STEPS = 1 << 20


def bounded_sample(rows: DataFrame, key: str, label: str, per_class: int) -> DataFrame:
    """About ``per_class`` rows of each label (all if there are fewer), chosen by a hash of the key.

    Class sizes are counted over all rows; the choice depends on keys alone, so it is the same in
    every run and whatever the partitioning.
    """
    counts = rows.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(label).count().limit(MAX_CLASSES + 1).collect()
    if len(counts) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes in {label}")
    if not counts:
        return rows.limit(0)
    keep = F.lit(0)
    for r in counts:
        keep = F.when(F.col(label) == F.lit(r[label]), F.lit(min(_STEPS, -(-per_class * _STEPS // r["count"])))).otherwise(keep)
    return rows.where(F.pmod(F.xxhash64(F.col(key)), F.lit(_STEPS)) < keep)
