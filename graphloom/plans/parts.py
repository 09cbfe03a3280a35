"""How many parts the exchanges have, so that a task's share does not grow with the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes of table files whose rows one task joins or folds.
PART_BYTES = 4 << 20
_KEY = "spark.sql.shuffle.partitions"
#: Session's own number of parts, and what it was raised to.
_RAISED: dict[str, tuple[int, int]] = {}


def session_parts(spark: SparkSession) -> int:
    return int(spark.conf.get(_KEY))


def size_of(files: DataFrame) -> int:
    """Bytes of a table's files, as the planner knows them."""
    return int(str(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def widen(spark: SparkSession, *tables: DataFrame) -> int:
    """Raise the session's parts of an exchange to what these tables need, and never below what it came with.

    Adaptive execution joins small neighbouring parts again, so too many cost little, while it cannot split parts that are too few.
    """
    now = int(spark.conf.get(_KEY))
    own, raised = _RAISED.get(_KEY, (now, now))
    own = own if now == raised else now  # somebody else has set it since
    parts = max(own, -(-sum(size_of(t) for t in tables) // PART_BYTES))
    if parts != now:
        spark.conf.set(_KEY, str(parts))
    _RAISED[_KEY] = (own, parts)
    return parts
