"""Rendezvous hashing of record keys over weighted shards, with gapless slots.

Every (key, shard) pair has its own hash, read as a uniform number u; a record belongs
to the shard of least -ln(u) / weight.  One more shard only takes the records for which
it is the least, and never moves a record between the others.

Slots are numbered without a task that holds a whole shard: records that agree in id,
size and checksum are folded to one row with a count, shards are cut into hash parts of
about PART_ROWS rows, a part is numbered by running sums, and the parts' offsets come
from the small table of part sizes.

Only DataFrame functions are used.  A record that is repeated very often is unfolded in slices
of SLICE_ROWS rows.  Defined edge cases: null ids share one shard; null
texts count as empty (size 16, checksum 0); repeated rows each get a slot; an empty table
gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.scratch import Scratch

SHARDS = 40
ROW_BYTES = 16
PART_ROWS = 100_000
SLICE_ROWS = 100_000


def _cost(key: Column, shard: int, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / F.lit(float(weight))


def shard_of(key: Column, weights: Sequence[float]) -> tuple[Column, Column]:
    """(shard, its cost) of a key among shards of the given weights; ties go to the lower shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("shards need positive weights")
    costs = [F.struct(_cost(key, s, w).alias("cost"), F.lit(s).alias("shard")) for s, w in enumerate(weights)]
    best = F.least(*costs) if len(costs) > 1 else costs[0]
    return best.getField("shard"), best.getField("cost")


def with_shard(records: DataFrame, key: str, weights: Sequence[float], column: str = "shard") -> DataFrame:
    """The records with the shard of their key."""
    return records.withColumn(column, shard_of(F.col(key), weights)[0])


def copies(folded: DataFrame, most: int, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Rows with a count n, at most ``most``, n times each, with their number ``copy`` from 0.

    A row that stands for more than ``slice_rows`` is cut into slices that go to tasks of their own.
    """
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy")
    if most <= slice_rows:
        return folded.select("*", each)
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(slice_rows).cast("long"))).alias("begin")
    within = F.explode(F.sequence(F.col("begin"), F.least(F.col("begin") + slice_rows, F.col("n")) - 1)).alias("copy")
    return folded.select("*", begin).repartition("shard", "part", "begin").select("*", within)


def placed(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, grown_weight: float = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (with one more shard) of every document."""
    scratch = Scratch(docs.sparkSession, "sharding")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    folded = scratch.save(
        docs.select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
        .groupBy("doc_id", "size", "text_crc32")
        .agg(F.count("*").alias("n"))
    )
    rows, most = folded.agg(F.count("*"), F.max("n")).first()
    parts = max(1, -(-rows // (PART_ROWS * len(weights))))
    shard, cost = shard_of(F.col("doc_id"), weights)
    extra = _cost(F.col("doc_id"), len(weights), grown_weight)
    at = (
        folded.withColumns({"shard": shard, "cost": cost})
        .withColumn("grown_shard", F.when(extra < F.col("cost"), len(weights)).otherwise(F.col("shard")))
        .withColumn("part", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(parts)).cast("int"))
    )
    sums = at.groupBy("shard", "part").agg(F.sum("n").alias("total"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("shard", "part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    numbered = at.withColumn("first", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(offsets, ["shard", "part"])
    return copies(numbered, most or 0).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("offset") + F.col("first") + F.col("copy")).cast("long").alias("slot"),
        F.col("grown_shard").cast("int").alias("grown_shard"),
    )
