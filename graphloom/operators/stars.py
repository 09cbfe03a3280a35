"""Connected components by alternating large-star and small-star rounds.

Both rounds are joins and grouped minima, so no vertex, link or component ever
has to fit in one task; a hub's links are spread by adaptive skew-join splitting
because every join reads two plain exchanges (the minima are written first).
The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.scratch import Scratch


def _both_ways(e: DataFrame) -> DataFrame:
    return e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(e: DataFrame, scratch: Scratch) -> DataFrame:
    """Link every larger neighbour of u to the least vertex around u."""
    mins = scratch.save(_both_ways(e).groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
    out = _both_ways(e).where("v > u").join(mins, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    saved = scratch.save(out.where("u <> v").distinct())
    scratch.drop(mins)
    return saved


def _small_star(e: DataFrame, scratch: Scratch) -> DataFrame:
    """Link u and its smaller neighbours to the least of them (here u > v always)."""
    mins = scratch.save(e.groupBy("u").agg(F.min("v").alias("m")))
    near = e.join(mins, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    saved = scratch.save(near.unionByName(mins.select("u", F.col("m").alias("v"))).distinct())
    scratch.drop(mins)
    return saved


def _digest(e: DataFrame) -> tuple:
    r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def star_components(links: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(u, v) links of one ordered type -> (id, component), component = least id reachable.

    Self-links and repeated links are harmless, null ends are dropped.  Vertices without a
    link to another vertex are not listed; callers give them their own id.
    """
    e = scratch.save(
        links.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    last = _digest(e)
    if last[0]:
        for _ in range(max_rounds):
            large = _large_star(e, scratch)
            small = _small_star(large, scratch)
            scratch.drop(e, large)
            e = small
            now = _digest(e)
            if now == last:
                break
            last = now
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct())
