"""PageRank, plain and weighted, un-normalised: r = (1 - d) + d * sum of shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.plans.iterate import released, rounds
from graphloom.plans.scratch import Scratch


def _shares(graph: Graph, weighted: bool) -> DataFrame:
    """Arcs with the share of its rank that src sends, and an own row of share 0 for every vertex.

    With the own rows an iteration is one join and one grouped sum: vertices without incoming arcs need
    no outer join, and the old rank travels along for the convergence test.
    """
    arcs = graph.arcs()
    w = F.col("weight") if weighted else F.lit(1.0)
    total = arcs.groupBy("src").agg(F.sum(w).alias("total"))
    sent = arcs.withColumn("w", w).join(total, "src").select("src", "dst", F.when(F.col("total") != 0, F.col("w") / F.col("total")).otherwise(0.0).alias("share"), F.lit(False).alias("own"))
    own = graph.vertices().select(F.col("vid").alias("src"), F.col("vid").alias("dst"), F.lit(0.0).alias("share"), F.lit(True).alias("own"))
    return sent.unionByName(own).repartition("src").persist()


def pagerank(graph: Graph, iterations: int = 100, damping: float = 0.85, eps: float = 0.001, weighted: bool = False) -> DataFrame:
    """(vid, rank).  Below ``eps`` total change one more, final, iteration follows; eps = 0 runs them all.

    Rank of vertices without outgoing arcs (or of zero total weight) is not passed on.
    """
    scratch = Scratch(graph.edges.sparkSession, "pagerank")
    shares = _shares(graph, weighted)

    def advance(ranks: DataFrame) -> DataFrame:
        met = shares.join(ranks.select(F.col("vid").alias("src"), "rank"), "src")
        return met.groupBy(F.col("dst").alias("vid")).agg(
            ((1 - damping) + damping * F.sum(F.col("share") * F.col("rank"))).alias("rank"),
            F.max(F.when(F.col("own"), F.col("rank"))).alias("before"),
        )

    ranks = graph.vertices().withColumn("rank", F.lit(1.0))
    if eps <= 0:
        return released(rounds(ranks, advance, scratch, iterations).select("vid", "rank"), scratch, shares)
    held = None
    for n in range(iterations):
        ranks = scratch.save(advance(ranks))
        scratch.drop(held)
        held = ranks
        if n < iterations - 1:
            change = ranks.agg(F.sum(F.abs(F.col("rank") - F.col("before")))).first()[0] or 0.0
            if change < eps:
                ranks = scratch.save(advance(ranks))
                break
    shares.unpersist()
    return ranks.select("vid", "rank")
