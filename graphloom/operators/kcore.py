"""Coreness by repeated h-indices, shells and cores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from graphloom.graph import Graph
from graphloom.plans.scratch import Scratch


#: A round in which more than one of so many vertices fall is followed by one that asks all vertices again.
MANY = 4


def coreness(graph: Graph, max_rounds: int = 10_000) -> DataFrame:
    """(vid, coreness) over incoming arcs; parallel edges and self-loops count in the degree.

    Estimates start at the degree and fall to the h-index of the neighbours' estimates.  While many fall, a round
    asks all vertices: estimates go along every arc, once to the part of their target, where they are folded to counts
    per estimate, so a hub's window has as many rows as there are different estimates around it.  Afterwards each
    vertex knows how many neighbours support its estimate (have it or a greater one).  Those that fall tell their
    neighbours, and only where too few supporters are left is the h-index taken again, so a round costs
    the arcs of the vertices that fall in it.
    """
    scratch = Scratch(graph.edges.sparkSession, "kcore")
    arcs = graph.persisted_arcs()
    ends = arcs.select(F.col("dst").alias("vid"), F.lit(1).alias("n")).unionByName(arcs.select(F.col("src").alias("vid"), F.lit(0).alias("n")))
    state = scratch.save(ends.groupBy("vid").agg(F.sum("n").cast("long").alias("est")))
    into = arcs.select("src", "dst") if not graph.directed else graph.arcs().select(F.col("dst").alias("src"), F.col("src").alias("dst")).repartition("src").persist(StorageLevel.MEMORY_AND_DISK)

    def settled(met: DataFrame) -> DataFrame:
        """(vid, h, support) of (vid, est) rows, one a neighbour, that lie together by vid."""
        counted = met.groupBy("vid", "est").agg(F.count("*").alias("n"))
        above = F.sum("n").over(Window.partitionBy("vid").orderBy(F.desc("est")))
        best = counted.select("vid", F.struct(F.least("est", above).alias("h"), above.alias("support")).alias("b")).groupBy("vid").agg(F.max("b").alias("b"))
        return best.select("vid", "b.h", "b.support")

    def asked(state: DataFrame) -> DataFrame:
        """(vid, est, old, support) of all vertices; the support is that of the estimates before the round."""
        sent = arcs.join(state.select(F.col("vid").alias("src"), "est"), "src").select(F.col("dst").alias("vid"), "est").repartition("vid")
        new = state.select("vid", F.col("est").alias("old")).join(settled(sent), "vid", "left")
        return new.select("vid", F.coalesce("h", F.lit(0).cast("long")).alias("est"), "old", F.coalesce("support", F.lit(0).cast("long")).alias("support"))

    def asked_again(state: DataFrame) -> DataFrame:
        """The same, where only vertices with too few supporters ask their neighbours."""
        short = state.where("support < est").select(F.col("vid").alias("src"))
        met = into.join(short, "src").select(F.col("src").alias("vid"), F.col("dst").alias("by")).join(state.select(F.col("vid").alias("by"), "est"), "by")
        new = state.select("vid", F.col("est").alias("old"), F.col("support").alias("had")).join(settled(met.select("vid", "est").repartition("vid")), "vid", "left")
        return new.select("vid", F.coalesce("h", "old").alias("est"), "old", F.coalesce("support", "had").alias("support"))

    def told(state: DataFrame) -> DataFrame:
        """(vid, est, support) after the vertices that fell have told their neighbours."""
        fell = state.where("est < old").select(F.col("vid").alias("src"), F.col("old").alias("was"), F.col("est").alias("now"))
        heard = arcs.join(fell, "src").select(F.col("dst").alias("vid"), "was", "now").join(state.select("vid", "est"), "vid").where("now < est and est <= was")
        lost = heard.groupBy("vid").agg(F.count("*").alias("lost"))
        return state.join(lost, "vid", "left").select("vid", "est", (F.col("support") - F.coalesce("lost", F.lit(0))).alias("support"))

    vertices, many = state.count(), True
    for _ in range(max_rounds):
        new = scratch.save(asked(state) if many else asked_again(state))
        scratch.drop(state)
        fallen = new.where("est < old").count()
        if not fallen:
            arcs.unpersist()
            into.unpersist()
            return new.select("vid", F.col("est").alias("coreness"))
        many = many and fallen * MANY > vertices
        state = new if many else scratch.save(told(new))
        if not many:
            scratch.drop(new)
    raise RuntimeError(f"not settled in {max_rounds} rounds")


def shells(graph: Graph, core: DataFrame) -> DataFrame:
    """(coreness, src, dst): every arc under the coreness of its source."""
    return graph.arcs().select("src", "dst").join(core.withColumnRenamed("vid", "src"), "src").select("coreness", "src", "dst")


def core_subgraph(graph: Graph, core: DataFrame, k: int) -> DataFrame:
    """Edges with both ends of coreness k or more."""
    inside = core.where(F.col("coreness") >= k)
    kept = graph.edges.join(inside.select(F.col("vid").alias("src")), "src", "left_semi")
    return kept.join(inside.select(F.col("vid").alias("dst")), "dst", "left_semi").select(*graph.edges.columns)
