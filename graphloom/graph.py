"""Graphs as edge tables: vertices, statistics, degrees, direction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel


@dataclass(frozen=True)
class GraphInfo:
    """Vertex set is every id on either end of an edge; edges are rows as given (never doubled)."""

    is_directed: bool
    vertices: int
    edges: int
    max_id: int | None


class Graph:
    """Edges ``src, dst[, weight]``; an undirected graph stores each edge once and is walked both ways."""

    def __init__(self, edges: DataFrame, directed: bool = True):
        weight = ["weight"] if "weight" in edges.columns else []
        self.edges = edges.where("src is not null and dst is not null").select("src", "dst", *weight)
        self.directed = directed

    @classmethod
    def of(cls, df: DataFrame, src: str, dst: str, weight: str | Column | None = None, directed: bool = True) -> Graph:
        cols = [F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst")]
        if weight is not None:
            cols.append((F.col(weight) if isinstance(weight, str) else weight).cast("double").alias("weight"))
        return cls(df.select(*cols), directed)

    @property
    def weighted(self) -> bool:
        return "weight" in self.edges.columns

    def with_weights(self, default: float = 1.0) -> Graph:
        """The graph with a weight on every edge; missing ones become the default."""
        w = F.coalesce("weight", F.lit(default)) if self.weighted else F.lit(default)
        return Graph(self.edges.select("src", "dst", w.cast("double").alias("weight")), self.directed)

    def reversed(self) -> Graph:
        weight = ["weight"] if self.weighted else []
        return Graph(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *weight), self.directed)

    def arcs(self) -> DataFrame:
        """Edges to walk along: as given, and also backwards if undirected (self-loops then occur twice)."""
        return self.edges if self.directed else self.edges.unionByName(self.reversed().edges)

    def persisted_arcs(self, by: str = "src") -> DataFrame:
        """Arcs hash-partitioned for repeated joins on one end."""
        return self.arcs().repartition(by).persist(StorageLevel.MEMORY_AND_DISK)

    def vertices(self) -> DataFrame:
        return self.edges.select(F.explode(F.array("src", "dst")).alias("vid")).distinct()

    def info(self) -> GraphInfo:
        r = self.info_table().first()
        return GraphInfo(self.directed, r["vertices"], r["edges"], r["max_id"])

    def info_table(self) -> DataFrame:
        """One row: vertices, edges, max_id; vertices are folded by id before they are counted."""
        ends = self.degrees()
        return ends.agg(
            F.count("*").alias("vertices"),
            F.coalesce((F.sum(F.col("out_degree") + F.col("in_degree")) / (2 if self.directed else 4)).cast("long"), F.lit(0).cast("long")).alias("edges"),
            F.max("vid").alias("max_id"),
        )

    def degrees(self) -> DataFrame:
        """vid, out_degree, in_degree of every vertex, in one shuffle; undirected edges count at both ends both ways."""
        one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
        o, i = (one, zero) if self.directed else (one, one)
        ends = F.array(
            F.struct(F.col("src").alias("vid"), o.alias("o"), i.alias("i") if not self.directed else zero.alias("i")),
            F.struct(F.col("dst").alias("vid"), (zero if self.directed else one).alias("o"), one.alias("i")),
        )
        return self.edges.select(F.explode(ends).alias("e")).groupBy("e.vid").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))

    def weighted_degrees(self) -> DataFrame:
        """vid and the sum of the weights of its outgoing arcs, zero where it has none."""
        w = self.with_weights()
        other = F.lit(0.0) if self.directed else F.col("weight")
        ends = F.array(F.struct(F.col("src").alias("vid"), F.col("weight").alias("w")), F.struct(F.col("dst").alias("vid"), other.alias("w")))
        return w.edges.select(F.explode(ends).alias("e")).groupBy("e.vid").agg(F.sum("e.w").alias("strength"))

    def degree_distribution(self) -> DataFrame:
        """out_degree, vertices with it."""
        return self.degrees().groupBy("out_degree").agg(F.count("*").alias("vertices"))

    def density(self) -> DataFrame:
        """One row: density, edges over possible edges (0 with fewer than two vertices)."""
        v, e = F.col("vertices").cast("double"), F.col("edges") * F.lit(1.0 if self.directed else 2.0)
        return self.info_table().select(F.when(v > 1, e / (v * (v - 1))).otherwise(0.0).alias("density"))
