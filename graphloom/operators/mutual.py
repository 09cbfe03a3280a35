"""Common neighbours of the ends of every edge, and of listed items of both ends."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.plans.scratch import Scratch


#: Edges that one task looks at together, about.
CELL_EDGES = 8_000_000
SMALL_EDGES = 20_000
#: Pairs of neighbours that it looks up together.
BLOCK_WEDGES = 1 << 21


def triangles(graph: Graph, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Distinct undirected edges (src < dst) and triangles (a, b, c), each once.

    Edges point from the end of lower degree, so wedges number at most E to the power 1.5 whatever the hubs.  They
    are never rows: vertices have one of p colours by a hash, an edge is sent to the p cells of three
    colours that hold its two, and a cell finds the triangles of exactly its colours.  So what moves is p times the
    edges, with p the square root of 6 E / CELL_EDGES.
    """
    edges = scratch.save(graph.edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    degree = scratch.save(edges.select(F.explode(F.array("src", "dst")).alias("vid")).groupBy("vid").agg(F.count("*").alias("d")))
    a, b = degree.select(F.col("vid").alias("src"), F.col("d").alias("ds")), degree.select(F.col("vid").alias("dst"), F.col("d").alias("dd"))
    low = F.struct("ds", "src") < F.struct("dd", "dst")
    pointed = edges.join(a, "src").join(b, "dst").select(F.when(low, F.col("src")).otherwise(F.col("dst")).alias("x"), F.when(low, F.col("dst")).otherwise(F.col("src")).alias("y"))
    count = edges.count()
    # Four colours make 20 cells, so that a small graph is not one task's work.
    p = max(1, math.ceil(math.sqrt(6 * count / CELL_EDGES)), min(4, math.ceil(math.sqrt(count / SMALL_EDGES))))
    cells = p * (p + 1) * (p + 2) // 6
    colour = {e: F.pmod(F.xxhash64(e), F.lit(p)).cast("int") for e in ("x", "y")}
    lists = pointed.groupBy("x", colour["x"].alias("cx"), colour["y"].alias("cy")).agg(F.collect_list("y").alias("ys"))
    three = F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda c: F.sort_array(F.array("cx", "cy", c)))
    sent = lists.select("x", "cx", "cy", "ys", F.explode(three).alias("c")).select((F.col("c")[0] * p * p + F.col("c")[1] * p + F.col("c")[2]).alias("cell"), "x", "ys")
    dealt = sent.repartition(cells, "cell").sortWithinPartitions("cell")
    found = dealt.mapInArrow(partial(_cells_triangles, p=p), "a long, b long, c long, mixed boolean")
    one = [F.pmod(F.xxhash64(e), F.lit(p)) for e in "abc"]
    return edges, found.where(~F.col("mixed") | (one[0] != one[1]) | (one[1] != one[2])).select("a", "b", "c")


def _cells_triangles(batches: Iterator[pa.RecordBatch], p: int) -> Iterator[pa.RecordBatch]:
    """Triangles of (cell, x, ys) rows that come sorted by cell."""
    cell, xs, ys = None, [], []
    for batch in batches:
        of, x, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        bounds = lists.offsets.to_numpy()
        flat = lists.values.to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
        for a, z in pairwise(cuts):
            if a == z:
                continue
            if of[a] != cell and xs:
                yield from _in_cell(cell, np.concatenate(xs), np.concatenate(ys), p)
                xs, ys = [], []
            cell = int(of[a])
            xs.append(np.repeat(x[a:z], np.diff(bounds[a : z + 1])))
            ys.append(flat[bounds[a] : bounds[z]].copy())
    if xs:
        yield from _in_cell(cell, np.concatenate(xs), np.concatenate(ys), p)


def _in_cell(cell: int, x: np.ndarray, y: np.ndarray, p: int) -> Iterator[pa.RecordBatch]:
    """Triangles of the edges x -> y; in a cell of two colours those of one colour belong to another cell."""
    vids = np.unique(np.concatenate([x, y]))
    x, y = np.searchsorted(vids, x), np.searchsorted(vids, y)
    known = np.sort(np.minimum(x, y) * len(vids) + np.maximum(x, y))
    key = np.sort(x * len(vids) + y)
    x, y = key // len(vids), key % len(vids)
    # Most pairs are no edge, which a table of hashed cells tells before the search.
    mask = (1 << min(27, max(10, int(len(known)).bit_length() + 4))) - 1
    some = np.zeros(mask + 1, dtype=bool)
    some[(known ^ (known >> 17)) & mask] = True
    end = np.searchsorted(x, x, side="right")
    wedges = np.concatenate([[0], np.cumsum(end - np.arange(len(x)) - 1)])  # an edge with each later one of its x
    cuts = [0]
    while cuts[-1] < len(x):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(wedges, wedges[cuts[-1]] + BLOCK_WEDGES, side="right")) - 1))
    mixed = p > 1 and len({cell // (p * p), cell // p % p, cell % p}) == 2
    for a, z in pairwise(cuts):
        first = np.repeat(np.arange(a, z), np.diff(wedges[a : z + 1]))
        second = first + 1 + np.arange(len(first)) - (wedges[first] - wedges[a])
        want = y[first] * len(vids) + y[second]  # the lesser first, as they come sorted
        near = np.flatnonzero(some[(want ^ (want >> 17)) & mask])
        at = np.minimum(np.searchsorted(known, want[near]), len(known) - 1)
        found = near[known[at] == want[near]]
        corners = [vids[x[first[found]]], vids[y[first[found]]], vids[y[second[found]]]]
        if len(corners[0]):
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in corners), pa.array(np.full(len(corners[0]), mixed))], names=["a", "b", "c", "mixed"])


def mutual_neighbours(graph: Graph, lists: bool = False, distinct_edges: bool = True) -> DataFrame:
    """(src, dst, n) with src < dst for every edge; with ``lists`` also the ascending common neighbours.

    Self-loops are left out; repeated edges count once, or are each reported if not ``distinct_edges``.
    """
    scratch = Scratch(graph.edges.sparkSession, "mutual")
    edges, found = triangles(graph, scratch)
    corner = [F.sort_array(F.array(p, q)) for p, q in (("a", "b"), ("a", "c"), ("b", "c"))]
    each = F.array(*(F.struct(e[0].alias("src"), e[1].alias("dst"), F.col(o).alias("common")) for e, o in zip(corner, ("c", "b", "a"), strict=True)))
    sides = found.select(F.explode(each).alias("e")).select("e.*")
    what = [F.count("*").alias("n")] + ([F.sort_array(F.collect_list("common")).alias("common")] if lists else [])
    counted = sides.groupBy("src", "dst").agg(*what)
    if not distinct_edges:
        edges = graph.edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    out = edges.join(counted, ["src", "dst"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return out.withColumn("common", F.coalesce("common", F.array().cast("array<bigint>"))) if lists else out.select("src", "dst", "n")


def mutual_items(graph: Graph, items: DataFrame) -> DataFrame:
    """(src, dst, n, common) for every edge, of vertex lists (vid, items array): items that both ends list."""
    edges = graph.edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    a, b = items.select(F.col("vid").alias("src"), F.col("items").alias("x")), items.select(F.col("vid").alias("dst"), F.col("items").alias("y"))
    none = F.array().cast(dict(items.dtypes)["items"])
    common = F.array_sort(F.array_intersect(F.coalesce("x", none), F.coalesce("y", none)))
    return edges.join(a, "src", "left").join(b, "dst", "left").select("src", "dst", common.alias("common")).select("src", "dst", F.size("common").cast("long").alias("n"), "common")
