"""Command line: ``python -m graphloom OPERATOR --input FILES --output FOLDER [options]``.

Reads CSV edges (gzip by suffix, any file system Spark reads), runs one operator and writes
CSV parts.  With ``--need-encode`` the operator works on dense ids and the output has the
files' ids again.  The session is that of spark-submit, or a local one.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators import centrality, communities, components, kcore, mutual, neighbourhood, pagerank, propagation, spread, traversal, walks
from graphloom.operators.encode import encode
from graphloom.plans.scratch import clean
from graphloom.session import local_session
from graphloom.sources.loaders import decoded, load_graph
from graphloom.sources.readers import load_behaviours, load_edges, load_lists, load_vertices
from graphloom.sources.writers import write_csv, write_paths, write_shells

Run = Callable[[SparkSession, Graph, argparse.Namespace], DataFrame]

#: Columns of results that hold vertex ids.
IDS = ("vid", "src", "dst", "root", "label", "community", "parent")


def _one(spark: SparkSession, name: str, value: float) -> DataFrame:
    return spark.range(1).select(F.lit(value).alias(name))


def _components(spark: SparkSession, g: Graph, a: argparse.Namespace) -> DataFrame:
    named = components.labels(g)
    if a.kind == "edges":
        return components.labelled_edges(g, named)
    if a.kind == "major":
        return components.sub_graph(g, named, a.vertex)
    return components.summary(components.sizes(g, named)) if a.kind == "sizes" else named


def _kcore(spark: SparkSession, g: Graph, a: argparse.Namespace) -> DataFrame:
    core = kcore.coreness(g)
    return kcore.shells(g, core) if a.kind == "shells" else kcore.core_subgraph(g, core, a.k) if a.kind == "subgraph" else core


def _actives(spark: SparkSession, a: argparse.Namespace) -> DataFrame | None:
    return None if a.actives == "ALL" else load_vertices(spark, a.actives).select("vid")


def _walks(spark: SparkSession, g: Graph, a: argparse.Namespace) -> DataFrame:
    if a.operator == "node2vec":
        return walks.node2vec(g, a.p, a.q, a.epochs, a.steps, a.weighted, a.seed, a.start_rate)
    types = load_vertices(spark, a.types, "int64").withColumnRenamed("value", "type")
    return walks.metapath(g, types, [int(t) for t in a.pattern.split("-")], a.epochs, a.steps, a.weighted, a.seed, a.start_rate)


OPERATORS: dict[str, Run] = {
    "degrees": lambda s, g, a: g.degrees(),
    "graph_info": lambda s, g, a: g.info_table(),
    "pagerank": lambda s, g, a: pagerank.pagerank(g, a.iterations or 100, a.damping, a.eps, a.weighted),
    "bfs": lambda s, g, a: traversal.bfs(g, a.root),
    "tree_stat": lambda s, g, a: traversal.tree_statistics(g, a.root),
    "components": _components,
    "kcore": _kcore,
    "lpa": lambda s, g, a: propagation.label_propagation(g, a.iterations or 20),
    "hanp": lambda s, g, a: propagation.hop_attenuation(g, a.iterations or 20, a.preference, a.attenuation),
    "closeness": lambda s, g, a: centrality.sampled_closeness(g, a.samples, a.seed),
    "betweenness": lambda s, g, a: centrality.sampled_betweenness(g, a.iterations, a.vertex, a.constant, a.seed),
    "average_distance": lambda s, g, a: _one(s, "average_distance", neighbourhood.average_distance(g, a.iterations or 20, a.bits)),
    "nstep_degrees": lambda s, g, a: neighbourhood.n_step_degrees(g, a.step, a.kind or "both", _actives(s, a), a.bits),
    "louvain": lambda s, g, a: communities.louvain(g, resolution=a.resolution),
    "density_louvain": lambda s, g, a: communities.density_louvain(g),
    "infomap": lambda s, g, a: communities.infomap(g),
    "mutual": lambda s, g, a: mutual.mutual_items(g, load_lists(s, a.items)) if a.items else mutual.mutual_neighbours(g, lists=True),
    "spread": lambda s, g, a: spread.spread(g.edges, load_behaviours(s, a.behaviours, a.sums), [f"s{i + 1}" for i in range(a.sums)], a.friends, g.directed),
    "node2vec": _walks,
    "metapath": _walks,
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    p.add_argument("operator", choices=sorted(OPERATORS))
    p.add_argument("--input", required=True, help="edge CSV: src,dst[,weight]")
    p.add_argument("--output", required=True, help="folder for the result")
    p.add_argument("--undirected", action="store_true")
    p.add_argument("--need-encode", action="store_true", help="work on dense ids")
    p.add_argument("--payload", default=None, help="type of the weights: float, double, uint8 ... uint64, int64")
    p.add_argument("--plain", action="store_true", help="no gzip")
    for flag, kind, value in (
        ("iterations", int, 0), ("damping", float, 0.85), ("eps", float, 0.001), ("root", int, 0), ("vertex", int, -1), ("k", int, 2), ("preference", float, 1.0),
        ("attenuation", float, 0.1), ("samples", int, 10), ("constant", float, 2.0), ("seed", int, 0), ("bits", int, 6), ("step", int, -1), ("resolution", float, 2.0),
        ("sums", int, 0), ("p", float, 1.0), ("q", float, 0.5), ("epochs", int, 1), ("steps", int, 10), ("start-rate", float, 1.0),
        ("kind", str, ""), ("actives", str, "ALL"), ("items", str, ""), ("behaviours", str, ""), ("types", str, ""), ("pattern", str, "0-1"),
    ):
        p.add_argument(f"--{flag}", type=kind, default=value)
    p.add_argument("--friends", action="store_true")
    return p


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.getActiveSession() or local_session()
    a.weighted = a.payload is not None
    g = load_graph(spark, a.input, not a.undirected, a.payload) if a.operator != "spread" else Graph(load_edges(spark, a.input), not a.undirected)
    codes = None
    if a.need_encode:
        if a.operator in ("spread", "mutual", "metapath", "bfs", "tree_stat") or a.vertex >= 0 or a.actives != "ALL":
            raise SystemExit("this run names vertices of the files, so it takes their ids as they are")
        g, codes = encode(g)
    out = OPERATORS[a.operator](spark, g, a)
    if codes is not None and "path" in out.columns:
        places = out.select("epoch", "walk", F.posexplode("path").alias("at", "vid"))
        places = decoded(places, codes, ["vid"]).groupBy("epoch", "walk").agg(F.array_sort(F.collect_list(F.struct("at", "vid"))).alias("path"))
        out = places.withColumn("path", F.transform("path", lambda s: s["vid"]))
    elif codes is not None:
        out = decoded(out, codes, [c for c in IDS if c in out.columns])
    if "path" in out.columns:
        write_paths(walks.path_text(out), a.output, not a.plain)
    elif a.operator == "kcore" and a.kind == "shells":
        write_shells(out, a.output, not a.plain)
    else:
        write_csv(out, a.output, not a.plain)
    clean(spark)


if __name__ == "__main__":
    main()
