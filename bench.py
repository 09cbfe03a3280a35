"""Headline graph queries: one JSON line with seconds per query.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_REPEATS (default 3: median of so
many timed runs, after one warm-up of the engine on the degrees query).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from graphloom import derived
from graphloom.operators import components, kcore, mutual, neighbourhood, pagerank, propagation, spread, traversal
from graphloom.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))


def main() -> None:
    spark = local_session(CPUS, int(CPUS), "bench")

    def graph(name: str, directed: bool = False):
        g = derived.graph(spark, SF_DIR, name, directed)
        g.edges = g.edges.persist()
        g.edges.count()
        return g

    began = time.time()
    g_cs, g_ps, g_pp, g_thin = (graph(n) for n in ("g_cs", "g_ps", "g_pp", "g_thin"))
    g_tree = graph("g_tree", directed=True)
    load = time.time() - began
    queries = {
        "degrees": lambda: g_cs.degrees(),
        "graph_info": lambda: g_cs.info_table(),
        "spread": lambda: spread.spread(g_pp.edges, derived.behaviours(spark, SF_DIR), ["quantity"]),
        "pagerank": lambda: pagerank.pagerank(g_cs, 10, eps=0),
        "components": lambda: components.labels(g_ps),
        "kcore": lambda: kcore.coreness(g_ps),
        "label_propagation": lambda: propagation.label_propagation(g_pp, 5),
        "mutual": lambda: mutual.mutual_neighbours(g_pp),
        "bfs": lambda: traversal.bfs(g_tree, 0),
        "tree_statistics": lambda: traversal.tree_statistics(g_tree, 0),
        "n_step_exact": lambda: neighbourhood.exact_n_step_degrees(g_thin, 2),
        "n_step_sketch": lambda: neighbourhood.n_step_degrees(g_thin, 2),
    }
    queries["degrees"]().write.format("noop").mode("overwrite").save()
    took = {}
    for name, query in queries.items():
        times = []
        for _ in range(REPEATS):
            start = time.time()
            query().write.format("noop").mode("overwrite").save()
            times.append(time.time() - start)
        took[name] = round(statistics.median(times), 3)
        print(name, took[name], file=sys.stderr)
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "graph_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "load_sec": round(load, 3), "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
