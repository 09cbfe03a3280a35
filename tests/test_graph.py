"""Goldens and serial re-implementations on small graphs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import sets
from graphloom.functions.sampling import AliasTable, choose
from graphloom.graph import Graph
from graphloom.operators import centrality, communities, components, convolve, kcore, mutual, neighbourhood, pagerank, propagation, traversal, walks
from graphloom.operators.encode import encode
from graphloom.operators.spread import spread
from graphloom.plans.scratch import Scratch
from tests import serial

PATH = [(i, i + 1) for i in range(9)]
TREE = [((i - 1) // 2, i) for i in range(1, 10)]
RING7 = [(0, 6), (1, 0), (2, 0), (3, 0), (4, 3), (5, 4), (6, 6)]
CORE7 = [(0, 1), (1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (2, 5), (2, 6), (3, 4), (4, 6), (5, 6)]


def random_edges(n, m, seed=5):
    r = random.Random(seed)
    return sorted({tuple(sorted(r.sample(range(n), 2))) for _ in range(m)})


CLUSTERS = random_edges(12, 40, 1) + [(a + 20, b + 20) for a, b in random_edges(12, 40, 2)] + [(3, 25), (50, 51)]


def test_info_and_degrees(make, rows_of):
    g = make([(0, 1), (0, 1), (2, 2)], directed=True)
    assert (g.info().vertices, g.info().edges, g.info().max_id) == (3, 3, 2)
    assert rows_of(g.degrees()) == [(0, 2, 0), (1, 0, 2), (2, 1, 1)]
    u = make([(0, 1), (0, 1), (2, 2)], directed=False)
    assert (u.info().vertices, u.info().edges) == (3, 3)
    assert rows_of(u.degrees()) == [(0, 2, 2), (1, 2, 2), (2, 2, 2)]
    assert make([], False).info().vertices == 0


def test_directions_and_weights(make, rows_of):
    g = make([(0, 1, 2.0), (1, 1, 3.0)], directed=False)
    assert rows_of(g.reversed().edges) == [(1, 0, 2.0), (1, 1, 3.0)]
    assert rows_of(g.weighted_degrees()) == [(0, 2.0), (1, 8.0)]
    assert make([(0, 1), (1, 2)], True).density().first()[0] == pytest.approx(2 / 6)


def test_bfs_and_tree(make, rows_of):
    g = make(TREE)
    got = rows_of(traversal.bfs(g))
    assert [(v, d) for v, d, _ in got] == sorted(serial.distances(TREE, 0).items())
    assert tuple(traversal.tree_statistics(g).first()) == (4, 4, True)
    assert traversal.is_strict_tree(g)
    both = make(TREE + [(b, a) for a, b in TREE], directed=False)
    assert traversal.tree_statistics(both).first()["is_tree"]
    assert traversal.visited_count(make(PATH), 5).first()[0] == 5


def test_long_path_folds_levels(make):
    edges = [(i, i + 1) for i in range(20)]
    assert traversal.hops(make(edges), traversal.one_root(make(edges), 0)).count() == 21


def test_pagerank_goldens(make):
    tree = {r[0]: r[1] for r in pagerank.pagerank(make(TREE)).collect()}
    want = {0: 0.15, 1: 0.21375, 3: 0.240844, 7: 0.252359, 9: 0.354717}
    assert all(tree[v] == pytest.approx(x, abs=1e-6) for v, x in want.items())
    path = {r[0]: r[1] for r in pagerank.pagerank(make(PATH, False), iterations=100).collect()}
    for v, x in enumerate([0.643819, 1.162033, 1.093418, 1.057935, 1.042794]):
        assert path[v] == pytest.approx(x, abs=1e-6) and path[9 - v] == pytest.approx(x, abs=1e-6)


def test_pagerank_rounds_and_weights(make):
    got = {r[0]: r[1] for r in pagerank.pagerank(make(CLUSTERS, False), 6, eps=0).collect()}
    want = serial.pagerank(serial.arcs_of(CLUSTERS, False), 6)
    assert all(got[v] == pytest.approx(x, abs=1e-9) for v, x in want.items())
    w = {r[0]: r[1] for r in pagerank.pagerank(make([(0, 1, 3.0), (0, 2, 1.0)]), 2, eps=0, weighted=True).collect()}
    assert w[1] == pytest.approx(0.15 + 0.85 * 0.15 * 0.75) and w[2] == pytest.approx(0.15 + 0.85 * 0.15 * 0.25)


def test_components(make, rows_of):
    edges = [(i, i + 1) for i in range(30)] + [(40, 41), (41, 42), (60, 60)]
    g = make(edges, False)
    named = components.labels(g)
    got = dict(rows_of(named))
    assert got == {v: min(serial.distances(serial.arcs_of(edges, False), v)) for e in edges for v in e}
    sized = components.sizes(g, named)
    assert rows_of(sized) == [(0, 31, 30), (40, 3, 2), (60, 1, 1)]
    assert components.major_label(sized).first()[0] == 0
    assert [r["label"] for r in components.summary(sized).collect()] == [0, 40, 60]
    assert rows_of(components.sub_graph(g, named, 42)) == [(40, 40, 41), (40, 41, 42)]
    assert components.sub_graph(g, named).count() == 30
    down = dict(rows_of(components.labels(make([(5, 1), (1, 2), (3, 2)]))))
    assert down == {5: 5, 1: 1, 2: 1, 3: 3}


def test_encode(make, rows_of):
    g, codes = encode(make([(100, 7), (7, 1_000_000)]))
    assert rows_of(codes) == [(7, 0), (100, 1), (1_000_000, 2)]
    assert rows_of(g.edges) == [(0, 2), (1, 0)]
    only, _ = encode(make([(100, 7)]), encode_dst=False)
    assert rows_of(only.edges) == [(0, 7)]


def test_labels(make, rows_of):
    got = dict(rows_of(propagation.label_propagation(make(CLUSTERS, False), 3)))
    assert got == serial.label_rounds(serial.arcs_of(CLUSTERS, False), 3)
    assert dict(rows_of(propagation.label_propagation(make(CLUSTERS, False), 1, compat_rounds=True))) == {v: v for e in CLUSTERS for v in e}
    hanp = {r[0]: (r[1], r[2]) for r in propagation.hop_attenuation(make([(0, 1, 1.0), (2, 1, 5.0)]), 2).collect()}
    assert hanp[0] == (0, 1.0) and hanp[2] == (2, 1.0)
    assert hanp[1][0] == 2 and hanp[1][1] == pytest.approx(1.0)


def test_coreness(make, rows_of):
    assert dict(rows_of(kcore.coreness(make(CORE7, False)))) == {0: 1, 1: 3, 2: 3, 3: 3, 4: 3, 5: 2, 6: 2}
    g = make(CLUSTERS, False)
    core = kcore.coreness(g)
    assert dict(rows_of(core)) == serial.coreness(serial.arcs_of(CLUSTERS, False))
    assert rows_of(kcore.core_subgraph(make(CORE7, False), kcore.coreness(make(CORE7, False)), 3)) == [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)]
    assert kcore.shells(g, core).count() == 2 * len(CLUSTERS)


def test_closeness_and_betweenness(spark, make):
    g, arcs = make(CLUSTERS, False), serial.arcs_of(CLUSTERS, False)
    verts = {v for e in CLUSTERS for v in e}
    roots = [0, 3, 25]
    table = spark.createDataFrame([(r,) for r in roots], "root long")
    for r in centrality.closeness(g, table).collect():
        total = sum(serial.distances(arcs, r["root"]).values())
        assert r["closeness"] == pytest.approx((len(verts) - 1) / total, abs=1e-7)
    major = set(serial.distances(arcs, 0))
    got = dict(tuple(r) for r in centrality.sampled_closeness(g, roots=table).collect())
    for v in verts:
        total = sum(serial.distances(arcs, r).get(v, 0) for r in roots)
        want = len(roots) * (len(major) - 1) / (len(major) * total) if v in major and total else 0
        assert got[v] == pytest.approx(want, abs=1e-7)
    want = serial.betweenness(arcs, roots)
    got = dict(tuple(r) for r in centrality.sampled_betweenness(g, roots=table).collect())
    assert all(got[v] == pytest.approx(want[v] * len(major) / len(roots), abs=1e-7) for v in verts)
    whole = serial.betweenness(arcs, sorted(major))
    exact = dict(tuple(r) for r in centrality.sampled_betweenness(g, constant=1e9, batch=64).collect())
    assert all(exact[v] == pytest.approx(whole[v], abs=1e-6) for v in major)


def test_betweenness_of_the_chosen_component(make):
    """Roots come from the component of the chosen vertex, and the stopping rule counts its dependencies."""
    edges = [(i, i + 1) for i in range(20)] + [(50, 51), (51, 52), (52, 53)]
    g, small = make(edges, False), [50, 51, 52, 53]
    exact = serial.betweenness(serial.arcs_of(edges, False), small)
    got = dict(tuple(r) for r in centrality.sampled_betweenness(g, chosen=51, constant=1e9).collect())
    assert all(got[v] == pytest.approx(exact.get(v, 0) if v in small else 0) for v in {v for e in edges for v in e})
    few = dict(tuple(r) for r in centrality.sampled_betweenness(g, chosen=51, constant=0.25, batch=1).collect())
    assert few != got and sum(v > 0 for v in few.values()) <= 2
    assert not any(dict(tuple(r) for r in centrality.sampled_betweenness(g, chosen=999).collect()).values())


def test_ties_within_tolerance(make):
    """A sum a hair under the greatest ties with it, wherever a grid of that width would cut."""
    edges = [(1, 9, 1.0), (2, 9, 1.0 + 4e-7), (3, 8, 1.0), (4, 8, 1.0 + 3e-6)]
    got = {r["vid"]: r["label"] for r in propagation.hop_attenuation(make(edges), 1, tolerance=1e-6).collect()}
    assert got[9] == 1 and got[8] == 4
    for base in (0.5e-6, 1.5e-6, 2.5e-6):
        edge = [(1, 9, 1 + base - 1e-8), (2, 9, 1 + base + 1e-8)]
        assert {r["vid"]: r["label"] for r in propagation.hop_attenuation(make(edge), 1).collect()}[9] == 1


def test_unfinished_raises(make):
    with pytest.raises(RuntimeError):
        components.labels(make([(i, i + 1) for i in range(20)]), max_rounds=3)
    assert components.labels(make([(0, 1)])).count() == 2


def test_empty_graph_and_nulls(spark, make):
    none = make([], False)
    for out in (components.labels(none), kcore.coreness(none), pagerank.pagerank(none, 2), propagation.label_propagation(none, 2), propagation.hop_attenuation(none, 2), walks.node2vec(none, steps=3), mutual.mutual_neighbours(none), centrality.sampled_betweenness(none), centrality.sampled_closeness(none), communities.louvain(none), neighbourhood.n_step_degrees(none, 1)):
        assert out.count() == 0
    odd = Graph(spark.createDataFrame([(1, 2, "x", 5), (None, 2, "y", 5), (1, None, "z", 5), (1, 2, "x", 5)], "src long, dst long, vid string, label int"), False)
    assert components.labels(odd).count() == 2 and odd.info().edges == 2
    assert {r["coreness"] for r in kcore.coreness(odd).collect()} == {2}


def test_average_distance_and_steps(make, rows_of):
    g = make(RING7, False)
    assert neighbourhood.exact_average_distance(g).first()[0] == pytest.approx(2.190476, abs=1e-6)
    assert neighbourhood.average_distance(g, bits=12) == pytest.approx(2.190476, abs=0.05)
    d = make(RING7)
    one = {r[0]: (r[1], r[2]) for r in neighbourhood.exact_n_step_degrees(d, 1).collect()}
    assert one[0] == (3, 1) and one[4] == (1, 1)
    sketched = {r[0]: (r[1], r[2]) for r in neighbourhood.n_step_degrees(d, 1, bits=12).collect()}
    assert sketched[0] == (3, 1) and sketched[4] == (1, 1)


def test_communities(make, rows_of):
    g = make(CLUSTERS, False)
    single = serial.modularity(CLUSTERS, {v: v for e in CLUSTERS for v in e}, 2.0)
    found = dict(rows_of(communities.louvain(g)))
    assert set(found) == {v for e in CLUSTERS for v in e}
    assert serial.modularity(CLUSTERS, found, 2.0) > single
    plain = communities.louvain(g, resolution=1.0)
    value = serial.modularity(CLUSTERS, dict(rows_of(plain)))
    assert value > 0.3
    assert communities.modularity(g, plain).first()[0] == pytest.approx(value, abs=1e-9)
    dense = dict(rows_of(communities.density_louvain(g)))
    assert len(set(dense.values())) < len(dense) and not any(dense[a] == dense[b] for a in range(12) for b in (50, 51) if a in dense)


def test_infomap(make, rows_of):
    g = make(CLUSTERS, False)
    alone = g.vertices().selectExpr("vid", "vid AS community")
    found = communities.infomap(g)
    assert communities.code_length(g, found) < communities.code_length(g, alone)
    named = dict(rows_of(found))
    assert named[50] == named[51] and len({named[v] for v in named if v < 12}) < 6
    assert communities.module_sizes(found, 2).count() == 2
    d = make([(a, b, 1.0) for a, b in CLUSTERS + [(b, a) for a, b in CLUSTERS]])
    pi, _ = communities.flows(d)
    assert sum(r["flow"] for r in pi.collect()) == pytest.approx(1.0, abs=1e-6)


def test_mutual(spark, make, rows_of):
    g = make(CLUSTERS + [(0, 0), CLUSTERS[0]], False)
    near = {}
    for a, b in serial.arcs_of(CLUSTERS, False):
        near.setdefault(a, set()).add(b)
    got = {(r["src"], r["dst"]): (r["n"], r["common"]) for r in mutual.mutual_neighbours(g, lists=True).collect()}
    assert got == {(a, b): (len(near[a] & near[b]), sorted(near[a] & near[b])) for a, b in {tuple(sorted(e)) for e in CLUSTERS}}
    items = spark.createDataFrame([(0, [1, 2, 3]), (1, [2, 3, 4])], "vid long, items array<long>")
    assert rows_of(mutual.mutual_items(make([(0, 1), (1, 2)], False), items)) == [(0, 1, 2, [2, 3]), (1, 2, 0, [])]


def test_spread(spark, rows_of):
    rel = spark.createDataFrame([(1, 2), (1, 3)], "src long, dst long")
    beh = spark.createDataFrame([(2, 9, 5), (3, 9, 7), (3, 0, 1), (1, 9, 2)], "vid long, behaviour_id long, s1 long")
    assert rows_of(spread(rel, beh, ["s1"], friends=True, directed=True)) == [(1, 0, 1, 1, "3"), (1, 9, 2, 12, "2:3")]
    assert rows_of(spread(rel, beh)) == [(1, 0, 1), (1, 9, 2), (2, 9, 1), (3, 9, 1)]


def test_node2vec(make):
    edges = CLUSTERS
    arcs = set(serial.arcs_of(edges, False))
    found = walks.node2vec(make(edges, False), steps=5, epochs=2, seed=3).collect()
    verts = {v for e in edges for v in e}
    assert sorted((r["epoch"], r["walk"]) for r in found) == sorted((e, v) for e in (0, 1) for v in verts)
    assert all(len(r["path"]) == 5 and r["path"][0] == r["walk"] and all(p in arcs for p in zip(r["path"], r["path"][1:])) for r in found)
    again = walks.node2vec(make(edges, False), steps=5, epochs=2, seed=3).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


def test_node2vec_bias(make):
    """From hub 0 a walk of three returns with weight 1/p or goes on to a leaf of its neighbour with 1/q."""
    edges = [(0, 1), (1, 2)]
    found = walks.node2vec(make(edges, False), p=4.0, q=1.0, steps=3, epochs=4000, seed=1).where("walk = 0").collect()
    back = sum(r["path"] == [0, 1, 0] for r in found) / len(found)
    assert back == pytest.approx(0.25 / 1.25, abs=0.03)


def test_node2vec_second_order(make):
    """From 0 over 1: back with 1/p, to 2 (next to 0) with 1, on to 3 with 1/q; weights multiply."""
    edges = [(0, 1, 1.0), (1, 2, 2.0), (0, 2, 1e-9), (1, 3, 1.0)]
    found = [r["path"] for r in walks.node2vec(make(edges, False), p=4.0, q=0.5, steps=3, epochs=6000, weighted=True, seed=5, start_rate=0.9).where("walk = 0").collect()]
    assert 5000 < len(found) < 5800
    third = [f[2] for f in found if f[1] == 1]
    total = 0.25 + 2 + 2
    for v, w in ((0, 0.25), (2, 2.0), (3, 2.0)):
        assert third.count(v) / len(third) == pytest.approx(w / total, abs=0.03)


def test_draws_follow_weights(spark):
    """Over several levels of a tree."""
    scratch = Scratch(spark, "draws")
    weights = [(d % 7 + 1.0) for d in range(90)]
    arcs = spark.createDataFrame([(0, 0, d, w) for d, w in enumerate(weights)] + [(1, 0, 5, 1.0)], "src long, kind int, dst long, w double")
    sampler = walks.Sampler(arcs, scratch, fan=4)
    assert len(sampler.levels) >= 3
    walkers = spark.range(60_000).select("id", F.lit(0).cast("long").alias("cur"), F.lit(0).alias("kind"))
    drawn = {r["dst"]: r["count"] for r in sampler.draw(walkers, F.col("id"), seed=2).groupBy("dst").count().collect()}
    assert all(drawn[d] / 60_000 == pytest.approx(w / sum(weights), rel=0.25) for d, w in enumerate(weights)) and sum(drawn.values()) == 60_000


def test_walks_over_a_hub_take_linear_rows(spark):
    """20,000 walkers meet at a star's centre; pairs of walkers and leaves would be 400 million."""
    star = Graph(spark.range(1, 20_001).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst")), False)
    found = walks.node2vec(star, steps=4)
    assert found.count() == 20_001 and found.where(F.size("path") != 4).isEmpty()
    assert found.where("walk > 0").select(F.get("path", F.lit(2))).distinct().count() > 10_000


def test_metapath(spark, make):
    edges = [(0, 1), (1, 2), (2, 3), (1, 4)]
    types = spark.createDataFrame([(0, 0), (1, 1), (2, 0), (3, 1), (4, 2)], "vid long, type int")
    found = [r["path"] for r in walks.metapath(make(edges), types, [0, 1], epochs=1, steps=4).collect()]
    assert sorted(found) == [[0, 1, 2, 3], [2, 3]]
    assert walks.path_text(walks.metapath(make(edges), types, [0, 1], epochs=1, steps=2)).first()[0].count(" ") == 1


def test_weighted_choice(spark):
    table = spark.createDataFrame([(i, v, w) for i in range(4000) for v, w in ((0, 1.0), (1, 3.0), (2, 0.0))], "g long, v long, w double")
    share = choose(table, ["g"], "w", "v", seed=2).where("v = 1").count() / 4000
    assert share == pytest.approx(0.75, abs=0.03)


def test_alias_table():
    import numpy as np

    weights = np.array([0.1, 0.2, 0.5, 0.2])
    drawn = np.bincount(AliasTable(weights).sample(np.random.default_rng(7), 1_000_000), minlength=4) / 1_000_000
    assert abs(drawn - weights).max() < 2e-3
    with pytest.raises(ValueError):
        AliasTable(np.zeros(3))


def test_convolve(spark, make):
    f = spark.createDataFrame([(0, [1.0, 2.0]), (1, [4.0, 0.0])], "vid long, features array<double>")
    got = {r[0]: r[1] for r in convolve.convolve(make([(0, 1)]), f, 1).collect()}
    assert got == {0: [1.0, 2.0], 1: [5.0, 2.0]}


def test_sets(spark, rows_of):
    a, b = (spark.createDataFrame([(v,) for v in s], "vid long") for s in ([1, 2, 2], [2, 3]))
    assert rows_of(sets.union(a, b)) == [(1,), (2,), (3,)]
    assert rows_of(sets.intersection(a, b)) == [(2,)] and rows_of(sets.difference(a, b)) == [(1,)]
    old = spark.createDataFrame([(1, 10)], "vid long, value long")
    new = spark.createDataFrame([(1, 5), (2, 7)], "vid long, value long")
    assert rows_of(sets.upsert(old, new)) == [(1, 5), (2, 7)]
    assert rows_of(sets.upsert(old, new, "sum")) == [(1, 15), (2, 7)]
    assert rows_of(sets.insert_missing(old, new)) == [(1, 10), (2, 7)]
    assert rows_of(sets.find(old, b)) == [] and math.isclose(sets.total(old, old.value).first()[0], 10)
