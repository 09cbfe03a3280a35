"""What keeps a task's share and the rows moved in proportion to the tables."""

import random
import re

from pyspark.sql import functions as F

from graphloom.functions import sets
from graphloom.operators import kcore, mutual, neighbourhood, propagation, reach, spread
from graphloom.operators.traversal import hops
from graphloom.plans import parts
from tests import serial


def test_exchanges_have_parts_for_the_tables(spark, monkeypatch, tmp_path):
    key, files = "spark.sql.shuffle.partitions", str(tmp_path / "t")
    own = int(spark.conf.get(key))
    spark.range(20_000).write.parquet(files)
    table = spark.read.parquet(files)
    monkeypatch.setattr(parts, "PART_BYTES", parts.size_of(table) // 9)
    try:
        assert parts.widen(spark, table) >= 9 and int(spark.conf.get(key)) >= 9
        monkeypatch.setattr(parts, "PART_BYTES", 1 << 40)
        assert parts.widen(spark, table) == own == int(spark.conf.get(key))  # a small table after it: as the session came
        spark.conf.set(key, "7")
        assert parts.widen(spark, table) == 7
    finally:
        spark.conf.set(key, str(own))


def test_repeated_members_are_folded_before_they_move(spark):
    many = spark.range(0, 10).selectExpr("explode(array(id, id)) as vid")
    for found, n in ((sets.intersection(spark.range(5).toDF("vid"), many), 5), (sets.difference(spark.range(12).toDF("vid"), many), 2)):
        assert found.count() == n
        assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") >= 2


def test_coreness_by_all_vertices_or_by_those_that_fall(make, rows_of, monkeypatch):
    chain = [(i, i + 1) for i in range(20)] + [(20, 30), (30, 31), (30, 32), (31, 32), (20, 31), (20, 32), (3, 3), (1, 2)]
    for directed in (False, True):
        want = serial.coreness(serial.arcs_of(chain, directed))
        for many in (0, 4, 10**9):
            monkeypatch.setattr(kcore, "MANY", many)
            assert dict(rows_of(kcore.coreness(make(chain, directed)))) == want


def test_pairs_are_counted_by_bits(make, rows_of, monkeypatch):
    r = random.Random(3)
    edges = sorted({(r.randrange(90), r.randrange(90)) for _ in range(140)}) + [(200, 201), (300, 300)]
    for small, work in ((4096, 10**8), (4, 1)):  # one unit of all components, and the largest shared out
        monkeypatch.setattr(reach, "SMALL", small)
        monkeypatch.setattr(reach, "SHARE_WORK", work)
        for directed in (False, True):
            g = make(edges, directed)
            far = hops(g, g.vertices().withColumnRenamed("vid", "root"))
            want = rows_of(far.groupBy("vid", "dist").count())
            assert rows_of(reach.reach_counts(g).groupBy("vid", "level").agg(F.sum("n"))) == want
    assert neighbourhood.exact_average_distance(make([])).first()[0] == 0.0


def test_messages_of_a_round_are_dealt_once(make, monkeypatch):
    monkeypatch.setattr(propagation, "released", lambda state, *_: state)
    for out in (propagation.hop_attenuation(make([(0, 1), (1, 2)], False), 1), propagation.label_propagation(make([(0, 1), (1, 2)], False), 1)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning(vid" in plan
        assert not re.search(r"Exchange hashpartitioning\(vid#\d+L?, label", plan)


def test_triangles_by_cells_of_colours(make, rows_of, monkeypatch):
    r = random.Random(8)
    edges = sorted({tuple(sorted(r.sample(range(40), 2))) for _ in range(260)}) + [(50, 50), (3, 2)]
    near = {v: {b if a == v else a for a, b in edges if v in (a, b)} - {v} for v in range(51)}
    want = sorted({(min(e), max(e), len(near[e[0]] & near[e[1]])) for e in edges if e[0] != e[1]})
    for least in (20_000, 100, 10):  # one, two and four colours
        monkeypatch.setattr(mutual, "SMALL_EDGES", least)
        assert rows_of(mutual.mutual_neighbours(make(edges, False))) == want


def test_behaviours_go_along_arcs_as_lists(spark, rows_of, monkeypatch):
    relations = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (2, 9), (None, 1)], "src long, dst long")
    did = spark.createDataFrame([(3, 7, 1), (3, 7, 4), (3, 8, None), (3, 6, 2), (2, 7, 5), (1, None, 3)], "vid long, behaviour_id long, q int")
    monkeypatch.setattr(spread, "LIST_ROWS", 1)
    out = spread.spread(relations, did, ["q"], friends=True)
    assert out.columns == ["src", "behaviour_id", "n", "sum_q", "friends"] and dict(out.dtypes)["sum_q"] == "bigint"
    got = {(r.src, r.behaviour_id): (r.n, r.sum_q, r.friends) for r in out.collect()}
    around1 = {(1, 7): (3, 10, "2:3"), (1, 8): (1, None, "3"), (1, 6): (1, 2, "3")}
    around2 = {(2, 7): (2, 5, "3"), (2, 8): (1, None, "3"), (2, 6): (1, 2, "3"), (2, None): (1, 3, "1")}
    assert got == around1 | around2 | {(3, 7): (1, 5, "2"), (3, None): (1, 3, "1"), (9, 7): (1, 5, "2")}
