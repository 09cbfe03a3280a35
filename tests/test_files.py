"""Readers, writers and streams."""

import gzip

from graphloom.sources import readers, writers
from graphloom.streaming import edge_stream, running_degrees


def test_edges(spark, tmp_path, rows_of):
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "a.csv").write_text("0,1,.123\n 5 , 6, 102.1 ,x\n\n8,\nz,3,1\n9,10,bad\n")
    with gzip.open(tmp_path / "e" / "b.csv.gz", "wt") as f:
        f.write("7,8,1")
    path = str(tmp_path / "e")
    assert rows_of(readers.load_edges(spark, path)) == [(0, 1), (5, 6), (7, 8), (9, 10)]
    assert rows_of(readers.load_edges(spark, path, "double")) == [(0, 1, 0.123), (5, 6, 102.1), (7, 8, 1.0)]
    assert rows_of(readers.load_edges(spark, path, "double", 1.0))[-1] == (9, 10, 1.0)


def test_vertices_and_payloads(spark, tmp_path, rows_of):
    (tmp_path / "v.csv").write_text("0,255\n4,256\n5\n6,1:2:x:3")
    path = str(tmp_path / "v.csv")
    assert rows_of(readers.load_vertices(spark, path, "uint8")) == [(0, 255)]
    assert readers.load_vertices(spark, path).count() == 4
    assert dict(rows_of(readers.load_lists(spark, path)))[6] == [1, 2, 3]
    (tmp_path / "b.txt").write_text("1,2,3\n4 5\t6\n7,8\n")
    assert rows_of(readers.load_behaviours(spark, str(tmp_path / "b.txt"), 1)) == [(1, 2, 3), (4, 5, 6)]


def test_libsvm(spark):
    v = spark.createDataFrame([(1, "12 0:0.1 1:0.2 100:0.4 3:1.2 10:0.44"), (2, "x 1:2")], "vid long, value string")
    sparse = readers.parse_libsvm(v).collect()
    assert len(sparse) == 1 and sparse[0]["label"] == 12 and len(sparse[0]["features"]) == 5
    dense = readers.parse_libsvm(v, 101).first()["features"]
    assert len(dense) == 101 and abs(dense[100] - 0.4) < 1e-6 and dense[2] == 0


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, [2, 3])], "a long, b array<long>")
    for _ in range(2):
        writers.write_csv(df, str(tmp_path / "out"))
    assert "".join(gzip.open(p, "rt").read() for p in (tmp_path / "out").glob("*.gz")) == "1,2:3\n"
    writers.write_shells(spark.createDataFrame([(2, 1, 5)], "coreness long, src long, dst long"), str(tmp_path / "k"), gzip=False)
    assert (tmp_path / "k" / "coreness=2").is_dir()
    writers.write_paths(spark.createDataFrame([("1 2",)], "value string"), str(tmp_path / "p"))


def test_stream(spark, tmp_path, rows_of):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("0,1\n0,2\n")
    q = running_degrees(edge_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("degrees").start()
    q.processAllAvailable()
    q.stop()
    assert rows_of(spark.table("degrees")) == [(0, 2, 0), (1, 0, 1), (2, 0, 1)]
