"""The command line: files in, files out."""

import pytest

from graphloom.__main__ import OPERATORS, main
from graphloom.plans import scratch
from graphloom.sources.readers import load_edges

EDGES = "100,7\n7,1000000\n100, 1000000 \n\n5,6\nx,1\n6,5"


@pytest.fixture
def edges(tmp_path):
    (tmp_path / "edges.csv").write_text(EDGES)
    return str(tmp_path / "edges.csv")


def lines(spark, path):
    return sorted(r["value"] for r in spark.read.text(str(path)).collect())


@pytest.mark.parametrize("encode", [[], ["--need-encode"]])
def test_components_and_ranks(spark, tmp_path, edges, encode):
    """Encoded or not, the output has the files' ids."""
    main(["components", "--input", edges, "--output", f"{tmp_path}/out", "--undirected", *encode], spark)
    assert lines(spark, tmp_path / "out") == ["100,7", "1000000,7", "5,5", "6,5", "7,7"]
    main(["pagerank", "--input", edges, "--output", f"{tmp_path}/ranks", "--iterations", "3", *encode], spark)
    assert [x.split(",")[0] for x in lines(spark, tmp_path / "ranks")] == ["100", "1000000", "5", "6", "7"]
    main(["node2vec", "--input", edges, "--output", f"{tmp_path}/walks", "--steps", "2", "--undirected", *encode], spark)
    assert {x.split()[1] for x in lines(spark, tmp_path / "walks") if x.split()[0] == "5"} == {"6"}


@pytest.mark.parametrize("operator", sorted(set(OPERATORS) - {"spread", "metapath", "components", "pagerank", "node2vec"}))
def test_every_operator_writes(spark, tmp_path, edges, operator):
    main([operator, "--input", edges, "--output", f"{tmp_path}/out", "--undirected", "--root", "5", "--iterations", "2", "--plain"], spark)
    assert lines(spark, tmp_path / "out")


def test_two_table_operators(spark, tmp_path, edges):
    (tmp_path / "behaviours").write_text("7 1 5\n1000000\t1\t2\n")
    main(["spread", "--input", edges, "--output", f"{tmp_path}/s", "--behaviours", f"{tmp_path}/behaviours", "--sums", "1"], spark)
    assert lines(spark, tmp_path / "s") == ["100,1,2,7", "7,1,1,2"]
    (tmp_path / "types").write_text("5,0\n6,1\n")
    main(["metapath", "--input", edges, "--output", f"{tmp_path}/m", "--types", f"{tmp_path}/types", "--steps", "3"], spark)
    assert lines(spark, tmp_path / "m") == ["5 6 5"]
    with pytest.raises(SystemExit):
        main(["bfs", "--input", edges, "--output", f"{tmp_path}/b", "--need-encode"], spark)


def test_run_folders_are_removed(spark, tmp_path, edges):
    main(["kcore", "--input", edges, "--output", f"{tmp_path}/shells", "--undirected", "--kind", "shells"], spark)
    assert not scratch._RUNS and load_edges(spark, edges).count() == 5
