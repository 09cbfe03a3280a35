"""The pipeline's stages, and the registered queries that SQL can express."""

import re
from pathlib import Path

import duckdb
import pytest
from pyspark import SparkContext

import corpus_pipeline
from graphloom.llm import queries
from graphloom.plans.scratch import Scratch
from tests.llm import messy

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables here")


def test_stages_keep_their_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(DATA))
        assert out.columns == docs.columns, name
        ids = [r["doc_id"] for r in out.select("doc_id").collect()]
        assert len(set(ids)) == len(ids) and 0.5 * len(seen) < len(ids) and set(ids) <= seen


def test_stages_start_one_python_worker_a_task(spark, monkeypatch):
    """No plan evaluates Python twice and none reads a list of rows: either starts further workers, which stay on the executor."""
    docs, many, save = spark.read.parquet(f"{DATA}/documents.parquet"), [], Scratch.save

    def noted(df):
        many.append(len(re.findall(r"EvalPython \[|MapInPandas |MapInArrow ", df._jdf.queryExecution().executedPlan().toString())))
        return df

    def listed(*_):
        raise AssertionError("a list of rows")

    monkeypatch.setattr(Scratch, "save", lambda self, df, **options: save(self, noted(df), **options))
    monkeypatch.setattr(SparkContext, "parallelize", listed)
    for name, stage in corpus_pipeline.STAGES:
        noted(stage(spark, docs, str(DATA)))
        assert max(many) == 1, name


def test_stages_take_messy_rows(spark):
    docs = messy.documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(DATA)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(DATA)).count() == 0
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, str(DATA)).count() == len(messy.ROWS) and last(spark, docs.limit(0), str(DATA)).count() == 0
    kept = corpus_pipeline.identified(spark, docs, str(DATA))
    assert not {3, 4, 5} & {r["doc_id"] for r in kept.collect()}


def test_duplicates_keep_texts_of_repeated_ids(spark):
    a, b = "one two three four five six seven", "quite another text that is not like the first one"
    rows = [(3, a, "en", "s", 1), (5, a, "en", "s", 1), (5, b, "en", "s", 1), (5, b, "en", "s", 1), (None, a, "en", "s", 1), (None, "x y z", "en", "s", 1), (None, "X y z", "en", "s", 1)]
    kept = sorted((r["doc_id"] or 0, r["text"].lower()) for r in corpus_pipeline.distinct(spark, messy.documents(spark, rows), "").collect())
    assert kept == [(0, "x y z"), (3, a), (5, b)]


def test_run(spark):
    out = corpus_pipeline.run(spark, str(DATA))
    ids = [r["doc_id"] for r in out.collect()]
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and len(ids) == len(set(ids)) > 100


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet{'/*.parquet' if (DATA / f'{t}.parquet').is_dir() else ''}'")
    df = queries.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    assert sorted(map(str, map(tuple, df.select(*cols).collect()))) == sorted(map(str, con.sql(queries.oracle_sql()[name]).select(*cols).fetchall()))


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_runs(spark, name):
    assert queries.queries()[name](spark, str(DATA)).count() == spark.read.parquet(f"{DATA}/{'pages' if name[:4] in ('op2_', 'op3_') else 'documents'}.parquet").count()
