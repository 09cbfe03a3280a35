"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, decontaminate, html_extract, langid, minhash, quality, sharding, simhash, toxicity, url_filter
from graphloom.llm.common import crc_bucket, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites are sources, and their sections the languages within them."""
    docs = table(spark, sf_dir, "documents")
    classifier = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, classifier, F.col("source"), F.concat_ws("/", F.col("source"), F.col("lang")))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    held_out = F.coalesce(crc_bucket(F.col("doc_id"), langid.FOLDS) == langid.HELD_OUT, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "__lang.lang_pred", "__lang.score", "__lang.rejected")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placed(table(spark, sf_dir, "documents"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edited_likeness(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(crc_bucket(F.col("doc_id"), toxicity.FOLDS) == toxicity.HELD_OUT, F.lit(False))
    predicted = (F.col("__tox.score") >= toxicity.THRESHOLD).cast("int")
    return found.select("doc_id", held_out.alias("held_out"), "__tox.score", predicted.alias("predicted"), "__tox.spans")


def tokenizer_file() -> str:
    """The public vocabulary that the query is fixed to."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_file())


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM windows),
grams AS (
  SELECT r, i, k, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM d, sizes, unnest(range(1, len(w) - k + 2)) AS t(i) WHERE len(w) >= k),
hits AS (SELECT r, i, grams.k AS k, item FROM grams JOIN windows ON grams.g = windows.g AND grams.k = windows.k),
covered AS (SELECT r, count(DISTINCT i + j) AS n_hit FROM hits, unnest(range(0, k)) AS t(j) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS list FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""


OP3_SQL = r"""
WITH cut AS (
  SELECT page_id, row_number() OVER () AS r,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, r, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                                ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits AS (
  SELECT r, h || p AS rule, verdict, row_number() OVER (PARTITION BY r ORDER BY length(h || p) DESC) AS n
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fits WHERE n = 1) USING (r)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_html": op2_html,
        "op3_url": op3_url,
        "op4_quality": op4_quality,
        "op5_language": op5_language,
        "op6_sharding": op6_sharding,
        "op7_minhash": op7_minhash,
        "op8_toxicity": op8_toxicity,
        "op9_bpe": op9_bpe,
        "op10_decontaminate": op10_decontaminate,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_url": OP3_SQL, "op10_decontaminate": OP10_SQL}
