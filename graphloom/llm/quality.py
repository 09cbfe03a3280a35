"""Document quality by hierarchical empirical Bayes over sites.

A logistic classifier on surface features of the whole text gives each document a
probability.  Probabilities of all documents are summed by site and section (host and
path); method-of-moments priors, estimated from all sites and from all sections, shrink
each site's rate toward the global rate and each section's toward its site's, the more the
fewer documents it has.  A document's score adds its own evidence to its section's
posterior, of which the document itself is left out.

Only the classifier is fitted on the driver, on the features (never the texts) of a bounded
sample of labelled rows (SAMPLE_PER_CLASS of each label by a hash of their ids).  Site statistics are grouped
sums over all documents with partial aggregation, so a site with a third of all rows
costs no more than others; sums are kept in millionths, whole numbers, so they do not
depend on the order of rows.

Defined edge cases: null texts are empty; a null host or path is a site of its own; rows
without label or id are not learned from; with no labelled row of either class the
classifier says one half; repeated rows are repeated and count; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import crc_bucket, small_batches, utf8
from graphloom.llm.sampling import bounded_sample
from graphloom.plans.scratch import Scratch

SAMPLE_PER_CLASS = 3000
FOLDS, HELD_OUT = 5, 0
SITE_WEIGHT = 0.5
KEEP = 0.5
JOIN_ROWS = 20_000
_UNIT = 1_000_000
_FLOOR = 1e-4

_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_CAPITALS = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_SPACE = b" \t\n\r\x0b\x0c"


def features(text: str | None) -> list[float]:
    """Surface features of a whole text, all of them shares or logarithms."""
    raw = utf8(text)
    n = max(1, len(raw))
    words = raw.split()
    k = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = n - len(raw.translate(None, _LETTERS))
    capitals = n - len(raw.translate(None, _CAPITALS))
    digits = n - len(raw.translate(None, _DIGITS))
    spaces = n - len(raw.translate(None, _SPACE))
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        np.log1p(len(words)),
        letters / n,
        capitals / n,
        digits / n,
        1 - (letters + digits + spaces) / n,
        sum(map(len, words)) / k / 10,
        len(set(words)) / k,
        pairs / max(1, k - 1),
        len(set(lines)) / max(1, len(lines)),
        np.log1p(k / max(1, len(lines))),
        sum(w[-1:] in b".!?" for w in words) / k,
        sum(not w.isalnum() for w in words) / k,
        np.log1p(max(map(len, words), default=0)),
    ]


class Classifier:
    """Ridge logistic regression on standardised features and their squares."""

    def __init__(self, good: list[list[float]], bad: list[list[float]]):
        self.ready = bool(good) and bool(bad)
        if not self.ready:
            return
        raw = np.array([*good, *bad])
        self.mean, self.scale = raw.mean(axis=0), raw.std(axis=0) + 1e-6
        x = self._design(raw)
        y = np.repeat([1.0, 0.0], [len(good), len(bad)])
        weight = np.repeat([0.5 / len(good), 0.5 / len(bad)], [len(good), len(bad)]) * len(y)  # classes count alike
        self.beta = np.zeros(x.shape[1])
        for _ in range(30):
            p = self._logistic(x)
            h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(len(self.beta))
            self.beta = self.beta + np.clip(np.linalg.solve(h, x.T @ (weight * (y - p)) - self.beta), -2, 2)

    def _design(self, raw: np.ndarray) -> np.ndarray:
        z = np.clip((raw - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.ones((len(z), 1)), z, z * z - 1], axis=1)

    def _logistic(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.beta, -30, 30)))

    def probabilities(self, texts: pd.Series) -> np.ndarray:
        if not self.ready or not len(texts):
            return np.full(len(texts), 0.5)
        return np.clip(self._logistic(self._design(np.array([features(t) for t in texts]))), _FLOOR, 1 - _FLOOR)


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> Classifier:
    """Classifier from the labelled documents outside the held-out fold."""
    known = labels.where(F.col("quality").isin(0, 1) & (crc_bucket(F.col("doc_id"), folds) != held_out)).select("doc_id", "quality").distinct()
    small_batches(docs.sparkSession)
    ids = F.broadcast(bounded_sample(known, "doc_id", "quality", SAMPLE_PER_CLASS))  # about twice SAMPLE_PER_CLASS ids
    rows = docs.select("doc_id", "text").join(ids, "doc_id").select("quality", _features("text").alias("f")).collect()
    found = sorted((r["quality"], r["f"]) for r in rows)  # the fit does not depend on how rows arrive
    return Classifier([f for q, f in found if q == 1], [f for q, f in found if q == 0])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _features(texts: pd.Series) -> pd.Series:
    return pd.Series([features(t) for t in texts], dtype=object)


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(_FLOOR)), F.lit(1 - _FLOOR))
    return F.log(q / (1 - q))


def _strength(rate: Column) -> Column:
    """Prior documents (1 to 1000) by moments: how far group rates spread around ``rate`` beyond sampling noise."""
    inner = F.sum(F.col("n") * rate * (1 - rate))
    spread = F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - rate, 2))
    noise = F.sum(rate * (1 - rate))
    between = F.greatest((spread - noise) / F.greatest(F.sum("n"), F.lit(1.0)), F.lit(1e-9))
    return F.least(F.greatest(inner / F.greatest(F.sum("n"), F.lit(1.0)) / between - 1, F.lit(1.0)), F.lit(1000.0))


def score(docs: DataFrame, classifier: Classifier, host: Column, path: Column) -> DataFrame:
    """doc_id, doc_score, host_rate, path_rate, score and keep of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(classifier)

    @F.pandas_udf(T.LongType())
    def evidence(texts: pd.Series) -> pd.Series:
        return pd.Series(np.rint(shared.value.probabilities(texts) * _UNIT).astype(np.int64))

    scratch = Scratch(spark, "quality")
    site = F.coalesce(F.concat(F.lit("="), host.cast("string")), F.lit("null"))
    section = F.coalesce(F.concat(F.lit("="), path.cast("string")), F.lit("null"))
    marked = scratch.save(docs.select("doc_id", site.alias("site"), section.alias("section"), evidence(F.col("text")).alias("p")))
    sections = scratch.save(marked.groupBy("site", "section").agg(F.count("*").cast("double").alias("n"), (F.sum("p") / _UNIT).alias("good")))
    sites = scratch.save(sections.groupBy("site").agg(F.sum("n").alias("n"), F.sum("good").alias("good")))
    overall = sites.agg(F.sum("good") / F.greatest(F.sum("n"), F.lit(1.0))).first()[0]
    overall = 0.5 if overall is None else float(overall)
    site_prior = sites.agg(_strength(F.lit(overall))).first()[0] or 1.0
    sites = sites.select("site", ((F.col("good") + site_prior * overall) / (F.col("n") + site_prior)).alias("host_rate"))
    both = scratch.save(sections.join(sites.hint("merge"), "site"))
    section_prior = both.agg(_strength(F.col("host_rate"))).first()[0] or 1.0
    own = F.col("p") / F.lit(float(_UNIT))
    rate = (F.col("good") - own + section_prior * F.col("host_rate")) / (F.col("n") - 1 + section_prior)
    # Sites grow with the corpus: a table of over JOIN_ROWS sections is joined by shuffle.
    both = F.broadcast(both) if both.count() <= JOIN_ROWS else both.hint("merge")
    out = marked.join(both, ["site", "section"]).withColumns({"own": own, "path_rate": rate})
    total = _logit(F.col("own")) + SITE_WEIGHT * (_logit(F.col("path_rate")) - _logit(F.lit(overall)))
    out = out.withColumn("score", F.round(1 / (1 + F.exp(-total)), 6))
    return out.select("doc_id", F.col("own").alias("doc_score"), F.round("host_rate", 6).alias("host_rate"), F.round("path_rate", 6).alias("path_rate"), "score", (F.col("score") >= KEEP).alias("keep"))
