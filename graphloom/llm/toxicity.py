"""Toxic spans by a linear-chain conditional random field.

Tokens are labelled from document labels: a greedy cover picks the words and word
beginnings that occur in labelled toxic documents far more often than in clean ones, and their occurrences in toxic documents are the toxic tokens.  A two-state chain with
features of the word and its beginnings (3 to 8 characters) is fitted to these sequences by
exact gradients.  Forward-backward marginals give the toxic spans with their offsets; the
expected number of toxic tokens gives the document's score through a logistic calibration.

Both recursions run as scans of fractional linear maps over all tokens of a batch at once;
they equal the token-by-token recursion.  The model is fitted on the driver from a bounded
sample of labelled rows (SAMPLE_TOXIC and SAMPLE_CLEAN documents chosen by a hash of their
ids, and of these in that order as many whole ones as make SAMPLE_BYTES of text, half of it for
each class); every document is scored over its whole text.

Defined edge cases: null, empty or wordless texts get the calibrated score of no toxic
token; with no labelled row of either class all scores are 0; rows without id or label are
not learned from; repeated rows are repeated; other columns are carried or ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable
from itertools import accumulate, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from graphloom.llm.common import crc_bucket, small_batches
from graphloom.llm.sampling import bounded_sample

SAMPLE_TOXIC = 1200
SAMPLE_CLEAN = 1200
#: Text that the driver can hold and learn from: 2,400 documents of 7 KB, twice the given tables' sample.
SAMPLE_BYTES = 1 << 24
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.5
MIN_COVER = 2
CLEAN_COST = 3.0
ROUNDS = 40
KEPT_WORDS = 60_000
BLOCK_TOKENS = 1 << 16
BLOCK_CHARS = 1 << 20

_WORD = re.compile(r"\w+")
_HUGE = 20.0
_NONE = 1e-3


def words_of(text: str | None) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)] if text else []


def features(word: str) -> list[str]:
    """The word, and its beginnings of 3 to 8 characters."""
    return ["=" + word, *(word[:n] for n in range(3, min(8, len(word)) + 1))]


def scan(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """All r[t] = (b + r[t-1] d) / (a + r[t-1] c) for r[-1] = 1, in square-root many steps."""
    n = len(a)
    if not n:
        return np.zeros(0)
    steps = max(1, int(np.sqrt(n)))
    blocks = -(-n // steps)

    def dealt(x: np.ndarray, rest: float) -> np.ndarray:
        return np.ascontiguousarray(np.concatenate([x, np.full(steps * blocks - n, rest)]).reshape(blocks, steps).T)

    a, b, c, d = dealt(a, 1.0), dealt(b, 0.0), dealt(c, 0.0), dealt(d, 1.0)
    p, q, u, v = np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)
    for t in range(steps):
        p, q, u, v = a[t] * p + c[t] * q, b[t] * p + d[t] * q, a[t] * u + c[t] * v, b[t] * u + d[t] * v
        if t % 8 == 7:
            s = p + q + u + v
            p, q, u, v = p / s, q / s, u / s, v / s
    first = np.empty(blocks)
    r = 1.0
    for k, (p1, q1, u1, v1) in enumerate(zip(p.tolist(), q.tolist(), u.tolist(), v.tolist(), strict=True)):
        first[k] = r
        r = (q1 + r * v1) / (p1 + r * u1)
    out = np.empty((steps, blocks))
    r = first
    for t in range(steps):
        r = (b[t] + r * d[t]) / (a[t] + r * c[t])
        out[t] = r
    return out.T.reshape(-1)[:n]


class Chain:
    """Two-state chain: state 1 is toxic.  Scores are log-potentials relative to state 0."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        self.bias = 0.0
        self.start = 0.0
        self.move = np.zeros((2, 2))
        self.beta = np.array([-np.inf, 0.0, 0.0, 0.0])
        self._known: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}}

    def emission(self, word: str) -> float:
        known = self._known.get(word)
        if known is None:
            known = self.bias + sum(self.weights.get(f, 0.0) for f in features(word))
            if len(self._known) >= KEPT_WORDS:
                self._known.clear()
            self._known[word] = known
        return known

    def passes(self, e: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward ratios, backward ratios and potentials of all tokens; starts: first tokens of texts."""
        x = np.exp(np.clip(e, -_HUGE, _HUGE))
        m = np.exp(self.move)
        fresh = np.zeros(len(e), dtype=bool)
        fresh[starts] = True
        forward = scan(
            np.where(fresh, 1.0, m[0, 0]),
            np.where(fresh, np.exp(self.start), m[0, 1]) * x,
            np.where(fresh, 0.0, m[1, 0]),
            np.where(fresh, 0.0, m[1, 1]) * x,
        )
        after = np.append(fresh[1:], True)
        nx = np.append(x[1:], 1.0)
        backward = scan(
            np.where(after, 1.0, m[0, 0])[::-1],
            np.where(after, 1.0, m[1, 0])[::-1],
            (np.where(after, 0.0, m[0, 1]) * nx)[::-1],
            (np.where(after, 0.0, m[1, 1]) * nx)[::-1],
        )[::-1]
        return forward, backward, x

    def marginals(self, texts: Iterable[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """P(toxic) of all tokens one text after another, and the bounds of the texts."""
        texts = list(texts)
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        e = np.fromiter((self.emission(w) for t in texts for w in t), dtype=np.float64, count=int(bounds[-1]))
        forward, backward, _ = self.passes(e, bounds[:-1][np.diff(bounds) > 0])
        odds = forward * backward
        return odds / (1 + odds), bounds

    def expected(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected number of toxic tokens of each text, and what marginals() gives."""
        p, bounds = self.marginals(texts)
        sums = np.add.reduceat(np.append(p, 0.0), np.minimum(bounds[:-1], len(p))) * (np.diff(bounds) > 0) if len(texts) else np.zeros(0)
        return sums, p, bounds

    def scores(self, expected: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Calibrated scores of documents with so many expected toxic words among so many words."""
        return 1 / (1 + np.exp(np.clip(-_evidence(expected, words) @ self.beta, -700, 700))) if np.isfinite(self.beta[0]) else np.zeros(len(words))

    def read(self, texts: Iterable[str | None]) -> pd.DataFrame:
        """score and spans (code point offsets of toxic runs, end exclusive) of raw texts, about BLOCK_CHARS at a time."""
        texts = list(texts)
        ends = np.cumsum([0, *(len(t or "") for t in texts)]) // BLOCK_CHARS
        cuts = [*np.flatnonzero(np.diff(ends[:-1], prepend=-1)).tolist(), len(texts)]
        return pd.concat([self._read(texts[a:z]) for a, z in pairwise(cuts)] or [self._read([])], ignore_index=True)

    def _read(self, texts: list[str | None]) -> pd.DataFrame:
        expected, p, bounds = self.expected([words_of(t) for t in texts])
        spans: list[list[dict]] = [[] for _ in texts]
        for k in np.unique(np.searchsorted(bounds, np.flatnonzero(p >= THRESHOLD), side="right") - 1).tolist():
            last = -2
            for i, m in enumerate(_WORD.finditer(texts[k])):
                if p[bounds[k] + i] >= THRESHOLD:
                    if last == i - 1:
                        spans[k][-1]["end"] = m.end()
                    else:
                        spans[k].append({"start": m.start(), "end": m.end()})
                    last = i
        return pd.DataFrame({"score": self.scores(expected, np.diff(bounds)), "spans": spans})


def frequent(docs: Iterable[list[str]], least: int = MIN_COVER) -> Callable[[str], list[str]]:
    """Features of a word that about ``least`` documents or more have; counted in hashed cells, so some rarer ones pass."""
    cells = np.zeros(1 << 22, dtype=np.int32)
    cell = lambda f: zlib.crc32(f.encode("utf-8", "surrogatepass")) & (len(cells) - 1)
    for t in docs:
        cells[list({cell(f) for w in set(t) for f in features(w)})] += 1
    return lambda word: [f for f in features(word) if cells[cell(f)] >= least]


def lexicon(toxic: list[list[str]], clean: list[list[str]], known: Callable[[str], list[str]] = features) -> set[str]:
    """Features that cover the toxic documents; each clean document with one costs CLEAN_COST of its share."""
    held: dict[str, set[int]] = defaultdict(set)
    for n, t in enumerate(toxic):
        for f in {f for w in set(t) for f in known(w)}:
            held[f].add(n)
    total = max(len(held), sum(map(len, toxic)))
    held = {f: d for f, d in held.items() if len(d) >= MIN_COVER}
    absent = Counter(f for t in clean for f in {f for w in set(t) for f in known(w) if f in held})
    cost = CLEAN_COST * len(toxic) / max(1, len(clean))
    good = {f: d for f, d in held.items() if len(d) - cost * absent[f] >= MIN_COVER}
    chosen: set[str] = set()
    open_docs = set(range(len(toxic)))
    while good:
        gain = {f: len(d & open_docs) - cost * absent[f] for f, d in good.items()}
        good = {f: d for f, d in good.items() if gain[f] >= MIN_COVER}
        if not good:
            break
        best = max(good, key=lambda f: (gain[f], len(good[f]), len(f), f))
        chosen.add(best)
        open_docs -= good.pop(best)
    # The cover leaves out words that only repeat what others cover: add all that no chance explains.
    share = len(toxic) / max(1, len(toxic) + len(clean))
    least = max(MIN_COVER + 1, np.log(20 * max(1, total)) / -np.log(max(1e-6, min(share, 0.95))))
    return chosen | {f for f, d in held.items() if len(d) >= least and absent[f] <= 0.01 * len(d) / max(share, 1e-6)}


def train(toxic: list[str], clean: list[str]) -> Chain:
    """Chain fitted by full-batch adaptive gradients with exact expectations."""
    chain = Chain()
    same: dict[str, str] = {}
    bad, good = ([[same.setdefault(w, w) for w in words_of(t)] for t in texts] for texts in (toxic, clean))
    known = frequent([*bad, *good])
    del same
    marks = lexicon(bad, good, known)
    if not marks:
        return chain
    texts = [t for t in [*bad, *good] if t]
    toxic_texts = sum(1 for t in bad if t)
    flags = [n < toxic_texts for n in range(len(texts))]
    number: dict[str, int] = {}
    tokens = np.fromiter((number.setdefault(w, len(number)) for t in texts for w in t), dtype=np.int64)
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    marked = np.fromiter((any(f in marks for f in features(w)) for w in number), dtype=bool, count=len(number))
    truth = (marked[tokens] & np.repeat(flags, np.diff(bounds))).astype(np.float64)
    names: dict[str, int] = {}
    by = [np.array([names.setdefault(f, len(names)) for f in known(w)], dtype=np.int32) for w in number]
    of_word, of_name = np.repeat(np.arange(len(by), dtype=np.int32), [len(x) for x in by]), np.concatenate(by)
    blocks = _blocks(bounds)
    theta = np.zeros(len(names) + 6)  # features, bias, start, moves
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, ROUNDS + 1):
        w, chain.bias, chain.start = theta[:-6], theta[-6], theta[-5]
        chain.move = theta[-4:].reshape(2, 2)
        of = np.bincount(of_word, weights=w[of_name], minlength=len(number)) + chain.bias
        by_word, at_start, moves = np.zeros(len(number)), 0.0, np.zeros((2, 2))
        for b in blocks:  # so that memory does not follow the sample
            part, true = tokens[b[0] : b[-1]], truth[b[0] : b[-1]]
            miss, step = _misfit(chain, of[part], b[:-1] - b[0], true)
            by_word += np.bincount(part, weights=miss, minlength=len(number))
            at_start += miss[b[:-1] - b[0]].sum()
            moves += step
        grad = np.concatenate([np.bincount(of_name, weights=by_word[of_word], minlength=len(names)), [by_word.sum(), at_start], moves.ravel()])
        grad -= 0.01 * theta
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
        theta = theta + 0.5 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-6)
    chain.bias, chain.start, chain.move = float(theta[-6]), float(theta[-5]), theta[-4:].reshape(2, 2)
    chain.weights = {f: float(theta[k]) for f, k in names.items()}
    expected = np.concatenate([chain.expected(texts[a:z])[0] for a, z in pairwise(np.searchsorted(bounds, [b[0] for b in blocks] + [bounds[-1]]).tolist())])
    chain.beta = _calibrated(_evidence(expected, np.diff(bounds)), np.array(flags, dtype=np.float64))
    return chain


def _blocks(bounds: np.ndarray, most: int = BLOCK_TOKENS) -> list[np.ndarray]:
    """Bounds of neighbouring texts that have about ``most`` tokens together; no text is split."""
    cut = np.flatnonzero(np.diff(bounds[:-1] // most, prepend=-1))
    return [bounds[a : z + 1] for a, z in pairwise([*cut.tolist(), len(bounds) - 1])]


def _misfit(chain: Chain, e: np.ndarray, starts: np.ndarray, truth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Truth less expectation: by token, and of the four moves summed."""
    forward, backward, x = chain.passes(e, starts)
    p = forward * backward / (1 + forward * backward)
    inner = np.ones(len(e), dtype=bool)
    inner[starts] = False
    here = np.flatnonzero(inner)
    before, m = here - 1, np.exp(chain.move)
    f, bx = forward[before], (backward * x)[here]
    whole = m[0, 0] + m[0, 1] * bx + f * m[1, 0] + f * m[1, 1] * bx
    now, then = truth[here], truth[before]
    found = [[m[0, 0] / whole, m[0, 1] * bx / whole], [f * m[1, 0] / whole, f * m[1, 1] * bx / whole]]
    true = [[(1 - then) * (1 - now), (1 - then) * now], [then * (1 - now), then * now]]
    return truth - p, np.array([[(t - g).sum() for t, g in zip(*pair, strict=True)] for pair in zip(true, found, strict=True)])


def _evidence(expected: np.ndarray, words: np.ndarray) -> np.ndarray:
    """What a document's score is computed from: expected toxic words, on two scales, and its length."""
    return np.stack([np.ones(len(words)), np.log(expected + _NONE), np.log1p(expected), np.log1p(words)], axis=1)


def _calibrated(design: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression (ridge 0.1, damped Newton steps)."""
    beta = np.zeros(design.shape[1])
    for _ in range(40):
        q = 1 / (1 + np.exp(np.clip(-design @ beta, -50, 50)))
        h = (design * (q * (1 - q))[:, None]).T @ design + 0.1 * np.eye(len(beta))
        beta = beta + np.clip(np.linalg.solve(h, design.T @ (y - q) - 0.1 * beta), -2, 2)
    return beta


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, sample_bytes: int = SAMPLE_BYTES) -> Chain:
    """Chain from the labelled documents outside the held-out fold."""
    known = labels.where(F.col("toxic").isin(0, 1) & (crc_bucket(F.col("doc_id"), folds) != held_out)).select("doc_id", "toxic").distinct()
    bad = bounded_sample(known.where("toxic = 1"), "doc_id", "toxic", SAMPLE_TOXIC)
    fine = bounded_sample(known.where("toxic = 0"), "doc_id", "toxic", SAMPLE_CLEAN)
    ids = F.broadcast(bad.unionByName(fine))  # at most about SAMPLE_TOXIC + SAMPLE_CLEAN ids
    size = F.sum(F.octet_length("text")).alias("size")
    found = docs.select("doc_id", "text").join(ids, "doc_id").groupBy("doc_id", "toxic").agg(size).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    kept = [(r["doc_id"], c) for c in (0, 1) for r in _within([r for r in found if r["toxic"] == c], sample_bytes // 2)]
    # By Arrow, as a list of rows would start another set of Python workers on every executor.
    columns = to_arrow_schema(known.schema)
    listed = pa.Table.from_pylist([dict(zip(columns.names, k, strict=True)) for k in kept], schema=columns)
    few = F.broadcast(docs.sparkSession.createDataFrame(listed, known.schema))
    rows = docs.select("doc_id", "text").join(few, "doc_id").orderBy("doc_id", "text").collect()
    return train([r["text"] for r in rows if r["toxic"] == 1], [r["text"] for r in rows if r["toxic"] == 0])


def _within(rows: list[Row], most: int) -> list[Row]:
    """The first rows, in their order, whose sizes together are within ``most``; larger ones are passed over, and if all are, the least is taken."""
    fit = [r for r in rows if (r["size"] or 0) <= most] or sorted(rows, key=lambda r: r["size"])[:1]
    return [r for r, before in zip(fit, accumulate((r["size"] or 0 for r in fit), initial=0), strict=False) if before + (r["size"] or 0) <= most] or fit[:1]


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """The documents with a column __tox: score and spans."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])

    @F.pandas_udf(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))]))
    def run(texts: pd.Series) -> pd.DataFrame:
        return shared.value.read(texts)

    return docs.withColumn("__tox", run(F.col("text")))
