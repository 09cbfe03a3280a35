"""Language identification by interpolated Kneser-Ney character models.

One model of ORDER characters per language; the entries of all languages are merged
into sorted arrays of n-gram hashes, with one row of log-probabilities (a column for
each language) per n-gram and one row of back-off weights per context.  A whole text
is looked up position by position, all languages at once; the language of least
cross-entropy per character wins.  ``score`` is its share among the languages after as
many characters as the text has, EVIDENCE_CHARS at most.

Texts are compared as lower-case letters; any run of other characters is one space.
Characters are whole code points, so no script is folded into another.  N-grams of all
labelled rows outside the held-out fold are counted on the executors and summed; what the
driver gathers and the executors receive are tables of n-grams, never texts.  A model has
at most MAX_CELLS entries (n-grams times languages) of each order: beyond that the rarest
n-grams are left out and their mass goes to the back-off weights, so the probabilities stay
normalised; all totals and discounts are still those of all rows.

Rejection is calibrated on a sixteenth of those rows, with models that have not counted
that part: a text is rejected if its cross-entropy is further above its language's mean than
REJECT_NATS plus REJECT_SIGMAS standard errors for its length, or if it has no letters.  A
language without calibrating texts is never rejected.

Defined edge cases: null texts and texts without letters are ``und`` with score 0; rows
without language or id are not learned from; with no labelled row every text is ``und``;
repeated rows are repeated; other columns are carried or ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import crc_bucket, small_batches
from graphloom.plans.scratch import Scratch

ORDER = 4
MAX_CELLS = 1 << 21
REJECT_NATS = 0.5
REJECT_SIGMAS = 8.0
EVIDENCE_CHARS = 64
UNKNOWN = "und"
FOLDS, HELD_OUT = 4, 2
CALIBRATION_PARTS = 16

_BITS = 21  # of a code point
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BLOCK_CHARS = 1 << 17
_KEPT_GRAMS = 1 << 18


@cache
def _is_letter() -> np.ndarray:
    """Whether each code point is a letter: alphanumeric, but no decimal digit."""
    return np.fromiter((c.isalnum() and not c.isdecimal() for c in map(chr, range(0x110000))), dtype=bool, count=0x110000)


def letters(texts: Iterable[str | None], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-case letters of texts, one space for what else stands between them, and their numbers.

    ``pad`` spaces stand before every text.
    """
    low = [t.lower() if t else "" for t in texts]
    if not low:
        return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
    flat = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _is_letter()[flat]
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # the first other character after a letter stays, as a space
    starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in low])[:-1]))
    many = np.add.reduceat(kept, starts, dtype=np.int64)
    sizes = np.maximum(many - 1, 0)  # without the space after the last letter
    begins = np.concatenate(([0], np.cumsum(sizes + pad)[:-1])) + pad
    out = np.full(int(sizes.sum()) + pad * len(low), 32, dtype=np.uint32)
    within = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    inside = within < np.repeat(sizes, many)
    out[(np.repeat(begins, many) + within)[inside]] = np.where(letter, flat, np.uint32(32))[kept][inside]
    return out, sizes


def _places(sizes: np.ndarray, pad: int) -> np.ndarray:
    """Places of the texts' own characters in what letters() gives."""
    return np.arange(int(sizes.sum()), dtype=np.int64) + np.repeat(np.arange(1, len(sizes) + 1) * pad, sizes)


def _step(key: np.ndarray, char: np.ndarray) -> np.ndarray:
    """Hash of a sequence and one more character."""
    key = (key ^ char) * _MIX
    return key ^ (key >> np.uint64(29))


def _head_and_key(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n-grams, given one array a character, without and with their last character."""
    head = np.zeros(len(columns[0]), dtype=np.uint64)
    for c in columns[:-1]:
        head = _step(head, c)
    return head, _step(head, columns[-1])


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in a sorted array, and whether it is there."""
    if not len(table):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Grams(NamedTuple):
    """N-grams of one order that a model keeps.

    ``first`` and ``last`` pack two code points each; ``total`` is the count of all n-grams of the language that
    differ in the last character only, and ``cut`` the discount by language, both over kept and dropped ones.
    """

    language: np.ndarray
    first: np.ndarray
    last: np.ndarray
    count: np.ndarray
    total: np.ndarray
    cut: np.ndarray

    def columns(self, n: int) -> list[np.ndarray]:
        mask = (1 << _BITS) - 1
        both = [self.first >> _BITS, self.first & mask, self.last >> _BITS, self.last & mask]
        return [c.astype(np.uint64) for c in both[ORDER - n :]]


class Models:
    """Kneser-Ney models of several languages in merged sorted hash arrays."""

    def __init__(self, languages: Iterable[str], grams: dict[int, Grams], alphabet: int):
        self.languages, self.alphabet, wide = list(languages), alphabet, len(list(languages))
        self.keys, self.logp, self.contexts, self.backoff = {}, {}, {}, {}
        self.mean, self.spread = np.full(wide, np.inf), np.zeros(wide)
        for n in sorted(grams):
            g = grams[n]
            columns = g.columns(n)
            head, key = _head_and_key(columns)
            self.keys[n], first, place = np.unique(key, return_index=True, return_inverse=True)
            self.contexts[n], of = np.unique(head[first], return_inverse=True)
            left = np.zeros((len(first), wide))
            left[place, g.language] = np.maximum(g.count - g.cut[g.language], 0)
            total, kept = np.zeros((len(self.contexts[n]), wide)), np.zeros((len(self.contexts[n]), wide))
            total[of[place], g.language] = g.total
            np.add.at(kept, of, left)
            weight = np.where(total > 0, 1 - kept / np.maximum(total, 1), 1.0)
            lower = np.exp(self._log_p([c[first] for c in columns[1:]])) if n > 1 else 1.0 / alphabet
            self.logp[n] = np.log(left / np.maximum(total, 1)[of] + weight[of] * lower).astype(np.float32)
            self.backoff[n] = np.log(np.maximum(weight, 1e-30)).astype(np.float32)

    def _log_p(self, columns: list[np.ndarray]) -> np.ndarray:
        """Log-probabilities, a column for each language, of each n-gram's last character after the others."""
        out = np.empty((len(columns[-1]), len(self.languages)), dtype=np.float32)
        rows, passed = np.arange(len(out)), np.zeros((len(out), 1), dtype=np.float32)
        for n in range(len(columns), 0, -1):
            head, key = _head_and_key([c[rows] for c in columns[-n:]] if len(rows) < len(out) else columns[-n:])
            place, there = _find(self.keys[n], key)
            out[rows[there]] = self.logp[n][place[there]] + passed[there]
            gone = ~there
            rows = rows[gone]
            if not len(rows):
                return out
            passed = np.broadcast_to(passed[gone], (len(rows), out.shape[1])).copy()
            where, known = _find(self.contexts[n], head[gone])
            passed[known] += self.backoff[n][where[known]]
        out[rows] = passed - np.float32(np.log(self.alphabet))
        return out

    def losses(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy in nats a letter, letters, and mean square of the losses, per text (and language)."""
        texts = list(texts)
        total, sizes = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), dtype=np.int64)
        square, first, pad = np.zeros_like(total), 0, ORDER - 1
        while first < len(texts):
            last, room = first + 1, _BLOCK_CHARS - len(texts[first] or "")
            while last < len(texts) and room >= len(texts[last] or ""):
                room -= len(texts[last] or "")
                last += 1
            codes, own = letters(texts[first:last], pad)
            sizes[first:last] = own
            full = np.flatnonzero(own)
            if len(full):
                codes, at = codes.astype(np.uint64), _places(own, pad)
                lp = self._log_p([codes[at - back] for back in range(pad, -1, -1)])
                edge = np.concatenate(([0], np.cumsum(own[full])[:-1]))
                total[first + full] = -np.add.reduceat(lp, edge, axis=0, dtype=np.float64)
                square[first + full] = np.add.reduceat(lp * lp, edge, axis=0, dtype=np.float64)
            first = last
        n = np.maximum(sizes, 1)[:, None]
        return total / n, sizes, square / n

    def predict(self, texts: Iterable[str | None]) -> pd.DataFrame:
        """lang_pred, score and rejected of raw texts."""
        texts = list(texts)
        if not self.languages or not texts:
            return pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": [0.0] * len(texts), "rejected": [True] * len(texts)})
        loss, sizes, _ = self.losses(texts)
        best = loss.argmin(axis=1)
        least = loss[np.arange(len(texts)), best]
        odds = np.exp(-(loss - least[:, None]) * np.minimum(sizes, EVIDENCE_CHARS)[:, None]).sum(axis=1)
        bar = self.mean[best] + REJECT_NATS + REJECT_SIGMAS * self.spread[best] / np.sqrt(np.maximum(sizes, 1))
        names = np.array([*self.languages, UNKNOWN], dtype=object)
        empty = sizes == 0
        return pd.DataFrame(
            {
                "lang_pred": names[np.where(empty, len(self.languages), best)],
                "score": np.where(empty, 0.0, 1 / odds),
                "rejected": empty | (least > bar),
            }
        )


class Tally:
    """Counts of n-grams of ORDER by a label's number; merged now and then, so that memory is bounded."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, texts: list[str | None], labels: np.ndarray) -> None:
        codes, sizes = letters(texts, ORDER - 1)
        codes, at = codes.astype(np.uint64), _places(sizes, ORDER - 1)
        columns = [codes[at - back] for back in range(ORDER - 1, -1, -1)]
        label = np.repeat(labels, sizes)
        key = _step(_head_and_key(columns)[1], label.astype(np.uint64))
        _, one, many = np.unique(key, return_index=True, return_counts=True)
        first, last = ((columns[k][one] << np.uint64(_BITS) | columns[k + 1][one]).astype(np.int64) for k in (0, 2))
        self.parts.append((key[one], label[one], first, last, many))
        self.size += len(one)

    def merge(self) -> None:
        if len(self.parts) > 1:
            key, label, first, last, many = map(np.concatenate, zip(*self.parts, strict=True))
            _, one, place = np.unique(key, return_index=True, return_inverse=True)
            self.parts = [(key[one], label[one], first[one], last[one], np.bincount(place, weights=many).astype(np.int64))]
        self.size = sum(len(p[0]) for p in self.parts)

    def flush(self) -> tuple[np.ndarray, ...]:
        """Label numbers, packed code points and counts; nothing is held after that."""
        self.merge()
        out = self.parts[0][1:] if self.parts else tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
        self.parts, self.size = [], 0
        return out


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, part, first, last, n) of the n-grams of (lang, part, text) rows, added up as far as memory goes."""
    names: dict[tuple[str, bool], int] = {}
    tally = Tally()

    def rows() -> pd.DataFrame:
        label, first, last, many = tally.flush()
        known = list(names)
        lang, part = np.array([k[0] for k in known], dtype=object), np.array([k[1] for k in known], dtype=bool)
        return pd.DataFrame({"lang": lang[label], "part": part[label], "first": first, "last": last, "n": many})

    for batch in batches:
        texts, label = list(batch["text"]), np.array([names.setdefault(k, len(names)) for k in zip(batch["lang"], batch["part"], strict=True)], dtype=np.int64)
        begin, room = 0, 0
        for end, text in enumerate(texts, 1):
            room += len(text or "")
            if room >= _BLOCK_CHARS or end == len(texts):
                tally.add(texts[begin:end], label[begin:end])
                begin, room = end, 0
        if tally.size > _KEPT_GRAMS:
            tally.merge()
            if tally.size > _KEPT_GRAMS // 2:
                yield rows()
    if tally.size:
        yield rows()


def _orders(top: DataFrame) -> DataFrame:
    """(model, size, lang, first, last, n): counts of the highest order, numbers of distinct preceding characters below it."""
    mask = F.lit((1 << _BITS) - 1)
    out, below = top.withColumn("size", F.lit(ORDER)), top
    shorter = [(F.col("first").bitwiseAND(mask), F.col("last")), (F.lit(0).cast("long"), F.col("last")), (F.lit(0).cast("long"), F.col("last").bitwiseAND(mask))]
    for n, (first, last) in zip(range(ORDER - 1, 0, -1), shorter, strict=True):
        below = below.groupBy("model", "lang", first.alias("first"), last.alias("last")).agg(F.count("*").alias("n"))
        out = out.unionByName(below.withColumn("size", F.lit(n)))
    return out


def _least_counts(shares: pd.DataFrame, room: int) -> int:
    """The count above which at most ``room`` n-grams lie."""
    kept = 0
    for level, many in shares.groupby("level")["grams"].sum().sort_index(ascending=False).items():
        kept += many
        if kept > room:
            return int(level) * 2 - 1 if level >= 64 else int(level)
    return 0


def models_of(counts: DataFrame, scratch: Scratch, max_cells: int = MAX_CELLS) -> tuple[Models, Models]:
    """Models of all counts and of those outside the calibration part, from (lang, part, first, last, n) rows."""
    rest = F.sum(F.when(F.col("part"), 0).otherwise(F.col("n")))
    summed = counts.groupBy("lang", "first", "last").agg(F.sum("n").alias("all"), rest.alias("rest"))
    each = F.array(F.struct(F.lit(0).alias("model"), F.col("all").alias("n")), F.struct(F.lit(1).alias("model"), F.col("rest").alias("n")))
    top = scratch.save(summed.select("lang", "first", "last", F.explode(each).alias("m")).select("m.model", "lang", "first", "last", "m.n").where("n > 0"))
    grams = scratch.save(_orders(top))
    level = F.when(F.col("n") < 64, F.col("n")).otherwise(F.pow(F.lit(2), F.floor(F.log2("n"))).cast("long"))
    shares = grams.groupBy("model", "size", "lang", level.alias("level")).agg(F.count("*").alias("grams")).toArrow().to_pandas()
    alphabet = grams.where("size = 1").groupBy("model").agg(F.count_distinct("last").alias("n")).collect()
    alphabets = {r["model"]: r["n"] + 1 for r in alphabet}
    total = F.sum("n").over(Window.partitionBy("model", "size", "lang", "first", F.shiftright("last", _BITS)))
    out = []
    for model in (0, 1):
        mine = shares[shares["model"] == model]
        languages = sorted(mine["lang"].unique())
        least = {n: _least_counts(mine[mine["size"] == n], max(1, max_cells // max(1, len(languages)))) for n in range(1, ORDER + 1)}
        keep = F.create_map(*(F.lit(x) for n in least for x in (n, least[n])))[F.col("size")]
        numbers = {x: k for k, x in enumerate(languages)}
        found = grams.where(F.col("model") == model).withColumn("total", total).where(F.col("n") > keep).drop("model").toArrow().to_pandas()
        number = found["lang"].map(numbers).to_numpy(dtype=np.int64)
        parts = {}
        for n in range(1, ORDER + 1):
            own = (found["size"] == n).to_numpy()
            tail = mine[mine["size"] == n].pivot_table(index="lang", columns="level", values="grams", aggfunc="sum", fill_value=0).reindex(languages, fill_value=0)
            ones, twos = (tail[k].to_numpy(dtype=float) if k in tail else np.zeros(len(languages)) for k in (1, 2))
            cut = np.where(ones > 0, ones / np.maximum(1, ones + 2 * twos), 0.5)
            parts[n] = Grams(number[own], *(found[c].to_numpy()[own] for c in ("first", "last", "n", "total")), cut)
        out.append(Models(languages, parts if languages else {}, alphabets.get(model, 1)))
    return out[0], out[1]


def calibrate(models: Models, like: Models, known: DataFrame) -> None:
    """Mean loss a letter and its spread by language, of (lang, text) rows that ``like`` has not counted."""
    shared = known.sparkSession.sparkContext.broadcast(like)

    @F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("size", "loss", "square")]))
    def lost(languages: pd.Series, texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        loss, sizes, square = m.losses(texts)
        own = np.array([m.languages.index(x) if x in m.languages else -1 for x in languages], dtype=np.int64)
        at = np.arange(len(own))
        size = np.where(own >= 0, sizes, 0).astype(np.float64)
        return pd.DataFrame({"size": size, "loss": loss[at, own] * size, "square": square[at, own] * size} if m.languages else {c: np.zeros(len(own)) for c in ("size", "loss", "square")})

    sums = known.select("lang", lost("lang", "text").alias("l")).groupBy("lang").agg(*(F.sum(f"l.{c}").alias(c) for c in ("size", "loss", "square"))).where("size > 0").collect()
    for r in sums:
        k = models.languages.index(r["lang"])
        models.mean[k] = r["loss"] / r["size"]
        models.spread[k] = np.sqrt(max(1e-6, r["square"] / r["size"] - models.mean[k] ** 2))


def fit(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, max_cells: int = MAX_CELLS) -> Models:
    """Models from text and language of the rows outside the held-out fold."""
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "language")
    part: Column = F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATION_PARTS)) == 0
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_bucket(F.col("doc_id"), folds) != held_out)).select("lang", part.alias("part"), "text")
    counts = known.mapInPandas(_counted, "lang string, part boolean, first long, last long, n long")
    models, rest = models_of(counts, scratch, max_cells)
    if models.languages:
        calibrate(models, rest, known.where("part").select("lang", "text"))
    return models


def identify(docs: DataFrame, models: Models) -> DataFrame:
    """The documents with a column __lang: lang_pred, score, rejected."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(models)
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.DataFrame:
        return shared.value.predict(texts)

    return docs.withColumn("__lang", run(F.col("text")))
