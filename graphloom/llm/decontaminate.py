"""Benchmark decontamination with a generalised suffix automaton over words.

The benchmark items, as word sequences, are inserted into one suffix automaton.
Document words are streamed through it while the length of the longest current match is
tracked; wherever it reaches the window (ten words, or a whole item that is shorter) the
matched words are hit.  A document is one record, so no shuffle is needed at all.

A run of document words can only hold a window if each neighbouring pair of its words
is a pair of some item; runs are found with array operations on word numbers, and only
those are streamed, which leaves the automaton's result as it is.

The automaton is bounded: items go into blocks of at most BLOCK_WORDS words, built one
at a time from a driver-side iterator, and every document meets every block.  With
more than one block the documents are written once with a row number; each further pass
writes only the spans and items of rows that it hits, which are joined by that number.

Defined edge cases: null or empty texts have no words and no hits; items without words
have no window; repeated items count once by id, an item with a null id takes part as
``null``; repeated documents are repeated; an empty benchmark hits nothing; columns of
the documents are carried as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import small_batches, utf8
from graphloom.plans.scratch import Scratch

WINDOW = 10
MAX_COVERAGE = 0.5
BLOCK_WORDS = 200_000

#: Words are runs of digits, letters and bytes over 7F; everything else becomes a space, length unchanged.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_RUN = re.compile(rb"[^ ]+")

_FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
#: And what is left of a text that has hits.
_FOUND_REST = T.StructType([*_FOUND.fields, T.StructField("rest", T.StringType())])


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).translate(_WORDS).split()


class Automaton:
    """Suffix automaton of several word sequences; states carry the items of their windows."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.length, self.link, self.step = [0], [-1], [{}]
        pairs, self.least = set(), window
        kept = []
        for item, words in items:
            if words:
                ids = [self.number.setdefault(w, len(self.number)) for w in words]
                kept.append((item, ids))
                self.least = min(self.least, len(ids))
                pairs.update(zip(ids, ids[1:], strict=False))
                self._insert(ids)
        self.base = max(1, len(self.number))
        self.pairs = np.array(sorted(a * self.base + b for a, b in pairs), dtype=np.int64)
        self._mark(kept)

    def _new(self, length: int, link: int, step: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.step.append(step)
        return len(self.length) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """The state for exactly the strings of q up to length[p] + 1."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.step[q]))
        self.link[q] = clone
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = clone
            p = self.link[p]
        return clone

    def _insert(self, ids: list[int]) -> None:
        last = 0
        for word in ids:
            known = self.step[last].get(word)
            if known is not None:
                last = self._split(last, word, known)
                continue
            new, p = self._new(self.length[last] + 1, 0, {}), last
            while p >= 0 and word not in self.step[p]:
                self.step[p][word] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, word, self.step[p][word])
            last = new

    def _mark(self, kept: list[tuple[str, list[int]]]) -> None:
        """Items of each state that holds a whole window, and items shorter than a window."""
        self.items: dict[int, set[str]] = {}
        self.whole: dict[int, list[tuple[int, str]]] = {}
        for item, ids in kept:
            state = 0
            for n, word in enumerate(ids, 1):
                state = self.step[state][word]
                if n >= self.window:
                    self.items.setdefault(self._at_window(state), set()).add(item)
            if len(ids) < self.window:
                marks = self.whole.setdefault(state, [])
                if (len(ids), item) not in marks:
                    marks.append((len(ids), item))
        self.step_up = [-1] * len(self.length)  # nearest state up the links with a short item
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            up = self.link[s]
            self.step_up[s] = up if up in self.whole else self.step_up[up] if up > 0 else -1

    def _at_window(self, state: int) -> int:
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def _runs(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Word ranges that may hold a window."""
        if self.least == 1:
            good = ids >= 0
        else:
            a, b = ids[:-1], ids[1:]
            code = np.where((a >= 0) & (b >= 0), a.astype(np.int64) * self.base + b, -1)
            at = np.searchsorted(self.pairs, code)
            good = (at < len(self.pairs)) & (self.pairs[np.minimum(at, max(0, len(self.pairs) - 1))] == code) if len(self.pairs) else code == -2
        edge = np.flatnonzero(np.diff(np.concatenate(([0], good.view(np.int8), [0]))))
        more = 0 if self.least == 1 else 1
        for start, end in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if end - start + more >= self.least:
                yield start, end + more

    def find(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Merged ranges of hit words, and the items whose windows occur."""
        spans: list[list[int]] = []
        hit: set[str] = set()
        if not self.number or len(words) < self.least:
            return spans, hit
        ids = np.fromiter(map(self.number.get, words, repeat(-1)), dtype=np.int32, count=len(words))
        step, link, length = self.step, self.link, self.length
        for start, end in self._runs(ids):
            state = size = 0
            for i, word in enumerate(ids[start:end].tolist(), start):
                while state and word not in step[state]:
                    state = link[state]
                    size = length[state]
                if word in step[state]:
                    state, size = step[state][word], size + 1
                most = 0
                if size >= self.window:
                    most = self.window
                    hit |= self.items[self._at_window(state)]
                at, reach = (state, size) if state in self.whole else (self.step_up[state], -1) if state else (-1, 0)
                while at > 0:
                    for n, item in self.whole[at]:
                        if reach < 0 or n <= reach:
                            most = max(most, n)
                            hit.add(item)
                    at, reach = self.step_up[at], -1
                if most:
                    begin = i - most + 1
                    while spans and begin <= spans[-1][0]:
                        spans.pop()
                    if spans and begin <= spans[-1][1]:
                        spans[-1][1] = i + 1
                    else:
                        spans.append([begin, i + 1])
        return spans, hit


def automata(items: Iterable[tuple[object, str | None]], window: int, block_words: int) -> Iterator[Automaton]:
    """One automaton for each block of items; at least one, which may be empty."""
    block, size, made = [], 0, 0
    for item, text in items:
        words = words_of(text)
        if block and size + len(words) > block_words:
            yield Automaton(block, window)
            block, size, made = [], 0, made + 1
        block.append((str(item) if item is not None else "null", words))
        size += len(words)
    if block or not made:
        yield Automaton(block, window)


def _scanner(shared: Broadcast, cutting: bool = False):
    """Column function that gives the hits of texts against one automaton, if ``cutting`` with what they leave.

    It counts as nondeterministic, else filters on the hits would scan every text once more, in a Python worker of their own.
    """
    kind = _FOUND_REST if cutting else _FOUND

    @F.pandas_udf(kind)
    def scan(texts: pd.Series) -> pd.DataFrame:
        found = []
        for t in texts:
            words = words_of(t)
            spans, hit = shared.value.find(words)
            found.append((len(words), spans, sorted(hit), cut(t, spans) if spans and cutting else None)[: len(kind)])
        return pd.DataFrame(found, columns=kind.names, dtype=object)

    return scan.asNondeterministic()


@F.pandas_udf(T.StructType([T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("rest", T.StringType())]))
def _united(spans: pd.Series, texts: pd.Series) -> pd.DataFrame:
    """The union of the spans, and what it leaves of a text that has any."""
    whole = [_merged([[int(a), int(b)] for a, b in v]) for v in spans]
    rest = [cut(t, v) if v and t else None for v, t in zip(whole, texts, strict=True)]
    return pd.DataFrame({"spans": pd.Series(whole, dtype=object), "rest": pd.Series(rest, dtype=object)})


_united = _united.asNondeterministic()


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, cutting: bool = False) -> DataFrame:
    """The documents with a column __found: n_words, spans (ranges of hit words) and items (sorted ids), if ``cutting`` with rest.

    ``rest`` is the text without the spans, and null where there are none.
    """
    spark, row = docs.sparkSession, "__decontaminate_row"
    small_batches(spark)
    items = ((r[0], r[1]) for r in benchmark.select("item_id", "text").toLocalIterator())
    text, none = F.col("text"), F.array()
    first = numbered = more = None
    for automaton in automata(items, window, block_words):
        shared = spark.sparkContext.broadcast(automaton)
        if first is None:
            first = shared
            continue
        if numbered is None:
            scratch = Scratch(spark, "decontaminate")
            numbered = scratch.save(docs.withColumn(row, F.monotonically_increasing_id()))
        hits = numbered.select(row, _scanner(shared)(text).alias("f")).where("size(f.spans) > 0").select(row, "f.spans", "f.items")
        hits = scratch.save(hits)
        more = hits if more is None else more.unionByName(hits)
    if more is None:
        return docs.withColumn("__found", _scanner(first, cutting)(text))
    folded = more.groupBy(row).agg(F.flatten(F.collect_list("spans")).alias("__spans"), F.flatten(F.collect_list("items")).alias("__items"))
    both = F.struct(
        F.col("__found.n_words").alias("n_words"),
        F.col("__united.spans").alias("spans"),
        F.array_sort(F.array_union("__found.items", F.coalesce("__items", none.cast("array<string>")))).alias("items"),
        *([F.col("__united.rest").alias("rest")] if cutting else []),
    )
    out = numbered.withColumn("__found", _scanner(first)(text)).join(folded, row, "left")
    spans = F.concat("__found.spans", F.coalesce("__spans", none.cast("array<array<bigint>>")))
    out = out.withColumn("__united", _united(spans, text if cutting else F.lit(None).cast("string")))
    return out.withColumn("__found", both).select(*docs.columns, "__found")


def hit_words(found: Column) -> Column:
    return F.aggregate(found.getField("spans"), F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: words, hit words, items with occurring windows (count and digest), contaminated."""
    found = F.col("__found")
    return matches(docs.select("doc_id", "text"), benchmark, window, block_words).select(
        "doc_id",
        found.n_words.alias("n_words"),
        hit_words(found).alias("n_hit"),
        F.size(found.getField("items")).cast("long").alias("n_items"),
        F.sha2(F.array_join(found.getField("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size(found.spans) > 0).alias("contaminated"),
    )


def cut(text: str | None, spans: Iterable[Iterable[int]]) -> str:
    """The text without the given ranges of words; the pieces are joined by one space."""
    raw = utf8(text)
    at = [m.span() for m in _RUN.finditer(raw.translate(_WORDS))]
    kept, begin = [], 0
    for a, b in spans:
        kept.append(raw[begin : at[int(a)][0]])
        begin = at[int(b) - 1][1]
    kept.append(raw[begin:])
    pieces = (p.decode("utf-8", "surrogatepass").strip() for p in kept)
    return " ".join(p for p in pieces if p)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without the spans of benchmark words.

    Documents without a hit pass unchanged; a document of which more than ``max_coverage`` of the
    words are hit goes entirely.  ``n_chars`` follows the text where the table has it.
    """
    found = F.col("__found")
    marked = matches(docs, benchmark, window, block_words, cutting=True).where(hit_words(found) <= max_coverage * found.n_words)
    dirty = F.size(found.spans) > 0
    out = marked.withColumn("__text", F.when(dirty, found.getField("rest")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(dirty, F.length("__text").cast(kind)).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.col("__text")).select(*docs.columns)


def digest(items: Iterable[str]) -> str:
    """Plain-Python form of items_sha256."""
    return hashlib.sha256(",".join(sorted(set(items))).encode()).hexdigest()
