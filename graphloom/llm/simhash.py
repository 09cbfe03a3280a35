"""SimHash fingerprints and near-duplicate groups through a positional byte index.

Two 64-bit fingerprints that differ in at most two bits share at least six of their
eight positional bytes.  The index lists fingerprints under BLOCKS, the 14 sets of four
byte positions of which any three positions lie in exactly one (positions whose numbers
xor to zero).  Two fingerprints that share 4 bytes or fewer meet in at most one block,
with 5 in exactly one, with 6 in three, with 7 in seven: so the number of blocks in which
a pair meets tallies its shared bytes, and MIN_BLOCKS = 3 is the guaranteed minimum.
Pairs that reach it are verified bit by bit, the others go.

Posting lists over HOT_LIST distinct fingerprints emit no pairs.  They are linked
through single-bit neighbours of their remaining 32 bits: fingerprints under one key and
one neighbour differ in at most two bits, and any two that differ in at most two bits
share a neighbour.  Such a list costs 33 rows a member and its groups have at most 33
members.  A pair within two bits either meets in three short lists, and is tallied, or in a
long one, and is linked there: the result is exact whatever HOT_LIST is.

Everything after the fingerprints works on distinct fingerprints (copies are folded
before any shuffle of postings).  Defined edge cases: null or empty texts, and texts of
white space, have fingerprint zero and are linked like any other; repeated rows are
repeated in the result; null ids get their group's id, null if it has no other;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from graphloom.llm.common import LOWER, small_batches, utf8
from graphloom.operators.stars import star_components
from graphloom.plans.scratch import Scratch

SHINGLE_WORDS = 3
HASH_SEED = 42
MAX_BITS = 2
HOT_LIST = 64
#: Sets of four byte positions, any three positions in exactly one of them.
BLOCKS = [c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]
#: Blocks within the bytes that two fingerprints of at most MAX_BITS differing bits share.
MIN_BLOCKS = sum(not {0, 1} & set(b) for b in BLOCKS)
_CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of a whole text."""
    words = utf8(text).translate(LOWER).split()
    if not words:
        return 0
    k = min(SHINGLE_WORDS, len(words))
    n = len(words) - k + 1
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _CHUNK):
        part = words[at : at + _CHUNK + k - 1]
        runs = zip(*(part[i:] for i in range(k)), strict=False)
        h = np.fromiter((digest(b" ".join(r), HASH_SEED) for r in runs), dtype=np.uint64)
        ones += _ones(h)
    return _majority(ones, n)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _majority(ones: np.ndarray, n: int) -> int:
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def of_hashes(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash of shingles that are hashed already."""
    return _majority(sum((_ones(hashes[at : at + _CHUNK]) for at in range(0, len(hashes), _CHUNK)), np.zeros(64, dtype=np.int64)), len(hashes))


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", _fingerprints(F.col("text")).alias("fp"))


def _bytes_at(fp: Column, positions: Iterable[int]) -> Column:
    """The bytes at these positions, one after another."""
    parts = [F.shiftleft(F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(0xFF)), 8 * n) for n, p in enumerate(positions)]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def postings(fps: DataFrame) -> DataFrame:
    """(key, fp) of every block: the key is the block's number and the bytes at its positions."""
    keys = [F.lit(n << 32).bitwiseOR(_bytes_at(F.col("fp"), b)) for n, b in enumerate(BLOCKS)]
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _rest(key: Column, fp: Column) -> Column:
    """The four bytes of a fingerprint that are not in its key."""
    return F.get(F.array(*(_bytes_at(fp, [p for p in range(8) if p not in b]) for b in BLOCKS)), F.shiftrightunsigned(key, 32).cast("int"))


def tally(listed: DataFrame) -> DataFrame:
    """(u, v, blocks) of every pair that meets in a posting list."""
    u, v = listed.select("key", F.col("fp").alias("u")), listed.select("key", F.col("fp").alias("v"))
    return u.join(v, "key").where("u < v").groupBy("u", "v").agg(F.count("*").alias("blocks"))


def links(fps: DataFrame, scratch: Scratch, hot_list: int = HOT_LIST) -> DataFrame:
    """(u, v) links among distinct fingerprints whose components are those of all links of at most two bits."""
    post = scratch.save(postings(fps))
    sizes = scratch.save(post.groupBy("key").count().where("count > 1"))
    listed = post.join(sizes, "key")
    few = scratch.save(listed.where(F.col("count") <= hot_list).select("key", "fp"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS
    pairs = tally(few).where(F.col("blocks") >= MIN_BLOCKS).where(near).select("u", "v")
    # The neighbours come from a small table of bits: 33 copies of this expression would fill the driver's memory with plans.
    bits = F.explode(F.array(*(F.lit(b).cast("long") for b in (0, *(1 << i for i in range(32))))))
    stars = (
        listed.where(F.col("count") > hot_list)
        .select("key", "fp", _rest(F.col("key"), F.col("fp")).alias("rest"))
        .select("key", "fp", "rest", bits.alias("bit"))
        .select("key", "fp", F.col("rest").bitwiseXOR(F.col("bit")).alias("near"))
        .select("fp", F.min("fp").over(Window.partitionBy("key", "near")).alias("least"))
        .where("fp <> least")
        .select(F.col("least").alias("u"), F.col("fp").alias("v"))
    )
    out = scratch.save(pairs.unionByName(stars).distinct())
    scratch.drop(post, sizes, few)
    return out


def components(marked: DataFrame, scratch: Scratch, linked: Callable[[DataFrame, Scratch], DataFrame] = links) -> DataFrame:
    """(doc_id, fp) rows -> (fp, root, component_id) for each distinct fingerprint; root: the least of its group."""
    fps = scratch.save(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    groups = scratch.save(star_components(linked(fps, scratch), scratch).withColumnsRenamed({"id": "fp", "component": "root"}))
    least = scratch.save(fps.join(groups, "fp").groupBy("root").agg(F.min("first_id").alias("component_id")))
    grouped = groups.join(least, "root").select("fp", "root", "component_id")
    alone = fps.join(groups, "fp", "left_anti").select("fp", F.col("fp").alias("root"), F.col("first_id").alias("component_id"))
    return scratch.save(grouped.unionByName(alone))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.save(with_fingerprint(docs))
    named = components(marked, scratch)
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(
    docs: DataFrame,
    marked: DataFrame | None = None,
    fingerprints: Callable[[Column], Column] = _fingerprints,
    linked: Callable[[DataFrame, Scratch], DataFrame] = links,
) -> DataFrame:
    """The documents, with all their columns, of which each group keeps one of least id.

    Of a group's rows that share its least id, any one stays, and a group of rows without ids keeps any one of
    them; rows of one id in different groups are different documents.  Other fingerprints come with their own
    (doc_id, fp) rows and links.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    if marked is None:
        marked = scratch.save(with_fingerprint(docs))
    named = components(marked, scratch, linked)
    # Ids that some group keeps, and how many rows bear them: a single row's id says that it stays.
    roots = named.groupBy(F.col("component_id").alias("kept")).agg(F.count("*").alias("groups"))
    bearers = marked.groupBy("doc_id").agg(F.count("*").alias("n"))
    ids = scratch.save(bearers.join(roots, F.col("doc_id").eqNullSafe(F.col("kept"))).select("doc_id", "n"))
    # The ids to keep grow with the corpus: a shuffled join at every size, never a broadcast.
    stay = docs.join(ids.where("n = 1 and doc_id is not null").select("doc_id").hint("merge"), "doc_id", "left_semi").select(*docs.columns)
    several = scratch.save(ids.where("n > 1 or doc_id is null").select(F.col("doc_id").alias("__id")))
    if several.isEmpty():
        return stay
    rows = docs.join(several.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").withColumn("__fp", fingerprints(F.col("text")))
    kept = named.select(F.col("fp").alias("__fp"), F.col("root").alias("__root"), F.col("component_id").alias("__id"))
    firsts = rows.join(kept.hint("merge"), "__fp").where(F.col("doc_id").eqNullSafe(F.col("__id")))
    return stay.unionByName(firsts.dropDuplicates(["__root"]).select(*docs.columns))
