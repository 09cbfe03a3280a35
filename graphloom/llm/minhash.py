"""One-permutation MinHash fingerprints with densification and packed low bits.

Words are what white space separates in the lower-cased text; a shingle is five words
(all of them if there are fewer).  Each shingle is hashed once: the top seven bits name
its bin, the least hash of a bin is kept.  An empty bin borrows from the first
non-empty bin of its own fixed random order of bins (optimal densification with an
affine order modulo a prime, the same for every document).  The low eight bits of each
bin make the fingerprint, 256 hex digits; the likeness of two fingerprints is the share of
equal bins corrected for the 1/256 that agree by chance.

Everything is built from DataFrame functions and stays in the JVM.  Hashes of a text are
handled in its own row, so fingerprinting moves no data.  Looking at the next document
takes one shuffle of texts with their sketches by id, which both of its uses share, and one
of the borrowed beginnings; so every text is sketched once, and its edited text once.  The
order of ids is found on ids alone, range by range.  Rows that are repeated very often are
unfolded in slices.

Defined edge cases: null texts are empty; empty texts have the fingerprint of the empty
sequence and are like each other; rows that repeat both id and text are one document in
the order and repeated in the result; rows that share an id follow by a hash of the text;
null ids come first; the only document is its own next; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.sharding import copies
from graphloom.plans.scratch import Scratch

BINS_LOG2 = 7
BINS = 1 << BINS_LOG2
LOW_BITS = 8
SHINGLE_WORDS = 5
RANGE_ROWS = 100_000
_PRIME = 131  # the least prime over BINS


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _mixed(x: int) -> int:
    """A fixed pseudo-random 64-bit number."""
    x = (x + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return x ^ (x >> 31)


def slopes() -> list[int]:
    return [1 + _mixed(2 * i) % (_PRIME - 1) for i in range(BINS)]


def shifts() -> list[int]:
    return [_mixed(2 * i + 1) % _PRIME for i in range(BINS)]


def shingle_hashes(text: Column) -> Column:
    """64-bit hashes of all shingles of a text, repeats included."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")), " ")

    def shingles(h: Column) -> Column:
        runs = F.transform(
            F.sequence(F.lit(0), F.size(h) - SHINGLE_WORDS),
            lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(SHINGLE_WORDS))),
        )
        return F.when(F.size(h) < SHINGLE_WORDS, F.array(F.xxhash64(h))).otherwise(runs)

    return let(F.transform(words, lambda w: F.xxhash64(w)), shingles)


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BINS_LOG2).cast("int")


def sketch(text: Column) -> Column:
    """Low bytes of the bins, as array<tinyint> of BINS entries."""

    def first_of_bins(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, i - 1))))

    low = lambda h: h.bitwiseAND(F.lit((1 << LOW_BITS) - 1).cast("long"))
    slope, shift = F.array(*map(F.lit, slopes())), F.array(*map(F.lit, shifts()))

    def filled(least: Column) -> Column:
        def borrowed(i: Column) -> Column:
            rank = lambda h: F.pmod(F.get(slope, i) * _bin(h) + F.get(shift, i), F.lit(_PRIME)).cast("long")
            return low(F.array_min(F.transform(least, lambda h: F.shiftleft(rank(h), LOW_BITS).bitwiseOR(low(h)))))

        def by_bin(there: Column) -> Column:
            def one(i: Column) -> Column:
                return let(F.array_position(there, i), lambda p: F.when(p > 0, low(F.get(least, (p - 1).cast("int")))).otherwise(borrowed(i)))

            return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), one)

        return let(F.transform(least, _bin), by_bin)

    # sorting puts the bins in signed order; by_bin restores the plain one
    least = let(F.sort_array(shingle_hashes(text)), first_of_bins)
    return F.transform(let(least, filled), lambda b: (b.bitwiseXOR(F.lit(128).cast("long")) - 128).cast("tinyint"))


def packed(bins: Column) -> Column:
    """A sketch as lower-case hex."""
    return F.lower(F.array_join(F.transform(bins, lambda b: F.substring(F.hex(b.cast("long") + 384), 2, 2)), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets of two sketches, 0 to 1."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda t: t))
    chance = 1.0 / (1 << LOW_BITS)
    return F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1.0 - chance))


def with_fingerprint(docs: DataFrame, column: str = "fingerprint") -> DataFrame:
    """The documents with their packed fingerprint."""
    return docs.withColumn(column, packed(sketch(F.col("text"))))


def _order(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct (kid, h, k) rows -> (kid, h, before_kid, before_h, before_k), cyclic in ascending (kid, h)."""
    ranges = max(1, -(-keys.count() // RANGE_ROWS))
    dealt = scratch.save(keys.select("kid", "h", "k").repartitionByRange(ranges, "kid", "h").withColumn("part", F.spark_partition_id()))
    row = F.struct("kid", "h", "k")
    ends = dealt.groupBy("part").agg(F.max(row).alias("last"))
    every = Window.orderBy("part")  # one row for each range
    edges = ends.select("part", F.coalesce(F.lag("last").over(every), F.last("last").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("edge"))
    inside = Window.partitionBy("part").orderBy("kid", "h")
    out = dealt.withColumn("before", F.lag(row).over(inside)).join(edges, "part").withColumn("before", F.coalesce("before", "edge"))
    return out.select("kid", "h", F.col("before.kid").alias("before_kid"), F.col("before.h").alias("before_h"), F.col("before.k").alias("before_k"))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents and of their edited texts.

    The edited text has its last quarter of code points (rounded down) replaced by the first as many of the
    next document by id.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    body = F.coalesce(F.col("text"), F.lit(""))
    kid = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    keyed = docs.select("doc_id", body.alias("text")).withColumns({"kid": kid, "h": F.xxhash64("text", F.col("doc_id").isNull())})
    keys = scratch.save(keyed.groupBy("kid", "h").agg(F.max(F.floor(F.length("text") / 4).cast("int")).alias("k"), F.count("*").alias("n")))
    before = scratch.save(_order(keys, scratch))
    full = keyed.withColumn("bins", sketch(F.col("text")))
    most = keys.agg(F.max("n")).first()[0] or 0
    if most > 1:
        full = full.dropDuplicates(["kid", "h"])
    lent = full.join(before, ["kid", "h"]).select(
        F.col("before_kid").alias("kid"),
        F.col("before_h").alias("h"),
        F.col("doc_id").alias("next_doc_id"),  # with it both uses of the texts read the same columns, so they share an exchange
        F.expr("substring(text, 1, before_k)").alias("lent"),
        F.col("bins").alias("next_bins"),
    )
    size = F.length("text")
    out = full.join(lent, ["kid", "h"]).select(
        "*", F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 4) as int))"), "lent").alias("edited")
    )
    out = out.withColumn("edited_bins", sketch(F.col("edited")))
    if most > 1:
        out = out.join(keys.where("n > 1").select("kid", "h", "n"), ["kid", "h"], "left").withColumns({"n": F.coalesce("n", F.lit(1).cast("long")), "shard": F.col("kid"), "part": F.col("h")})
        out = copies(out, most)
    return out.select(
        "doc_id",
        size.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        packed(F.col("bins")).alias("fingerprint"),
        packed(F.col("edited_bins")).alias("edited_fingerprint"),
        likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"),
        likeness(F.col("bins"), F.col("next_bins")).alias("near_next"),
        "next_doc_id",
    )
