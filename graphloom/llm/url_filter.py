"""URL allow and block rules behind a blocked Bloom filter.

A rule is a host and a path.  It fits a url if its host is the url's host or a parent
domain of it and the url's path starts with the rule's; the longest fitting rule
decides.  The canonical form of a rule is host + path.  A url can only fit canonical
strings made of one of its parent domains and a beginning of its path whose length is
that of some rule's path, so these few strings are its probes.

The listed canonical strings are held in a blocked Bloom filter: a string sets K_BITS bits
within one 64-bit block.  Probes that miss are dropped in place; possible hits go to an
exact hash join with the rules, which removes false positives.  Urls are judged once
each, whatever the number of pages that share one; pages without a host pass by the join.

The filter's blocks are gathered on the driver only up to MAX_BLOCKS (about as many rules);
a longer list is probed through a join with the table of blocks.

Defined edge cases: null urls and urls without ``://`` have an empty host and path and fit
no rule; a url that no rule fits is allowed; rules without host or path are ignored;
repeated rules count once, of contradicting ones block wins; repeated pages are repeated;
columns other than page_id and url are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.scratch import Scratch

K_BITS = 6
RULES_PER_BLOCK = 4
MAX_BLOCKS = 1 << 12
OTHERWISE = "allow"

#: The production rules (fixed values): verdict, host, path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(rule, path_length, verdict) of listed rules."""
    listed = spark.createDataFrame(list(rules), "verdict string, host string, path string")
    return (
        listed.where("host <> '' and path like '/%'")
        .select(F.concat("host", "path").alias("rule"), F.length("path").alias("path_length"), "verdict")
        .groupBy("rule", "path_length")
        .agg(F.max("verdict").alias("verdict"))
    )


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_parts(pages: DataFrame) -> DataFrame:
    """Pages with host and path of their url."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return (
        pages.withColumn("__rest", F.coalesce(rest, F.lit("")))
        .withColumn("host", lower_ascii(F.regexp_extract("__rest", r"^[^/?#]*", 0)))
        .withColumn("path", F.regexp_extract("__rest", r"^[^/?#]*([^?#]*)", 1))
        .drop("__rest")
    )


def probes(host: Column, path: Column, path_lengths: Sequence[int]) -> Column:
    """Canonical strings that a url of this host and path could be listed under."""
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.filter(F.array(*(F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in path_lengths)), lambda p: p.isNotNull())
    return F.flatten(F.transform(parents, lambda h: F.transform(starts, lambda p: F.concat(h, p))))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _mask(key: Column) -> Column:
    """K_BITS bits of a 64-bit block."""
    h = F.xxhash64(key, F.lit(1))
    mask = F.lit(0).cast("long")
    for i in range(K_BITS):
        bit = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return mask


def possible(keys: DataFrame, rules: DataFrame, blocks: int) -> DataFrame:
    """The (…, key) rows whose key the filter may hold."""
    table = rules.groupBy(_block(F.col("rule"), blocks).alias("block")).agg(F.bit_or(_mask(F.col("rule"))).alias("bits"))
    if blocks > MAX_BLOCKS:
        found = keys.withColumn("block", _block(F.col("key"), blocks)).join(table, "block")
        return found.where(F.col("bits").bitwiseAND(_mask(F.col("key"))) == _mask(F.col("key"))).drop("block", "bits")
    words = [0] * blocks
    for r in table.collect():
        words[r["block"]] = r["bits"]
    bits = F.get(F.array(*(F.lit(w).cast("long") for w in words)), _block(F.col("key"), blocks))
    return keys.where(bits.bitwiseAND(_mask(F.col("key"))) == _mask(F.col("key")))


def judge(pages: DataFrame, rules: DataFrame | None = None, otherwise: str = OTHERWISE) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    rules = rule_table(pages.sparkSession) if rules is None else rules
    lengths = sorted(r[0] for r in rules.select("path_length").distinct().collect())
    blocks = max(1, -(-rules.count() // RULES_PER_BLOCK))
    parts = with_parts(pages.select("page_id", "url"))
    named = F.col("host") != ""
    keys = parts.select("host", "path").where(named).distinct().select("host", "path", F.explode(probes(F.col("host"), F.col("path"), lengths)).alias("key"))
    hits = possible(keys, rules, blocks).join(rules.withColumnRenamed("rule", "key"), "key")
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("key", "verdict"), F.struct(F.length("key"), "key")).alias("best"))
    # Written, so that the join below reads two plain exchanges, of which adaptive execution can split a frequent url.
    best = Scratch(pages.sparkSession, "urls").save(best)
    judged = parts.where(named).join(best, ["host", "path"], "left").unionByName(parts.where(~named), allowMissingColumns=True)
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("best.key").alias("rule"),
        F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"),
    )
