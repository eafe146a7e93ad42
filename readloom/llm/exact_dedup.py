"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Texts count as equal when they are after each run of blanks became one space. A first scan takes the length and a hash of
the first characters of every text. Rows are grouped by length; those that share it, by length and prefix. Keys with several
rows leave a bit in a broadcast bitmap (at most 16 MB, which misses none), and only texts with such a bit are hashed as a
whole, with 256 bits, and grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import GAP, flagged, hot_keys, materialize, salted_join

#: Characters of the normalised text that the prefix hash covers.
PREFIX = 64


def normalised(text: Column) -> Column:
    """The text with each run of space and \\x09-\\x0D as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), GAP, " ")


def _sized(text: Column) -> Column:
    """(len, head): characters of the normalised text, and the hash of its length and first characters."""
    n = F.length(text)
    return F.struct(n.alias("len"), F.xxhash64(n, F.substring(text, 1, PREFIX)).alias("head"))


def shared_heads(docs: DataFrame, text: str) -> DataFrame:
    """(x): the hashes of length and prefix that several rows have."""
    slim = materialize(docs.select(_sized(normalised(F.col(text))).alias("s")).select("s.len", "s.head"))
    lengths = slim.groupBy("len").agg(F.count(F.lit(1)).alias("n"))
    several = salted_join(slim, lengths.filter("n > 1").select("len"), "len", hot_keys(lengths, "len"), F.col("head"), "left_semi")
    return materialize(several.groupBy(F.col("head").alias("x")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("x"))


def mark(docs: DataFrame, text: str = "text", ident: str = "doc_id", with_text: bool = True, digests: bool = False) -> DataFrame:
    """``docs`` with keep_id, group_size (long), kept and text_sha256: which row of equal texts stays.

    The row with the smallest id stays, null ids last; of rows alike in id and text one stays, whichever is met first. keep_id
    is its id, group_size the number of rows with the text. Null and empty texts are equal. text_sha256 (lower-case hex) is
    null for texts that were told apart by length or prefix, unless ``digests``. Without ``with_text`` the text column is left
    out, and is never shuffled or stored. Columns of the names added are replaced, others stay. Texts of any length are read
    whole. An empty table gives no rows.
    """
    docs = docs.drop("keep_id", "group_size", "kept", "text_sha256")
    heads = shared_heads(docs, text)
    d = docs.withColumn("__norm", normalised(F.col(text)))
    d = flagged(d, _sized(F.col("__norm"))["head"], heads, "__several")
    sha = F.sha2(F.col("__norm").cast("binary"), 256)
    d = d.withColumn("text_sha256", sha if digests else F.when(F.col("__several"), sha)).drop("__norm")
    columns = [c for c in docs.columns if with_text or c != text]
    d = d.select(*columns, "text_sha256", "__several")
    if not with_text:
        d = materialize(d)
    held = d.filter("__several").drop("__several").withColumn("__uid", F.monotonically_increasing_id())
    held = materialize(held)
    groups = held.groupBy("text_sha256").agg(F.min(F.struct(F.col(ident).isNull().alias("none"), F.col(ident).alias("id"), "__uid")).alias("__first"), F.count(F.lit(1)).alias("group_size"))
    groups = materialize(groups)
    single = held.select(*columns, "text_sha256", "__uid")
    # most groups hold one text; a hot one is dealt over several tasks
    held = salted_join(single, groups, "text_sha256", hot_keys(groups, "text_sha256", "group_size"), F.col("__uid"))
    held = held.select(*columns, F.col("__first.id").alias("keep_id"), "group_size", (F.col("__first.__uid") == F.col("__uid")).alias("kept"), "text_sha256")
    alone = d.filter(~F.col("__several")).select(*columns, F.col(ident).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return alone.unionByName(held)


def deduplicate(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, see :func:`mark`, with their own columns."""
    own = {c: f"__own_{c}" for c in docs.columns if c.lower() in ("keep_id", "group_size", "kept", "text_sha256")}
    out = mark(docs.withColumnsRenamed(own), own.get(text, text), own.get(ident, ident)).filter("kept")
    return out.drop("keep_id", "group_size", "kept", "text_sha256").withColumnsRenamed({v: k for k, v in own.items()})
