"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.plans.store import scratch_dir
from readloom.plans.store import stored as materialize

__all__ = ["materialize", "scratch_dir"]

#: A word: a run of characters other than space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Rows of a few numbers that a broadcast may hold.
BROADCAST_ROWS = 50_000
BLANKS = " \t\n\x0b\x0c\r"


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null and blank texts."""
    body = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(body) > 0, F.size(F.split(body, GAP))).otherwise(0).cast("long")


def words_of(text: Column) -> Column:
    """The words of a text, in order; empty for null and blank texts."""
    body = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(body) > 0, F.split(body, GAP)).otherwise(F.array().cast("array<string>"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lookup(big: DataFrame, small: DataFrame, key: str, how: str = "left", rows: int | None = None, salts: int = 64) -> DataFrame:
    """Join ``small`` (one row a key) to ``big`` on a nullable ``key``.

    ``small`` is counted (or has ``rows`` rows, if the caller knows): up to BROADCAST_ROWS it is broadcast; beyond,
    both sides are dealt by (key, salt) so that a hot key is spread over ``salts`` tasks.
    """
    right = small.withColumnRenamed(key, "__key")
    if (small.count() if rows is None else rows) <= BROADCAST_ROWS:
        return big.join(F.broadcast(right), F.col(key).eqNullSafe(F.col("__key")), how).drop("__key")
    right = right.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = big.withColumn("__t", (F.rand(7) * salts).cast("int"))
    on = F.col(key).eqNullSafe(F.col("__key")) & (F.col("__t") == F.col("__s"))
    return left.join(right, on, how).drop("__key", "__s", "__t")


#: Rows of one key that a task may get before the key is split, and the most keys that are split.
HOT_ROWS, HOT_KEYS = 4096, 10_000


def hot_keys(counts: DataFrame, key: str, n: str = "n", total: int | None = None) -> DataFrame:
    """(__h, __parts) of the keys with so many rows that they are split; ``counts`` has one row a key.

    A key is hot from HOT_ROWS rows on, and from total / HOT_KEYS: there are at most HOT_KEYS, so the result may be
    broadcast.
    """
    total = (counts.agg(F.sum(n)).first()[0] or 0) if total is None else total
    unit = max(HOT_ROWS, -(-total // HOT_KEYS))
    hot = counts.filter((F.col(n) > unit) & F.col(key).isNotNull())
    return hot.groupBy(F.xxhash64(key).alias("__h")).agg(F.ceil(F.sum(n) / unit).cast("int").alias("__parts"))


def salted_join(big: DataFrame, small: DataFrame, key: str, hot: DataFrame, by: Column, how: str = "inner") -> DataFrame:
    """Join ``small`` to ``big`` on ``key``; rows of hot keys are dealt over several tasks by the hash of ``by``."""
    h, parts = F.xxhash64(key), F.coalesce("__parts", F.lit(1))
    left = big.withColumn("__h", h).join(F.broadcast(hot), "__h", "left").withColumn("__s", F.pmod(F.xxhash64(by), parts).cast("int")).drop("__h", "__parts")
    right = small.withColumn("__h", h).join(F.broadcast(hot), "__h", "left").withColumn("__s", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__h", "__parts")
    return left.join(right, [key, "__s"], how).drop("__s")


#: Bits of a bitmap for each key, and log2 of its bits at most (16 MB); a fuller one holds more keys than it was given.
KEY_BITS, MAX_LOG_BITS = 16, 27
#: log2 of the bits in a row of a bitmap, 512 words of 64.
ROW_LOG_BITS = 15


def bitmap(keys: DataFrame) -> tuple[DataFrame, int]:
    """(__row, __words) and the number of bits: a bit for each 64-bit ``x`` of ``keys``, at most 16 MB, in rows of 4 kB."""
    bits = 1 << min(MAX_LOG_BITS, max(ROW_LOG_BITS, (KEY_BITS * keys.count()).bit_length()))
    words = keys.select(F.shiftright(F.pmod("x", F.lit(bits)), 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(x, {bits}) & 63 as int))").alias("set"))
    words = words.unionByName(keys.sparkSession.range(bits >> 6).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("set")))
    words = words.groupBy("word").agg(F.bit_or("set").alias("set"))
    rows = words.groupBy(F.shiftright("word", ROW_LOG_BITS - 6).alias("__row")).agg(F.array_sort(F.collect_list(F.struct("word", "set"))).alias("w"))
    return rows.select("__row", F.col("w.set").alias("__words")), bits


def flagged(d: DataFrame, x: Column, keys: DataFrame, name: str) -> DataFrame:
    """``d`` with ``name``: whether the 64-bit ``x`` has its bit in the bitmap of ``keys``: always true for a key, rarely for others."""
    rows, bits = bitmap(keys)
    d = d.withColumn("__at", F.pmod(x, F.lit(bits)))
    d = d.join(F.broadcast(rows), F.shiftright("__at", ROW_LOG_BITS) == F.col("__row"), "left")  # at most 4096 rows of 4 kB
    word = F.get("__words", F.shiftright("__at", 6).bitwiseAND((1 << ROW_LOG_BITS - 6) - 1).cast("int"))
    return d.withColumn(name, F.getbit(word, F.col("__at").bitwiseAND(63).cast("int")) == 1).drop("__at", "__row", "__words")
