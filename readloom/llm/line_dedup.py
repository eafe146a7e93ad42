"""Removal of boilerplate lines that spread over many sites.

A line that occurs fewer than ``min_sites`` times cannot be on as many sites. Lines that occur as often leave a bit in a
broadcast bitmap, and only occurrences with such a bit are kept and shuffled; the few rare lines among them fail the
count of sites. A HyperLogLog sketch of sites is merged per line hash. Lines whose estimate is near the threshold get an
exact distinct count. The first occurrence (smallest id) of a boilerplate line stays, so text that only exists in copies
is not lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import hot_keys, materialize, salted_join

MIN_SITES = 3
MIN_CHARS = 4
LG_K = 11
#: Estimates within this share of the threshold are counted exactly: ten standard errors of the sketch and more.
BAND = 0.3
#: Bits of the bitmap for each frequent line, and log2 of its bits at most (16 MB); a fuller one keeps more occurrences.
LINE_BITS, MAX_LOG_BITS = 16, 27
#: log2 of the bits in a row of the bitmap, 512 words of 64.
ROW_LOG_BITS = 15


def _key(*columns: Column) -> Column:
    """128 bits that stand for the values: two hashes of unrelated seeds."""
    return F.struct(F.xxhash64(*columns).alias("x"), F.xxhash64(F.lit("line"), *columns).alias("y"))


def _occurrences(docs: DataFrame, text: str, site: str, ident: str, min_chars: int) -> DataFrame:
    """(row, ident, pos, line, site) of every line of at least ``min_chars`` characters, blanks around it aside."""
    d = docs.select(_key(F.col(ident), F.col(text)).alias("row"), F.col(ident).alias("ident"), F.xxhash64(F.col(site)).alias("site"), F.posexplode(F.split(F.col(text), "\n")).alias("pos", "raw"))
    d = d.withColumn("raw", F.btrim("raw", F.lit(" \t\x0b\x0c\r"))).filter(F.length("raw") >= min_chars)
    return d.select("row", "ident", "pos", _key(F.col("raw")).alias("line"), "site")


def _marked(occurrences: DataFrame, lines: DataFrame) -> DataFrame:
    """Occurrences of all ``lines`` (x: the first half of a line's key), and of others that share a bit with one."""
    bits = 1 << min(MAX_LOG_BITS, max(ROW_LOG_BITS, (LINE_BITS * lines.count()).bit_length()))
    at = lambda x: F.pmod(x, F.lit(bits))
    words = lines.select(F.shiftright(at(F.col("x")), 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(x, {bits}) & 63 as int))").alias("set"))
    words = words.unionByName(lines.sparkSession.range(bits >> 6).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("set")))
    words = words.groupBy("word").agg(F.bit_or("set").alias("set"))
    rows = words.groupBy(F.shiftright("word", ROW_LOG_BITS - 6).alias("__row")).agg(F.array_sort(F.collect_list(F.struct("word", "set"))).alias("w"))
    rows = rows.select("__row", F.col("w.set").alias("__words"))
    x = at(F.col("line.x"))
    word = F.get("__words", F.shiftright(x, 6).bitwiseAND((1 << ROW_LOG_BITS - 6) - 1).cast("int"))
    return occurrences.join(F.broadcast(rows), (F.shiftright(x, ROW_LOG_BITS) == F.col("__row")) & (F.getbit(word, x.bitwiseAND(63).cast("int")) == 1), "left_semi")


def boilerplate(occurrences: DataFrame, min_sites: int = MIN_SITES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(line, first) of the lines on at least ``min_sites`` sites, the hot lines, and occurrences with all of those lines.

    first: (ident, row, pos) of the occurrence that stays. ``occurrences`` is gone through twice and not stored.
    """
    # half of the key is enough here: what shares it is counted together, so no line is missed
    frequent = occurrences.groupBy(F.col("line.x").alias("x")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_sites)
    held = materialize(_marked(occurrences, materialize(frequent.select("x"))))
    place = F.struct("ident", "row", "pos")
    sites = F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K)))
    sketched = materialize(held.groupBy("line").agg(sites.alias("sites"), F.min(place).alias("first"), F.count(F.lit(1)).alias("n")))
    hot = hot_keys(sketched, "line")
    sure = sketched.filter(F.col("sites") > min_sites * (1 + BAND))
    near = sketched.filter(F.col("sites").between(min_sites * (1 - BAND), min_sites * (1 + BAND)))
    exact = salted_join(held, near.select("line"), "line", hot, F.struct("row", "pos"), "left_semi").select("line", "site").distinct().groupBy("line").agg(F.count(F.lit(1)).alias("exact")).filter(F.col("exact") >= min_sites)
    return materialize(sure.select("line", "first").unionByName(near.join(exact, "line").select("line", "first"))), hot, held


def dedup_lines(docs: DataFrame, text: str = "text", site: str = "source", ident: str = "doc_id", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text``, and n_lines and n_removed (long).

    Lines are parts between line feeds; those with fewer than ``min_chars`` characters (blanks around them aside) never
    go. Null texts stay null with no lines; null sites are one site. Repeated rows (same id and text) count as often
    as they occur, and the row that keeps a line keeps it in each repetition. Columns n_lines and n_removed are replaced;
    other columns stay. An empty table gives no rows. Texts of any length are read whole. 128-bit hashes stand for lines.
    """
    docs = docs.drop("n_lines", "n_removed")
    bad, hot, held = boilerplate(_occurrences(docs, text, site, ident, min_chars), min_sites)
    gone = salted_join(held, bad, "line", hot, F.struct("row", "pos")).filter(~((F.col("row") == F.col("first.row")) & (F.col("pos") == F.col("first.pos"))))
    drops = gone.select("row", "pos").distinct().groupBy("row").agg(F.collect_list("pos").alias("__drop")).withColumnRenamed("row", "__r")
    d = docs.withColumn("__row", _key(F.col(ident), F.col(text))).join(drops, F.col("__row") == F.col("__r"), "left")
    lines = F.split(F.col(text), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__drop"))
    d = d.withColumn("n_lines", F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long"))
    d = d.withColumn("n_removed", F.coalesce(F.size("__drop"), F.lit(0)).cast("long"))
    d = d.withColumn("__lines", F.when(F.col("__drop").isNotNull(), lines))
    rest = F.array_join(F.transform(left, lambda i: F.get(F.col("__lines"), i)), "\n")
    return d.withColumn(text, F.when(F.col("__drop").isNull(), F.col(text)).otherwise(rest)).drop("__row", "__r", "__drop", "__lines")
