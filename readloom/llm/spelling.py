"""Spelling variants: words one edit apart, found by their rarest bigrams, and the frequent form that each goes back to.

All bigrams of the distinct words are ordered by frequency. An edit changes at most two bigrams of a word, so two words one
edit apart agree in one of the three rarest of each, at places at most one apart. Words are joined on such a bigram, its
place and their lengths. The edit also leaves one half of the shorter word as it is (its first or its last letters), so
the halves are part of the key, which keeps the groups of frequent bigrams small. Every pair met is verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import ascii_lower, materialize

#: A word's letters: ASCII and U+00C0 to U+00FF. 26 + 64 of them after lower-casing, so at most 8,100 bigrams.
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
LEAST_LETTERS, LEAST_COUNT = 7, 2
#: A form occurs so many times as often as its variant.
TIMES = 10
#: An edit changes two bigrams, so one of the three rarest is left.
RAREST = 3
#: One in so many runs (by hash) loses a letter.
NOISE = 31


def runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """(docs' columns but the text, run): the maximal runs of letters of whole texts, A-Z lower-cased, of LEAST_LETTERS or more."""
    long = F.filter(F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0)), lambda r: F.length(r) >= LEAST_LETTERS)
    keep = [c for c in docs.columns if c != text]
    return docs.select(*keep, F.explode(long).alias("run")).withColumn("run", ascii_lower(F.col("run")))


def noisy(run: Column, ident: Column) -> Column:
    """``run``, or, for one in NOISE by a hash of the id and it, the run without one letter."""
    h = F.crc32(F.concat(F.coalesce(ident.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    less = F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))
    return F.when(F.pmod(h, F.lit(NOISE)) == 0, less).otherwise(run)


def words(found: DataFrame) -> DataFrame:
    """(word, n) of the words (column ``word``) that are long and frequent enough."""
    d = found.filter(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return d.filter(F.col("n") >= LEAST_COUNT)


def rarest(d: DataFrame) -> DataFrame:
    """(word, n, gram, pos) of the RAREST bigrams of each word; those of equal frequency by their letters, then by place.

    The order is that of the bigrams, not of bigrams at places, so the two words of a pair have it in common even where
    an edit has moved a bigram.
    """
    places = F.sequence(F.lit(1), F.length("word") - 1)
    grams = d.select("word", "n", F.explode(F.transform(places, lambda i: F.struct(i.alias("pos"), F.substr("word", i, F.lit(2)).alias("gram")))).alias("g")).select("word", "n", "g.pos", "g.gram")
    counts = materialize(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("freq")))  # at most 8,100 rows
    first = F.slice(F.array_sort(F.collect_list(F.struct("freq", "gram", "pos"))), 1, RAREST)
    kept = grams.join(F.broadcast(counts), "gram").groupBy("word", "n").agg(first.alias("g"))
    return kept.select("word", "n", F.explode("g").alias("g")).select("word", "n", "g.gram", "g.pos")


def _keys(d: DataFrame, kind: str, length: Column, shift: Column | int, head: Column, tail: Column) -> DataFrame:
    """(key, word, n): a key for each half of the shorter word of a pair, of which the longer has ``length`` letters."""
    key = lambda side, half: F.xxhash64(F.lit(kind), "gram", F.col("pos") + shift, length, F.lit(side), half)
    return d.select("word", "n", F.explode(F.array(key("head", head), key("tail", tail))).alias("key"))


def near_pairs(d: DataFrame) -> DataFrame:
    """(a, na, b, nb) of the words (word, n) that differ by one inserted, deleted or replaced letter; each pair once."""
    r = materialize(rarest(d))
    w, n = F.col("word"), F.length("word")
    first, rest = (lambda k: F.substr(w, F.lit(1), k)), (lambda k: F.substr(w, k + 1))
    half = F.floor(n / 2).cast("int")
    same = _keys(r, "same", n, 0, first(half), rest(half))
    # a letter more: bigrams behind it have moved on by one place
    shorter = _keys(r, "more", n + 1, 0, first(half), rest(half)).unionByName(_keys(r, "more", n + 1, 1, first(half), rest(half)))
    lower = F.floor((n - 1) / 2).cast("int")
    longer = _keys(r, "more", n, 0, first(lower), rest(lower + 1))
    named = lambda x, c: x.select("key", F.col("word").alias(c), F.col("n").alias(f"n{c}"))
    one = F.levenshtein("a", "b", 1) == 1
    alike = named(same, "a").join(named(same, "b"), "key").filter((F.col("a") < F.col("b")) & one)
    unlike = named(shorter, "a").join(named(longer, "b"), "key").filter(one)
    return alike.unionByName(unlike).drop("key").distinct()


def forms(d: DataFrame, pairs: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n): the near word of largest n, if that is TIMES the word's own; ties by letters."""
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("m")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("m")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), F.col("near"))).alias("best"))
    d = d.join(best, "word", "left")
    is_form = -F.col("best.less") >= TIMES * F.col("n")
    return d.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"))


def roots(d: DataFrame) -> DataFrame:
    """``d`` (word, form, ...) with root: where following the forms ends. The steps followed double in each round.

    A form occurs TIMES as often as its word, so no way has more steps than a count has digits.
    """
    up = materialize(d.filter("form is not null").select(F.col("word").alias("w"), F.col("form").alias("r")))
    while True:
        further = up.alias("x").join(up.alias("y"), F.col("x.r") == F.col("y.w"), "left").select("x.w", F.coalesce("y.r", "x.r").alias("r"), F.col("y.r").isNotNull().alias("moved"))
        further = materialize(further)
        up = further.select("w", "r")
        if not further.filter("moved").limit(1).count():
            return d.join(up, F.col("word") == F.col("w"), "left").withColumn("root", F.coalesce("r", "word")).drop("w", "r")


def variants(found: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words in the column ``word`` of ``found``, one row an occurrence.

    Words of fewer than LEAST_LETTERS letters or LEAST_COUNT occurrences take no part; nulls and other columns are left
    out; repeated rows are occurrences. Two near words of equal n: the smaller one in code-point order is the form. Words of any
    length are compared whole. An empty table gives no rows.
    """
    d = materialize(words(found.select("word")))
    return roots(materialize(forms(d, materialize(near_pairs(d))))).select("word", "form", "root", "n", "n_near", "form_n")
