"""Search with errors: variants are built as rows and met by equality joins, or grow as ranges of the index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.dna import common_prefix
from readloom.operators import bins as search_bins
from readloom.operators.index import build, prepare_reads
from readloom.operators.matching import ranges_of
from readloom.operators.packed import Sorted
from readloom.operators.search import counts_of
from readloom.plans.store import stored

_LETTERS = "ACGNT"


def _alts(own: Column) -> Column:
    return F.filter(F.array(*[F.lit(x) for x in _LETTERS]), lambda x: x != own)


def kmer_variants(kmers: DataFrame) -> DataFrame:
    """(kmer, kind, variant): the k-mer, its substitutions, insertions after a position (of another letter than the one
    there) and deletions; a homopolymer's deletions repeat."""
    k, n = F.col("kmer"), F.length("kmer")
    at = lambda i: F.substr(k, i, F.lit(1))
    left, right = (lambda i: F.substr(k, F.lit(1), i)), (lambda i: F.substr(k, i))
    places = F.sequence(F.lit(1), n)
    make = lambda kind, f: F.transform(f, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("variant")))
    snp = F.flatten(F.transform(places, lambda i: F.transform(_alts(at(i)), lambda a: F.concat(left(i - 1), a, right(i + 1)))))
    ins = F.flatten(F.transform(places, lambda i: F.transform(_alts(at(i)), lambda a: F.concat(left(i), a, right(i + 1)))))
    dele = F.transform(places, lambda i: F.concat(left(i - 1), right(i + 1)))
    every = F.concat(make("exact", F.array(k)), make("snp", snp), make("ins", ins), make("del", dele))
    return kmers.filter(n > 0).select("kmer", F.explode(every).alias("v")).select("kmer", "v.kind", "v.variant")


def kmers_within_one(kmers: DataFrame, reads: DataFrame, least: int = 1, ks: list[int] | None = None) -> DataFrame:
    """(kmer, kind, variant, cnt): variants that occur at least ``least`` times (the exact one: at all).

    Where the exact k-mer occurs, insertion variants that only add a letter at its end are left out.
    """
    v = kmer_variants(kmers)
    got = counts_of(v.select(F.col("variant").alias("kmer")), reads, ks).withColumnRenamed("kmer", "variant")
    d = v.join(got, "variant").filter((F.col("cnt") >= least) | (F.col("kind") == "exact"))
    exact = d.filter("kind = 'exact'").select(F.col("kmer").alias("e"))
    d = d.join(exact, F.col("kmer") == F.col("e"), "left")
    tail = (F.col("kind") == "ins") & F.col("e").isNotNull() & F.startswith("variant", F.col("kmer"))
    return d.filter(~tail).select("kmer", "kind", "variant", "cnt")


def whole_read_variants(queries: DataFrame) -> DataFrame:
    """(query, variant) of (query, bonus): equal-length variants: substitutions, insertions that drop the first symbol,
    deletions that put the bonus symbol in front."""
    q, n = F.col("query"), F.length("query")
    at = lambda i: F.substr(q, i, F.lit(1))
    left, right = (lambda i: F.substr(q, F.lit(1), i)), (lambda i: F.substr(q, i))
    places = F.sequence(F.lit(1), n)
    snp = F.flatten(F.transform(places, lambda i: F.transform(_alts(at(i)), lambda a: F.concat(left(i - 1), a, right(i + 1)))))
    ins = F.flatten(F.transform(places, lambda i: F.transform(_alts(F.lit("")), lambda a: F.substr(F.concat(left(i), a, right(i + 1)), F.lit(2)))))
    dele = F.transform(places, lambda i: F.concat(F.col("bonus"), left(i - 1), right(i + 1)))
    return queries.filter(n > 0).select("query", F.explode(F.array_distinct(F.concat(F.array(q), snp, ins, dele))).alias("variant"))


#: Shorter queries, and those with a half that more distinct reads hold, meet reads by all their variants.
SHORT, HOT = 16, 256


def reads_with_error(queries: DataFrame, reads: DataFrame) -> DataFrame:
    """(query, read_rank): whole reads that equal the query or a variant of it.

    One change leaves one half of a query as it is, or moved by one symbol, so four halves of a query meet two of each distinct
    read, and what meets is compared. A query whose variants are fewer than such reads meets them by its variants.
    Sides are joined by sorting: a table of variants is far larger than Spark takes it for.
    """
    q = stored(queries.filter(F.length("query") > 0).select("query", "bonus").distinct())
    r = stored(reads.select("seq").distinct())
    n, query = F.length("query"), F.col("query")
    low = F.floor(n / 2).cast("int")
    rest = F.substr(query, low + 1)
    # changed behind the half: in place, by an insertion that drops the first symbol, by a deletion that puts the bonus in front
    heads = [F.substr(query, F.lit(1), low), F.substr(query, F.lit(2), low), F.concat("bonus", F.substr(query, F.lit(1), low - 1))]
    halved = (n >= SHORT) & (F.length("bonus") == 1)
    key = lambda of, side, half: F.concat_ws(side, F.length(of).cast("string"), half)
    own = F.array_distinct(F.array(key("query", ">", rest), *[key("query", "<", h) for h in heads]))
    asked = q.filter(halved).select("query", "bonus", F.explode(own).alias("half"))
    at = F.floor(F.length("seq") / 2).cast("int")
    held = F.array(key("seq", ">", F.substr("seq", at + 1)), key("seq", "<", F.substr("seq", F.lit(1), at)))
    held = r.filter(F.length("seq") >= SHORT).select("seq", F.explode(held).alias("half"))
    hot = held.groupBy("half").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).select("half")
    many = stored(asked.join(hot.hint("merge"), "half", "left_semi").select("query", "bonus").distinct())
    asked = asked.join(many.hint("merge"), ["query", "bonus"], "left_anti")
    met = asked.hint("merge").join(held, "half").filter(_one_change(query, F.col("bonus"), F.col("seq"))).select("query", "seq")
    rest = q.filter(~F.coalesce(halved, F.lit(False))).unionByName(many)
    met = met.unionByName(whole_read_variants(rest).withColumnRenamed("variant", "seq").hint("merge").join(r, "seq").select("query", "seq"))
    return stored(met.distinct()).join(reads.select("read_rank", "seq"), "seq").select("query", "read_rank")


def _one_change(query: Column, bonus: Column, seq: Column) -> Column:
    """Whether ``seq``, as long as ``query``, is one of its :func:`whole_read_variants`: what is common in front and behind leaves one symbol."""
    n, cap = F.length(query), 1 << 30
    behind = common_prefix(F.reverse(seq), F.reverse(query), cap)
    tail, inner = F.substr(query, F.lit(2)), F.substr(query, F.lit(1), n - 1)
    moved = F.substr(seq, F.lit(2))
    put = (F.substr(seq, F.lit(1), F.lit(1)) == bonus) & (common_prefix(moved, inner, cap) + F.least(behind, n - 1) >= n - 1)
    return (F.length(seq) == n) & ((common_prefix(seq, query, cap) + behind >= n - 1) | (common_prefix(seq, tail, cap) + behind >= n - 1) | put)


def ranges_with_error(queries: DataFrame, index: DataFrame | Sorted, reads: DataFrame, longest: int) -> DataFrame:
    """(query, variant, l, h): the rows whose rotation starts with the query or a variant of it, wherever in a read that is.

    ``longest`` is the length of the longest query.
    """
    v = stored(whole_read_variants(queries).distinct())
    found = ranges_of(index, v.select(F.col("variant").alias("pattern"))).filter("h > l")
    return v.join(found.withColumnRenamed("pattern", "variant"), "variant").select("query", "variant", "l", "h")


def kmers_within(kmers: DataFrame, reads: DataFrame, edits: int, least: int = 1, bins: DataFrame | None = None) -> DataFrame:
    """(kmer, variant, ops, l, h): the rows of variants with up to ``edits`` edits that occur at least ``least`` times.

    ops has 0 for a match or substitution, 1 insertion, 2 deletion. No insertion or deletion at either end, no insertion
    beside a deletion, and an inserted letter differs from the one it follows. Where the k-mer itself occurs, ranges within
    its range are cut off at it, and variants that contain it or lie in it are left out. ``bins`` is the index of ``reads``,
    which is built if it is missing.

    A frontier of ranges goes on by one symbol a round, from the k-mers' ends: each range gets its five extensions from the
    bins of its two ends, and those of fewer than ``least`` rows end there, so no variant is made that does not occur.
    """
    if bins is None:
        bins = search_bins.text_bins(stored(build(reads if "read_rank" in reads.columns else prepare_reads(reads))))
    k = kmers.select("kmer").filter(F.length("kmer") > 0).distinct()
    total = search_bins.rows_of(bins)
    d = stored(k.select("kmer", F.length("kmer").alias("left"), F.lit(0).cast("long").alias("l"), F.lit(total).cast("long").alias("h"), F.lit("").alias("variant"), F.lit("").alias("ops"), F.lit(0).alias("used")))
    done = []
    while not d.limit(1).isEmpty():
        # lows and highs of A, C, G, N and T: one row a range, which many variants share
        d = d.join(stored(search_bins.extended(bins, d.select("l", "h").distinct())), ["l", "h"])
        own, last = F.substr("kmer", F.col("left"), F.lit(1)), F.substring("ops", 1, 1)
        may = (F.col("used") < edits) & (F.col("ops") != "")
        every = F.transform(F.array(*[F.lit(x) for x in _LETTERS]), lambda c, i: F.struct(c.alias("c"), F.get("lows", i).alias("l"), F.get("highs", i).alias("h")))
        step = d.withColumn("x", F.explode(F.filter(every, lambda x: x["h"] - x["l"] >= F.greatest(F.lit(least), F.lit(1))))).withColumn("own", own).withColumn("other", (F.col("x.c") != own).cast("int"))
        moved = lambda kind, left, used: step.select("kmer", left.cast("int").alias("left"), "x.l", "x.h", F.concat("x.c", "variant").alias("variant"), F.concat(F.lit(kind), "ops").alias("ops"), used.cast("int").alias("used"), "other", "may", "last")
        step = step.withColumn("may", may).withColumn("last", last)
        on = moved("0", F.col("left") - 1, F.col("used") + F.col("other")).filter(F.col("used") <= edits)
        more = moved("1", F.col("left"), F.col("used") + 1).filter(F.col("may") & (F.col("other") == 1) & (F.col("last") != "2"))
        less = d.filter(may & (last != "1") & (F.col("left") > 1)).select("kmer", (F.col("left") - 1).alias("left"), "l", "h", "variant", F.concat(F.lit("2"), "ops").alias("ops"), (F.col("used") + 1).alias("used"))
        d = stored(on.unionByName(more).drop("other", "may", "last").unionByName(less))
        done.append(d.filter("left = 0").select("kmer", "variant", "ops", "l", "h", "used"))
        d = d.filter("left > 0")
    if not done:
        return k.select("kmer", F.lit("").alias("variant"), F.lit("").alias("ops"), F.lit(0).cast("long").alias("l"), F.lit(0).cast("long").alias("h")).limit(0)
    found = reduce(DataFrame.unionByName, done)
    exact = found.filter("used = 0").select("kmer", F.col("l").alias("exact_l"), F.col("h").alias("exact_h"))
    d = found.join(exact, "kmer", "left")
    low, high = F.col("exact_l"), F.col("exact_h")
    d = d.withColumn("own", (F.col("used") == 0) | low.isNull())
    d = d.withColumn("l", F.when(~F.col("own") & (F.col("l") >= low) & (F.col("l") < high), high).otherwise(F.col("l"))).withColumn("h", F.when(~F.col("own") & (F.col("h") > low) & (F.col("h") <= high), low).otherwise(F.col("h")))
    apart = (F.col("h") - F.col("l") >= F.greatest(F.lit(least), F.lit(1))) & ~F.contains("variant", F.col("kmer")) & ~F.contains("kmer", F.col("variant"))
    return d.filter(F.col("own") | apart).select("kmer", "variant", "ops", "l", "h")
