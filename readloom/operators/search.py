"""Exact and wildcard search, k-mer counts, mass queries, pileups, profiles and matching reads."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readloom.functions.dna import ALPHABET, reverse_complement, wildcard_regex, windows
from readloom.operators import bins as search_bins
from readloom.operators.index import rotation, starting
from readloom.operators.matching import best_other, matching_statistics, matching_statistics_both
from readloom.operators.packed import Sorted
from readloom.plans.ranking import ranked

__all__ = ["best_other", "matching_statistics", "matching_statistics_both"]


#: Letters of a window that is counted as a number, 3 bits each; of one that has a place in an array. Windows counted together.
CODED, PLACED, TOGETHER = 21, 7, 1 << 22


def _counted(reads: DataFrame, ks: list[int]) -> DataFrame:
    """(kmer, cnt), a k-mer several times: the substrings of the lengths ``ks``, counted where the reads are read.

    Windows are numbers of 3 bits a letter. Short ones have their places in an array of a task, others are counted
    TOGETHER at a time. Reads with symbols outside the alphabet are counted as strings.
    """
    letters, placed, together = np.frombuffer(ALPHABET.encode(), np.uint8), PLACED, TOGETHER
    codes = np.full(256, 7, np.uint8)
    codes[letters] = np.arange(len(letters))

    def line(keys: np.ndarray, n: np.ndarray, k: int) -> pa.RecordBatch:
        d = letters[(keys[:, None] >> (3 * np.arange(k - 1, -1, -1))) & 7]
        kmer = pa.StringArray.from_buffers(len(keys), pa.py_buffer((np.arange(len(keys) + 1) * k).astype(np.int32)), pa.py_buffer(d.tobytes()))
        return pa.RecordBatch.from_arrays([kmer, pa.array(n.astype(np.int64))], ["kmer", "cnt"])

    def summed(parts: list) -> list:
        keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        keys, at = np.unique(keys, return_inverse=True)
        return [(keys, np.bincount(at, n, len(keys)).astype(np.int64))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {k: np.zeros(1 << (3 * k), np.int64) for k in ks if k <= placed}
        more: dict[int, list] = {k: [] for k in ks if k > placed}
        odd: Counter = Counter()
        for batch in batches:
            text = [x for x in batch.column(0).to_pylist() if x]
            strange = [x for x in text if not x.isascii() or x.strip(ALPHABET)]
            odd.update(x[i : i + k] for x in strange for k in ks for i in range(len(x) - k + 1))
            # a separator of its own code tells reads apart
            c = codes[np.frombuffer("|".join(x for x in text if not (strange and (not x.isascii() or x.strip(ALPHABET)))).encode(), np.uint8)]
            ends = np.concatenate([[0], np.cumsum(c == 7)])
            for k in ks:
                if len(c) < k:
                    continue
                key = np.zeros(len(c) - k + 1, np.int64)
                for j in range(k):
                    key = (key << 3) | c[j : len(c) - k + 1 + j]
                key = key[ends[k:] == ends[: len(ends) - k]]
                if k in held:
                    held[k] += np.bincount(key, minlength=len(held[k]))
                else:
                    more[k].append(np.unique(key, return_counts=True))
                    if sum(len(x) for x, _ in more[k]) > together:
                        more[k] = summed(more[k])
                        if len(more[k][0][0]) > together // 2:
                            yield line(*more[k].pop(), k)
        for k, n in held.items():
            if len(at := np.nonzero(n)[0]):
                yield line(at, n[at], k)
        for k, parts in more.items():
            if parts:
                yield line(*summed(parts)[0], k)
        if odd:
            yield pa.RecordBatch.from_arrays([pa.array(list(odd), pa.string()), pa.array(list(odd.values()), pa.int64())], ["kmer", "cnt"])

    return reads.select(F.col("seq").cast("string").alias("seq")).mapInArrow(run, "kmer string, cnt long")


def _every_count(reads: DataFrame, ks: list[int]) -> DataFrame:
    """(kmer, cnt) of all substrings of the lengths ``ks``."""
    few = sorted({k for k in ks if 0 < k <= CODED})
    parts = [_counted(reads, few)] if few else []
    parts += [reads.select(F.explode(windows(F.col("seq"), k)).alias("kmer"), F.lit(1).cast("long").alias("cnt")) for k in sorted(set(ks) - set(few))]
    return reduce(DataFrame.unionByName, parts).groupBy("kmer").agg(F.sum("cnt").alias("cnt"))


def kmer_counts(reads: DataFrame, k: int) -> DataFrame:
    """(kmer, cnt) of all letters-only substrings of length k."""
    return _every_count(reads, [k])


def _lengths(kmers: DataFrame, column: str = "kmer") -> list[int]:
    """The distinct query lengths: a handful of integers."""
    return sorted(r[0] for r in kmers.select(F.length(column)).distinct().collect() if r[0])


def counts_of(kmers: DataFrame, reads: DataFrame, ks: list[int] | None = None) -> DataFrame:
    """(kmer, cnt) of the distinct k-mers asked for that occur; only their lengths are counted."""
    wanted = kmers.select("kmer").distinct()
    ks = _lengths(wanted) if ks is None else ks
    if not ks:
        return wanted.select("kmer", F.lit(0).cast("long").alias("cnt")).limit(0)
    # counts first: each side of the join then has one row a k-mer, whatever the skew
    return _every_count(reads, ks).join(wanted, "kmer", "left_semi")


def mass_query(kmers: DataFrame, reads: DataFrame, reverse: bool = True, ks: list[int] | None = None) -> DataFrame:
    """``kmers`` with counts and, if ``reverse``, rev_comp_counts; 0 where absent. Query order columns are kept."""
    rc = reverse_complement(F.col("kmer"))
    asked = kmers.select("kmer").unionByName(kmers.select(rc.alias("kmer"))) if reverse else kmers
    got = counts_of(asked, reads, ks)
    d = kmers.join(got.withColumnRenamed("cnt", "counts"), "kmer", "left").withColumn("counts", F.coalesce("counts", F.lit(0)).cast("long"))
    if reverse:
        d = d.withColumn("__rc", rc).join(got.select(F.col("kmer").alias("__rc"), F.col("cnt").alias("rev_comp_counts")), "__rc", "left")
        d = d.withColumn("rev_comp_counts", F.coalesce("rev_comp_counts", F.lit(0)).cast("long")).drop("__rc")
    return d


def find_ranges(index: DataFrame, reads: DataFrame, patterns: DataFrame, longest: int) -> DataFrame:
    """(pattern, l, h) of all distinct patterns, over the cyclic rotations: l rows are smaller, h - l start with it.

    Patterns may hold ``$``. They are searched in bins made of ``index``; with bins at hand, see ``bins.find``.
    """
    return search_bins.find(search_bins.text_bins(index), patterns).select("pattern", "l", "h")


def islands(rows: DataFrame) -> DataFrame:
    """(l, h): the maximal runs of consecutive numbers in distinct ``row``."""
    d = rows.select("row").distinct()
    first = d.join(d.select((F.col("row") + 1).alias("row")), "row", "left_anti")
    last = d.join(d.select((F.col("row") - 1).alias("row")), "row", "left_anti")
    number = lambda x, name: ranked(x, [F.col("row").asc()], "i").select("i", F.col("row").alias(name))
    return number(first, "l").join(number(last, "e"), "i").select("l", (F.col("e") + 1).alias("h"))


def wildcard_ranges(index: DataFrame | Sorted, reads: DataFrame, pattern: str, longest: int) -> DataFrame:
    """(l, h): merged row ranges whose rotation starts with a match; ``?`` one letter, ``*`` any letters.

    ``longest`` bounds the letters that a match may need: the longest read with its ``$``.
    """
    sure, letters = (re.match(x, pattern)[0] for x in (r"[^?*]*", r"[^?*$]*"))
    inner, _, over = pattern.partition("$")
    if isinstance(index, Sorted):
        index = index.rows("suffix", *(["read_rank", "pos"] if over else []), prefix=letters)
    if not over:
        # no symbol behind a ``$``, which no wildcard stands for: suffixes tell
        return islands(starting(index, letters).filter(F.rlike("suffix", F.lit(wildcard_regex(pattern)))).select("row"))
    rot = rotation(starting(index, sure).filter(F.rlike("suffix", F.lit(wildcard_regex(inner + "$")))), reads, longest)
    return islands(rot.filter(F.rlike("rot", F.lit(wildcard_regex(pattern)))).select("row"))


def reads_with(index: DataFrame, reads: DataFrame, pattern: str) -> DataFrame:
    """(row, read_rank, read): one row a hit, in row order; a read with several hits is listed as often."""
    rot = rotation(starting(index, pattern), reads, max(1, len(pattern)))
    hits = rot.filter(F.startswith("rot", F.lit(pattern))).select("row", "read_rank")
    return hits.join(reads.select("read_rank", F.concat("seq", F.lit("$")).alias("read")), "read_rank").select("row", "read_rank", "read")


def _windows_of(refs: DataFrame, k: int) -> DataFrame:
    return refs.select("ref_id", "seq", F.posexplode(windows(F.col("seq"), k)).alias("pos", "kmer"))


def pileup(refs: DataFrame, reads: DataFrame, k: int, stranded: bool = False) -> DataFrame:
    """(ref_id, pos, cnt): how often each k-mer of a reference occurs, both strands unless ``stranded``; none if shorter than k."""
    w = _windows_of(refs, k).select("ref_id", "pos", "kmer")
    got = mass_query(w, reads, not stranded, [k])
    total = F.col("counts") if stranded else F.col("counts") + F.col("rev_comp_counts")
    return got.select("ref_id", F.col("pos").cast("int").alias("pos"), total.alias("cnt"))


def other_choices(refs: DataFrame, reads: DataFrame, k: int, stranded: bool = True) -> DataFrame:
    """(ref_id, pos, cnt, other): other is the count of k-mers that differ from the window in its first letter only.

    With both strands, the reverse complement's values are added at the mirrored position.
    """
    counts = kmer_counts(reads, k)
    tails = counts.groupBy(F.substring("kmer", 2, max(1, k - 1)).alias("tail")).agg(F.sum("cnt").alias("all")) if k > 1 else None

    def one(d: DataFrame) -> DataFrame:
        w = _windows_of(d, k).select("ref_id", F.length("seq").alias("len"), "pos", "kmer")
        got = w.join(counts, "kmer", "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))
        if tails is None:
            total = counts.agg(F.sum("cnt").alias("all"))
            return got.crossJoin(F.broadcast(total)).withColumn("other", F.coalesce("all", F.lit(0)) - F.col("cnt")).drop("all")
        return got.withColumn("tail", F.substring("kmer", 2, k - 1)).join(tails, "tail", "left").withColumn("other", F.coalesce(F.col("all") - F.col("cnt"), F.lit(0)))

    fwd = one(refs).select("ref_id", "pos", "cnt", "other")
    if not stranded:
        back = one(refs.withColumn("seq", reverse_complement(F.col("seq")))).select("ref_id", (F.col("len") - k - F.col("pos")).alias("pos"), F.col("cnt").alias("c2"), F.col("other").alias("o2"))
        fwd = fwd.join(back, ["ref_id", "pos"]).select("ref_id", "pos", (F.col("cnt") + F.col("c2")).alias("cnt"), (F.col("other") + F.col("o2")).alias("other"))
    return fwd.select("ref_id", F.col("pos").cast("int").alias("pos"), F.col("cnt").cast("long").alias("cnt"), F.col("other").cast("long").alias("other"))


def profile(reads: DataFrame, k: int) -> DataFrame:
    """(kmer, cnt) of all length-k prefixes of all cyclic rotations, ``$`` included."""
    q = reads.select(F.concat("seq", F.lit("$")).alias("q"))
    wide = F.substr(F.repeat("q", (F.lit(k) / F.length("q")).cast("int") + 2), F.lit(1), F.length("q") + k - 1)
    return q.select(F.explode(windows(wide, k)).alias("kmer")).groupBy("kmer").agg(F.count(F.lit(1)).alias("cnt"))


def norm(prof: DataFrame) -> DataFrame:
    """(l2): the length of a profile's count vector."""
    return prof.agg(F.sqrt(F.sum(F.col("cnt").cast("double") * F.col("cnt"))).alias("l2"))


def compare_profiles(a: DataFrame, b: DataFrame) -> DataFrame:
    """(max_delta, l2, sum_delta, cosine) of two profiles, each divided by its own length. One row."""
    na, nb = norm(a).withColumnRenamed("l2", "na"), norm(b).withColumnRenamed("l2", "nb")
    d = a.withColumnRenamed("cnt", "ca").join(b.withColumnRenamed("cnt", "cb"), "kmer", "full_outer")
    d = d.crossJoin(F.broadcast(na)).crossJoin(F.broadcast(nb))  # one row each
    x, y = F.coalesce("ca", F.lit(0)) / F.col("na"), F.coalesce("cb", F.lit(0)) / F.col("nb")
    return d.select(x.alias("x"), y.alias("y")).agg(
        F.max(F.abs(F.col("x") - F.col("y"))).alias("max_delta"),
        F.sqrt(F.sum((F.col("x") - F.col("y")) * (F.col("x") - F.col("y")))).alias("l2"),
        F.sum(F.abs(F.col("x") - F.col("y"))).alias("sum_delta"),
        F.sum(F.col("x") * F.col("y")).alias("cosine"),
    )


def reads_matching(refs: DataFrame, reads: DataFrame, length: int) -> DataFrame:
    """(ref_id, read_rank): reads whose first ``length`` symbols equal some window of a reference."""
    w = _windows_of(refs, length).select("ref_id", "kmer").distinct()
    r = reads.filter(F.length("seq") >= length).select("read_rank", F.substring("seq", 1, length).alias("kmer"))
    return w.join(r, "kmer").select("ref_id", "read_rank").distinct()


def hamming(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda x: x))


def reads_matching_one_change(refs: DataFrame, reads: DataFrame, length: int) -> DataFrame:
    """The same with at most one substitution: one of the two halves must be equal, the rest is compared."""
    half = length // 2
    w = _windows_of(refs, length).select("ref_id", "kmer").distinct()
    r = reads.filter(F.length("seq") >= length).select("read_rank", F.substring("seq", 1, length).alias("head"))
    halves = lambda c: F.explode(F.array(F.concat(F.lit("1"), F.substring(c, 1, half)), F.concat(F.lit("2"), F.substring(c, half + 1, length))))
    met = w.withColumn("h", halves("kmer")).join(r.withColumn("h", halves("head")), "h")
    return met.filter(hamming(F.col("kmer"), F.col("head")) <= 1).select("ref_id", "read_rank").distinct()
