"""Matching statistics from the stored order: where a reference's tails lie among the rows, and what the rows there share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions.dna import common_prefix, reverse_complement
from readloom.operators import bins as search_bins
from readloom.operators.index import prepare_reads, sorted_rows
from readloom.operators.packed import Sorted
from readloom.plans.store import stored

#: Rows asked for that a broadcast may hold, as numbers.
ASKED = 200_000


def picked(rows: DataFrame | Sorted, asked: DataFrame) -> DataFrame:
    """(row, suffix) of ``rows`` whose row is in ``asked`` (row, each once): few numbers are broadcast, many are joined."""
    if isinstance(rows, Sorted):
        few = [r["row"] for r in asked.limit(ASKED + 1).collect()]
        return rows.rows("suffix", only=np.array(sorted(few), np.int64)) if len(few) <= ASKED else rows.rows("suffix").join(asked, "row")
    few = asked.limit(ASKED + 1).count() <= ASKED
    return rows.select("row", "suffix").join(F.broadcast(asked) if few else asked, "row")


def ranges_of(rows: DataFrame | Sorted, patterns: DataFrame, bins: DataFrame | None = None) -> DataFrame:
    """(pattern, l, h) of distinct patterns of letters: looked up among sorted rows, if they are few, else in bins."""
    few = rows.places(patterns, ASKED) if isinstance(rows, Sorted) else None
    return search_bins.find(_binned(rows, bins), patterns.select("pattern")).select("pattern", "l", "h") if few is None else few


def _binned(rows: DataFrame | Sorted, bins: DataFrame | None) -> DataFrame:
    return bins if bins is not None else search_bins.text_bins(rows.rows("sym") if isinstance(rows, Sorted) else rows)


def _indexed(reads: DataFrame) -> DataFrame | Sorted:
    d = reads if "read_rank" in reads.columns else prepare_reads(reads if "seq_id" in reads.columns else reads.withColumn("seq_id", F.monotonically_increasing_id()))
    return sorted_rows(d, ("sym", "suffix"))


def matching_statistics(refs: DataFrame, reads: DataFrame, threshold: int, longest: int, rows: DataFrame | Sorted | None = None, bins: DataFrame | None = None) -> DataFrame:
    """(ref_id, pos, len): the longest substring from each place that occurs at least ``threshold`` times.

    A present single letter counts as 1 even under the threshold; ``longest`` is the longest read. ``rows`` and ``bins`` are the
    index of ``reads``, which is built if they are missing. All tails of the references are looked up among sorted rows in one pass
    over their keys, or, where rows are a table or tails are many, step through the bins together to their place. Rows get less alike the further they are from that place, so a prefix occurs ``threshold`` times
    if it is shared with ``threshold`` of the rows around: of the ``2 * threshold`` nearest rows the threshold-th longest
    common prefix is the answer. Only those rows are read.
    """
    rows = _indexed(reads) if rows is None else rows
    at = F.explode(F.sequence(F.lit(0), F.length("seq") - 1))
    tails = stored(refs.filter("seq <> ''").select("ref_id", "seq", at.alias("pos")).select("ref_id", "pos", F.substr("seq", F.col("pos") + 1, F.lit(longest)).alias("tail")))
    asked = tails.select(F.col("tail").alias("pattern"))
    place = rows.places(asked, ASKED) if isinstance(rows, Sorted) else None
    place = search_bins.places(_binned(rows, bins), asked) if place is None else place
    near = stored(place.select("pattern", F.explode(F.sequence(F.col("l") - threshold, F.col("l") + threshold - 1)).alias("row")).filter("row >= 0"))
    held = picked(rows, near.select("row").distinct())
    shared = near.join(held, "row").select("pattern", common_prefix(F.col("pattern"), F.col("suffix"), longest).alias("n"))
    order = F.sort_array(F.collect_list("n"), asc=False)  # at most 2 * threshold
    n = shared.groupBy("pattern").agg(order.alias("n"))
    long = F.coalesce(F.get("n", F.lit(threshold - 1)), F.lit(0))
    n = n.select(F.col("pattern").alias("tail"), F.greatest(long, F.least(F.get("n", F.lit(0)), F.lit(1))).alias("len"))
    return tails.join(n, "tail", "left").select("ref_id", "pos", F.coalesce("len", F.lit(0)).cast("int").alias("len"))


def matching_statistics_both(refs: DataFrame, reads: DataFrame, threshold: int, longest: int, rows: DataFrame | Sorted | None = None, bins: DataFrame | None = None) -> DataFrame:
    """Forward plus mirrored reverse-complement matching statistics."""
    rows = _indexed(reads) if rows is None else rows
    bins = bins if isinstance(rows, Sorted) else _binned(rows, bins)
    both = refs.select("ref_id", "seq", F.lit(True).alias("own")).unionByName(refs.select("ref_id", reverse_complement(F.col("seq")).alias("seq"), F.lit(False).alias("own")))
    both = both.select(F.struct("ref_id", "own", F.length("seq").alias("size")).alias("ref_id"), "seq")
    d = matching_statistics(both, reads, threshold, longest, rows, bins)
    pos = F.when(F.col("ref_id.own"), F.col("pos")).otherwise(F.col("ref_id.size") - 1 - F.col("pos"))
    return d.select(F.col("ref_id.ref_id").alias("ref_id"), pos.cast("int").alias("pos"), "len").groupBy("ref_id", "pos").agg(F.sum("len").cast("int").alias("len"))


def best_other(refs: DataFrame, reads: DataFrame, threshold: int, longest: int, least: int = 20, rows: DataFrame | Sorted | None = None, bins: DataFrame | None = None) -> DataFrame:
    """(ref_id, pos, other): where a match of more than ``least`` symbols goes on from pos + 1, the largest count of another first letter before it."""
    rows = _indexed(reads) if rows is None else rows
    bins = bins if isinstance(rows, Sorted) else _binned(rows, bins)
    stats = matching_statistics(refs, reads, threshold, longest, rows, bins).filter((F.col("len") > least) & (F.col("pos") > 0))
    d = stats.join(refs, "ref_id").select("ref_id", (F.col("pos") - 1).alias("pos"), F.substr("seq", F.col("pos"), F.lit(1)).alias("own"), F.substr("seq", F.col("pos") + 1, F.col("len")).alias("tail"))
    alts = F.filter(F.array(*[F.lit(x) for x in "ACGNT"]), lambda x: x != F.col("own"))
    v = stored(d.select("ref_id", "pos", F.explode(alts).alias("a"), "tail").select("ref_id", "pos", F.concat("a", "tail").alias("pattern")))
    found = ranges_of(rows, v, bins)
    return v.join(found, "pattern").groupBy("ref_id", "pos").agg(F.max(F.col("h") - F.col("l")).cast("long").alias("other"))
