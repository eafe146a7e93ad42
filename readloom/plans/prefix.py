"""Running sums and maxima over numbered rows, and groups of neighbouring rows, without a window over all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: log2 of the numbers in a block: a window holds a block, and the one over blocks a row for each.
BLOCK_BITS = 13
#: log2 of the rows in a block of neighbours.
ROW_BITS = 16


def before(d: DataFrame, at: str, columns: list[str], agg: Callable[[str], Column] = F.sum, zero: object = 0) -> DataFrame:
    """``d`` with each of ``columns`` replaced by its aggregate over the rows of smaller ``at`` (``zero`` for the first).

    ``at`` numbers the rows, each once. Two levels: inside blocks of 2^BLOCK_BITS numbers, and over the blocks. ``d`` is gone
    through twice.
    """
    d = d.withColumn("__block", F.shiftright(at, BLOCK_BITS))
    up = lambda c, over: agg(c).over(over.rowsBetween(W.unboundedPreceding, -1))
    whole = d.groupBy("__block").agg(*[agg(c).alias(c) for c in columns])
    whole = whole.select(F.col("__block"), *[up(c, W.orderBy("__block")).alias(f"__of_{c}") for c in columns])
    rest = [c for c in d.columns if c not in columns]
    inside = d.select(*rest, *[up(c, W.partitionBy("__block").orderBy(at)).alias(c) for c in columns])
    join = {F.sum: lambda x, y: F.coalesce(x, F.lit(zero)) + F.coalesce(y, F.lit(zero)), F.max: lambda x, y: F.coalesce(F.greatest(x, y), F.lit(zero))}[agg]
    out = inside.join(whole, "__block")
    return out.select(*[c for c in rest if c != "__block"], *[join(F.col(f"__of_{c}"), F.col(c)).cast("long").alias(c) for c in columns])


def neighbours(d: DataFrame, at: str, columns: list[str]) -> DataFrame:
    """``d`` with __first and __last: whether a row differs from the one before, or after, in any of ``columns``.

    ``at`` numbers the rows without gaps. Windows span a block; the rows at its edges are also handed to the blocks beside it.
    """
    size = 1 << ROW_BITS
    d = d.withColumn("__b", F.shiftright(at, ROW_BITS)).withColumn("__own", F.lit(True))
    edge = lambda rest, step: d.filter(F.pmod(at, F.lit(size)) == rest).withColumn("__b", F.col("__b") + step).withColumn("__own", F.lit(False))
    over = W.partitionBy("__b").orderBy(at)
    key = F.struct(*columns)
    # a missing neighbour is null, which is equal to no key
    both = d.unionByName(edge(size - 1, 1)).unionByName(edge(0, -1))
    both = both.withColumn("__first", ~F.coalesce(F.lag(key).over(over) == key, F.lit(False))).withColumn("__last", ~F.coalesce(F.lead(key).over(over) == key, F.lit(False)))
    return both.filter("__own").drop("__own", "__b")


def group_starts(d: DataFrame, at: str, columns: list[str], name: str) -> DataFrame:
    """``d``, numbered by ``at`` in the order of ``columns``, with ``name``, the smallest number with the same ``columns``, and
    __single: whether the row is alone with them. A group may have any size; no window holds more than a block."""
    d = neighbours(d, at, columns).withColumn("__single", F.col("__first") & F.col("__last"))
    d = d.withColumn("__b", F.shiftright(at, ROW_BITS))
    begun = F.max(F.when(F.col("__first"), F.col(at))).over(W.partitionBy("__b").orderBy(at).rowsBetween(W.unboundedPreceding, 0))
    edges = d.groupBy("__b").agg(F.max(F.when(F.col("__first"), F.col(at))).alias("__start"))
    carried = before(edges, "__b", ["__start"], F.max, -1)
    return d.withColumn(name, begun).join(carried, "__b").withColumn(name, F.coalesce(name, "__start")).drop("__b", "__start", "__first", "__last")
