"""Global row numbers without a one-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.plans.store import stored

#: Bits of a row's place in its partition, as Spark's increasing ids have them.
_PLACE = 33


def ranked(df: DataFrame, order: list[Column], name: str, keep: list[str] | None = None) -> DataFrame:
    """Adds ``name``: the 0-based rank by ``order``, which must be total but for rows that are alike.

    Rows are sorted in ranges of ``order``, which split any hot prefix, and stored with their place; a range's first
    rank is the size of the ranges before. There is one offset a partition. Only the columns ``keep`` are stored, if given.
    """
    d = df.repartitionByRange(*order).sortWithinPartitions(*order)
    d = stored((d if keep is None else d.select(*keep)).withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftright("__m", _PLACE).cast("int")
    sizes = d.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()  # a row a partition of the sort
    offsets, before = [], 0
    for r in sizes:
        offsets.append((r["p"], before - (r["p"] << _PLACE)))
        before += r["n"]
    known = df.sparkSession.createDataFrame(offsets, "__p int, __o long")
    return d.join(F.broadcast(known), part == F.col("__p")).withColumn(name, F.col("__m") + F.col("__o")).drop("__m", "__p", "__o")
