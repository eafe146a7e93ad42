"""Connected components: union-find inside partitions, alternating large and small stars between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import hot_keys, materialize, salted_join

MAX_ROUNDS = 100
#: Edges of a partition, which one task holds.
EDGES = 200_000


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _settled(e: DataFrame, parts: int) -> DataFrame:
    """Edges (u, v) with v the smallest node that u reaches by the edges of its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over: dict = {}

        def top(x):
            while (y := over.get(x, x)) != x:
                over[x] = over.get(y, y)
                x = y
            return x

        kind = None
        for batch in batches:
            kind = batch.schema.field("u").type
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                x, y = top(u), top(v)
                if x != y:
                    over[max(x, y)] = min(x, y)
        if over:
            nodes = list(over)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([top(x) for x in nodes], kind)], ["u", "v"])

    return e.coalesce(parts).mapInArrow(run, e.schema)


def _stars(e: DataFrame) -> DataFrame:
    """One large and one small star: each node is joined to the smallest of its neighbours."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n")))
    large = salted_join(both, least.select("u", "m"), "u", hot_keys(least, "u"), F.col("v")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    small = large.groupBy("u").agg(F.min("v").alias("m"))
    e = large.join(small, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return e.filter("u <> v").distinct()


def joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """The components of a graph whose ``comp`` (node, component) is known, with more links (a, b)."""
    return components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links.select("a", "b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of ``edges`` (a, b); component: the smallest node reachable.

    Partitions hold up to EDGES edges each and settle them; where there are several, stars join their results. The rounds
    grow with the logarithm of a component's size; an error is raised if MAX_ROUNDS do not suffice.
    """
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v"))
    last = None
    for _ in range(MAX_ROUNDS):
        parts = max(1, -(-e.count() // EDGES))
        e = materialize(_settled(e, parts))
        if parts == 1:
            break
        e = materialize(_stars(e))
        if last == (last := _state(e)):
            break
    else:
        raise RuntimeError(f"components are not settled after {MAX_ROUNDS} rounds")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return materialize(nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
