"""Approximate nearest neighbours with hash-prefix forests.

The rows are dealt into shards. Each shard holds TREES sorted arrays of 64-bit strings of random-hyperplane bits. A
query descends every array to its longest prefix match, then all arrays ascend together, a bit at a time; what each
level adds is compared exactly. It stops when a row as near as the fifth found would have been met with probability
``sure`` (its chance to share so long a prefix in at least one tree follows from its angle), so the depth of the ascent
follows the data. Queries come in blocks of bounded size that are broadcast; every block meets every shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readloom.llm.common import materialize

TREES, BITS = 32, 64
SURE = 0.97
#: Rows of a shard (in memory at once), and queries of a block (broadcast at once).
SHARD, BLOCK = 16_384, 8_192
SEED = 5


def _planes(dims: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dims, TREES * BITS)).astype(np.float32)


def _strings(unit: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """One 64-bit string a tree and row: (TREES, n) unsigned."""
    out = np.empty((TREES, len(unit)), np.uint64)
    for a in range(0, len(unit), 4096):
        bits = (unit[a : a + 4096].astype(np.float32) @ planes) > 0
        packed = np.packbits(bits.reshape(-1, TREES, BITS), axis=2)
        out[:, a : a + 4096] = np.ascontiguousarray(packed).view(">u8")[:, :, 0].astype(np.uint64).T
    return out


def cosines(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosines in double precision, each summed in the same order."""
    return (rows * query).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum()))


def _best(ids: np.ndarray, scores: np.ndarray, k: int, once: bool = True) -> np.ndarray:
    """Where the k best scores are, best first, ties to smaller ids. Unless ids occur ``once``, only the best of each counts."""
    if not once:
        order = np.lexsort((ids, -scores))
        first = np.unique(ids[order], return_index=True)[1]
        return order[np.sort(first)[:k]]
    if len(ids) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        found = np.nonzero(scores >= least)[0]
    else:
        found = np.arange(len(ids))
    return found[np.lexsort((ids[found], -scores[found]))[:k]]


class Forest:
    """The sorted strings of one shard."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, planes: np.ndarray) -> None:
        self.ids, self.rows = ids, rows
        self.once = len(np.unique(ids)) == len(ids)
        strings = _strings(rows / np.sqrt((rows * rows).sum(axis=1))[:, None], planes)
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.strings = np.take_along_axis(strings, self.order, axis=1)

    def ranges(self, strings: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """For each tree and query the part of the sorted array that shares ``level`` leading bits."""
        low, high = np.empty(strings.shape, np.int64), np.empty(strings.shape, np.int64)
        for t in range(TREES):
            if level == 0:
                low[t], high[t] = 0, len(self.ids)
                continue
            first = (strings[t] >> np.uint64(BITS - level)) << np.uint64(BITS - level)
            low[t] = np.searchsorted(self.strings[t], first, "left")
            high[t] = np.searchsorted(self.strings[t], first + np.uint64((1 << (BITS - level)) - 1), "right")
        return low, high

    def search(self, ids: np.ndarray, queries: np.ndarray, strings: np.ndarray, k: int, sure: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query position, row positions, cosines) of the k nearest found for each query but itself."""
        n, live = len(self.ids), np.arange(len(ids))
        met = np.zeros((len(ids), n), bool)
        held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(ids)
        level = BITS
        while len(live):
            low, high = self.ranges(strings[:, live], level)
            after = []
            for j, q in enumerate(live.tolist()):
                new = np.zeros(n, bool)
                for t in np.nonzero(high[:, j] > low[:, j])[0].tolist():
                    new[self.order[t, low[t, j] : high[t, j]]] = True
                new &= ~met[q]
                at = np.nonzero(new)[0]
                if len(at):
                    met[q] |= new
                    at = at[self.ids[at] != ids[q]]
                    both = np.concatenate([held[q][0], at])
                    scores = np.concatenate([held[q][1], cosines(self.rows[at], queries[q])])
                    top = _best(self.ids[both], scores, k, self.once)
                    held[q] = (both[top], scores[top])
                if level and (len(held[q][0]) < k or 1 - (1 - (1 - np.arccos(min(1.0, max(-1.0, held[q][1][-1]))) / np.pi) ** level) ** TREES < sure):
                    after.append(q)
            live = np.array(after, np.int64)
            # the longest match of the shard is some log2(n) bits; above it the arrays ascend in long strides
            level = level - 1 if level <= 20 else max(20, level - 8)
            if level < 0:
                break
        for q, (at, scores) in enumerate(held):
            yield q, at, scores


def valid_vectors(vectors: DataFrame, ident: str, vector: str) -> DataFrame:
    """(ident, v) of the vectors that take part: not null, not empty, all components finite, not all zero."""
    d = vectors.select(F.col(ident).alias("ident"), F.col(vector).cast("array<double>").alias("v")).filter("ident is not null and v is not null")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    d = d.filter((F.size("v") > 0) & ~F.coalesce(bad, F.lit(False)) & F.exists("v", lambda x: x != 0))
    # a power of two changes no cosine; it keeps the squares of very large and very small vectors in range
    top = F.array_max(F.transform("v", lambda x: F.abs(x)))
    scale = F.when(top > 1e100, F.lit(2.0**-600)).when(top < 1e-100, F.lit(2.0**600))
    return d.withColumn("v", F.when(scale.isNull(), F.col("v")).otherwise(F.transform("v", lambda x: x * scale)))


def nearest(vectors: DataFrame, is_query, k: int = 5, ident: str = "vec_id", vector: str = "embedding", sure: float = SURE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row where ``is_query`` (a function of the id column).

    Nearness is the cosine in double precision, ties go to the smaller id; a query is no candidate of its own (rows of
    the same id count as the query itself). Of candidates with one id the nearest counts; of queries with one id the
    smallest vector (the shorter, then by its first components) is searched. All rows are indexed. Vectors that are null, empty, zero or hold null or
    non-finite components take no part, nor do vectors of another length than the query's. Finite vectors of any size do.
    An empty table gives no rows; other columns are left out.
    """
    spark = vectors.sparkSession
    rows = valid_vectors(vectors, ident, vector)
    total = rows.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    shards = max(1, -(-total // SHARD))
    table = materialize(rows.withColumn("dims", F.size("v")).withColumn("shard", F.pmod(F.xxhash64("ident", F.lit(1)), F.lit(shards)).cast("int")).repartition(shards, "shard"))
    queries = table.filter(is_query(F.col("ident"))).groupBy("ident").agg(F.min(F.struct("dims", "v")).alias("q")).select("ident", "q.dims", "q.v")
    blocks = max(1, -(-(asked := queries.count()) // BLOCK))
    queries = materialize(queries.withColumn("block", F.pmod(F.xxhash64("ident", F.lit(2)), F.lit(blocks))).select("block", "ident", "dims", "v"))
    schema = "query_id long, vec_id long, score double"
    found = spark.createDataFrame([], schema)
    for block in range(blocks if asked else 0):
        got = queries.filter(F.col("block") == block).drop("block").toPandas()  # about BLOCK rows
        by_length = {int(d): (x["ident"].to_numpy(np.int64), np.stack(x["v"].to_numpy()).astype(np.float64)) for d, x in got.groupby("dims")}
        sent = spark.sparkContext.broadcast(by_length)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            parts: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}

            def out(dims: int, pieces: list) -> Iterator[pa.RecordBatch]:
                if dims not in sent.value:
                    return
                ids, qs = sent.value[dims]
                planes = _planes(dims)
                forest = Forest(np.concatenate([p[0] for p in pieces]), np.concatenate([p[1] for p in pieces]), planes)
                for a in range(0, len(ids), 1024):
                    own, q = ids[a : a + 1024], qs[a : a + 1024]
                    strings = _strings(q / np.sqrt((q * q).sum(axis=1))[:, None], planes)
                    rows = [(np.full(len(at), own[i]), forest.ids[at], s) for i, at, s in forest.search(own, q, strings, k, sure)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], ["query_id", "vec_id", "score"])

            for batch in batches:
                ids, shard, dims = (batch.column(c).to_numpy() for c in ("ident", "shard", "dims"))
                for s, d in {*zip(shard.tolist(), dims.tolist(), strict=True)}:
                    at = np.nonzero((shard == s) & (dims == d))[0]
                    v = batch.column("v").take(pa.array(at))
                    piece = parts.setdefault((s, d), [])
                    piece.append((ids[at].astype(np.int64), v.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)))
                    if sum(len(p[0]) for p in piece) >= 2 * SHARD:
                        yield from out(d, parts.pop((s, d)))
            for (_, d), pieces in parts.items():
                yield from out(d, pieces)

        found = found.unionByName(materialize(table.select(F.col("ident").cast("long"), "shard", "dims", "v").repartitionByRange(shards, "shard").mapInArrow(run, schema)))
        sent.unpersist()
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # an id may have rows in several shards
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
