"""Reads back from the index's symbols alone: all reads walk together, or, where reads are long, by pointer doubling over the LF mapping.

A row's next row, one letter further in its read, holds the symbol that the row begins with: the k-th row that begins with c leads to the
k-th c among the symbols. Rows that begin with one letter lead to rows in the same order, so what leaves a block of rows goes to few
blocks, as compressed columns. A step stores the rows that it meets, and these are the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions.dna import ALPHABET
from readloom.operators import bins, packed
from readloom.operators.index import lf_mapping
from readloom.plans.ranking import ranked
from readloom.plans.store import stored

#: Doublings: reads of up to 2^40 letters.
DOUBLINGS = 40
#: Steps of a walk at most; reads of more symbols are doubled.
STEPS = 128
#: log2 of the rows of a block.
BLOCK_BITS = 19


def _walked(symbols: DataFrame | packed.Sorted, ranks: bool) -> tuple[DataFrame, np.ndarray] | None:
    """(step, head, row, sym) as compressed columns, a line a block and step, and the first rows of symbols; None if reads are long.

    From the rows of whole reads on, all go one letter further in each step, up to their ``$``. head: the row of the whole read, or with
    ``ranks`` its number among these; sym is stored with ``ranks`` only. An error is raised if not all rows are met.
    """
    t, bits, kinds = packed._T, BLOCK_BITS, len(ALPHABET)
    letters = np.frombuffer(ALPHABET.encode(), np.uint8)

    def block(group: pa.Table) -> pa.Table:
        text = "".join(group.sort_by("at").column("syms").to_pylist())
        c = np.searchsorted(letters, np.frombuffer(text.encode(), np.uint8))
        return pa.table({"block": pa.array([group.column("bin_id")[0].as_py()], pa.int32()), "counts": pa.array([np.bincount(c, minlength=kinds).tolist()], pa.list_(pa.int64())), "syms": pa.array([t["put"](c)], pa.binary())})

    held = stored(bins.pieces(symbols, bits).groupBy("bin_id").applyInArrow(block, "block int, counts array<bigint>, syms binary"))
    counts = np.array([r["counts"] for r in held.select("block", "counts").orderBy("block").collect()], np.int64).reshape(-1, kinds)  # a row a block
    total = counts.sum(0)
    if total.sum() > STEPS * total[0]:
        return None
    start, upto = np.cumsum(total) - total, np.cumsum(counts, 0) - counts
    parts = max(1, min(len(counts), 4 * held.sparkSession.sparkContext.defaultParallelism))
    # the blocks stay where the walk comes to them in each step
    held = held.select("block", "syms").repartition(parts, "block").persist()
    form = "step int, n long, open long, head binary, row binary, sym binary"

    def line(step: int, head: np.ndarray, row: np.ndarray, sym: np.ndarray) -> dict:
        return {"step": pa.array([step], pa.int32()), "n": pa.array([len(row)]), "open": pa.array([int((row >= total[0]).sum())]), "head": [t["put"](head)], "row": [t["put"](np.diff(row, prepend=0))], "sym": pa.array([t["put"](sym) if ranks else None], pa.binary())}

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, syms in zip(batch.column("block").to_pylist(), batch.column("syms").to_pylist()):
                at = np.nonzero(t["got"](syms) == 0)[0]
                row = (g << bits) + at
                if len(at):
                    yield pa.RecordBatch.from_pydict(line(0, upto[g, 0] + np.arange(len(at)) if ranks else row, row, np.zeros(len(at), np.int64)))

    def ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for heads, rows in zip(batch.column("head").to_pylist(), batch.column("row").to_pylist()):
                head, row = t["got"](heads), np.cumsum(t["got"](rows))
                cut = np.searchsorted(row, start)
                for c in range(1, kinds):  # rows that begin with $ are ends of reads
                    own, k = head[cut[c] : cut[c + 1] if c + 1 < kinds else len(row)], row[cut[c] : cut[c + 1] if c + 1 < kinds else len(row)] - start[c]
                    if not len(k):
                        continue
                    g = np.searchsorted(upto[:, c], k, "right") - 1
                    k = k - upto[g, c]
                    at = np.nonzero(np.diff(g, prepend=-1))[0].tolist()
                    out += [(int(g[a]), c, t["put"](own[a:b]), t["put"](np.diff(k[a:b], prepend=0))) for a, b in zip(at, [*at[1:], len(k)])]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate([pa.int32(), pa.int32(), pa.binary(), pa.binary()])], ["block", "sym", "head", "at"])

    def met(step: int):
        def run(some: pa.Table, own: pa.Table) -> pa.Table:
            if not some.num_rows:
                return pa.table({"step": pa.array([], pa.int32()), "n": pa.array([], pa.int64()), "open": pa.array([], pa.int64()), **{c: pa.array([], pa.binary()) for c in ("head", "row", "sym")}})
            g, codes = own.column("block")[0].as_py(), t["got"](own.column("syms")[0].as_py())
            places = [np.nonzero(codes == c)[0] for c in range(kinds)]
            at = np.concatenate([places[c][np.cumsum(t["got"](x))] for c, x in zip(some.column("sym").to_pylist(), some.column("at").to_pylist())])
            head = np.concatenate([t["got"](x) for x in some.column("head").to_pylist()])
            order = np.argsort(at, kind="stable")
            at = at[order]
            return pa.table(line(step, head[order], (g << bits) + at, codes[at]))

        return run

    now = stored(held.mapInArrow(begin, form))
    steps, seen = [now], 0
    try:
        while True:
            n = now.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("open"), F.lit(0)).alias("open")).first()
            seen += n["n"]
            if not n["open"]:
                break
            if len(steps) > STEPS:
                return None
            d = now.select("head", "row").mapInArrow(ahead, "block int, sym int, head binary, at binary").repartition(parts, "block")
            now = stored(d.groupBy("block").cogroup(held.groupBy("block")).applyInArrow(met(len(steps)), form))
            steps.append(now)
    finally:
        held.unpersist()
    if seen != total.sum():
        raise RuntimeError("rows that belong to no read: the symbols are no index")
    return reduce(DataFrame.unionByName, steps), start


def _letter_rows(walked: DataFrame, start: np.ndarray | None, names: tuple[str, ...]) -> DataFrame:
    """Rows ``names`` (head, step, row, symbol, in this order) of a walk; the symbol is the row's, or with ``start`` the one that it begins with."""
    t = packed._T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step, head, row, sym in zip(*(batch.column(c).to_pylist() for c in ("step", "head", "row", "sym")), strict=True):
                row = np.cumsum(t["got"](row))
                c = t["got"](sym) if start is None else np.searchsorted(start, row, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(t["got"](head)), pa.array(np.full(len(row), step, np.int32)), pa.array(row), t["text_of"](c)], list(names))

    kinds = zip(names, ("long", "int", "long", "string"), strict=True)
    return walked.select("step", "head", "row", "sym").mapInArrow(run, ", ".join(f"{n} {k}" for n, k in kinds))


def _rows(symbols: DataFrame | packed.Sorted) -> DataFrame:
    return symbols.rows("sym") if isinstance(symbols, packed.Sorted) else symbols


def whole_reads(symbols: DataFrame | packed.Sorted) -> DataFrame:
    """(row, i, at_row, sym): :func:`rotations` of all rows that begin a whole read."""
    if (got := _walked(symbols, False)) is None:
        rows = _rows(symbols)
        return rotations(rows, rows.filter("sym = '$'").select("row"))
    return _letter_rows(*got, ("row", "i", "at_row", "sym"))


def positions(symbols: DataFrame) -> DataFrame:
    """(row, head, pos, sym) of symbols (row, sym): the row of the whole read that a row belongs to, and the row's place in it.

    A step of the LF mapping goes one symbol back. Pointers to the beginning of the read double their steps in each round, so
    the rounds grow with the logarithm of the longest read. An error is raised if DOUBLINGS do not reach it.
    """
    lf = stored(lf_mapping(symbols))
    begun = F.col("sym") == "$"
    d = stored(lf.select("row", "sym", F.when(begun, F.col("row")).otherwise(F.col("lf")).alias("head"), F.when(begun, 0).otherwise(1).cast("long").alias("pos"), begun.alias("there")))
    for _ in range(DOUBLINGS):
        open_ = d.filter(~F.col("there"))
        if not open_.limit(1).count():
            return d.select("row", "head", F.col("pos").cast("int").alias("pos"), "sym")
        on = d.select(F.col("row").alias("__r"), F.col("head").alias("__head"), F.col("pos").alias("__pos"), F.col("there").alias("__there"))
        moved = open_.join(on, F.col("head") == F.col("__r")).select("row", "sym", F.col("__head").alias("head"), (F.col("pos") + F.col("__pos")).alias("pos"), F.col("__there").alias("there"))
        d = stored(d.filter("there").unionByName(moved))
    raise RuntimeError("a read without an end: the symbols are no index")


def rows_of_symbols(symbols: DataFrame | packed.Sorted) -> DataFrame:
    """(row, read_rank, pos, sym): the rows of an index from its symbols (row, sym) alone, such as raw index text."""
    if (got := _walked(symbols, True)) is not None:
        return _letter_rows(got[0], None, ("read_rank", "pos", "row", "sym")).select("row", "read_rank", "pos", "sym")
    d = positions(_rows(symbols))
    heads = ranked(d.filter("sym = '$'").select("head"), [F.col("head").asc()], "read_rank")
    return d.join(heads, "head").select("row", "read_rank", "pos", "sym")


def rotations(symbols: DataFrame, rows: DataFrame) -> DataFrame:
    """(row, i, at_row, sym) for each row asked for: the symbols of the rotation that starts there, and the row of each."""
    d = stored(positions(symbols))
    size = d.groupBy("head").agg(F.count(F.lit(1)).alias("size"))
    # a row's first symbol is the one before the next row of its read
    first = d.select("head", F.col("pos").alias("__p"), F.col("sym").alias("first"))
    own = d.join(size, "head").withColumn("__p", F.pmod(F.col("pos") + 1, F.col("size"))).drop("sym").join(first, ["head", "__p"])
    asked = rows.select("row").distinct().join(d.select("row", "head", F.col("pos").alias("start")), "row")
    every = own.select("head", F.col("row").alias("at_row"), "pos", "size", F.col("first").alias("sym"))
    return asked.join(every, "head").select("row", F.pmod(F.col("pos") - F.col("start"), F.col("size")).cast("int").alias("i"), "at_row", "sym")
