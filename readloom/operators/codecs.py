"""Run-length and LZW forms of the index's symbol column, and its exchange as raw text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.dna import ALPHABET, code
from readloom.operators import bins
from readloom.plans.prefix import before
from readloom.plans.store import stored


#: Bins whose symbols a task looks at together.
TOGETHER = 256


def run_lengths(index: DataFrame, row: str = "row", sym: str = "sym") -> DataFrame:
    """(run_id, row_start, sym, run_len) of a column of symbols of one letter, numbered from 0.

    Rows are gathered into bins; each gets the symbols beside it, so it knows where runs begin and end in it. Both are numbered
    by the counts of the bins before: the begin and the end of one number are a run. Only runs over the edge of a bin,
    at most two a bin, meet in a join.
    """
    return _runs(bins.stretches(index, row, sym))


def _runs(held: DataFrame) -> DataFrame:
    """The runs of bins (bin_id, syms); bins are stored with their counts, runs are not."""
    bits, together = bins.BIN_BITS, TOGETHER
    held = stored(held)
    edge = lambda step, text, name: held.select((F.col("bin_id") + step).alias("bin_id"), text.alias(name))
    d = held.join(edge(1, F.right("syms", F.lit(1)), "prev"), "bin_id", "left").join(edge(-1, F.left("syms", F.lit(1)), "next"), "bin_id", "left")
    d = d.na.fill("", ["prev", "next"])

    def codes(texts: list[str]) -> np.ndarray:
        return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)

    def marks(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """The symbols of all bins, whether a run begins or ends there, and the first place of each bin."""
        texts, prev, after = (batch.column(c).to_pylist() for c in ("syms", "prev", "next"))
        c, size = codes(texts), np.array([len(x) for x in texts], np.int64)
        last = np.cumsum(size) - 1
        first = last - size + 1
        changed = c[1:] != c[:-1]
        begin, end = np.append(True, changed), np.append(changed, True)
        # chr(0) stands where no bin is
        begin[first] = c[first] != codes([x or chr(0) for x in prev])
        end[last] = c[last] != codes([x or chr(0) for x in after])
        return c, begin, end, first

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, together):
                yield batch.slice(i, together)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            _, begin, end, first = marks(batch)
            n = [pa.array(np.add.reduceat(x.astype(np.int64), first)) for x in (begin, end)]
            yield pa.RecordBatch.from_arrays([batch.column("bin_id"), *n, *[batch.column(c) for c in ("prev", "syms", "next")]], ["bin_id", "begins", "ends", "prev", "syms", "next"])

    d = stored(d.select("bin_id", "prev", "syms", "next").mapInArrow(counted, "bin_id long, begins long, ends long, prev string, syms string, next string"))
    d = stored(before(d, "bin_id", ["begins", "ends"]).select("bin_id", "begins", "ends", "prev", "syms", "next"))

    def run(inside: bool):
        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in parts(batches):
                c, begin, end, first = marks(batch)
                row0 = (batch.column("bin_id").to_numpy() << bits) - first
                b, e = (batch.column(x).to_numpy() for x in ("begins", "ends"))
                at, ids, of = [], [], []
                for mark, base in ((begin, b), (end, e)):
                    n = np.add.reduceat(mark.astype(np.int64), first)
                    of.append(np.repeat(np.arange(len(n)), n))
                    at.append(np.nonzero(mark)[0])
                    ids.append(np.arange(len(at[-1])) + np.repeat(base - np.cumsum(n) + n, n))
                ends = e + np.bincount(of[1], minlength=len(e))
                # a run that begins in a bin ends in it, but for the last; the first that ends in it may have begun before
                whole = [ids[0] < ends[of[0]], ids[1] >= b[of[1]]]
                rows = [x + row0[o] for x, o in zip(at, of, strict=True)]
                text = lambda x: pa.array(list(c[x].tobytes().decode("utf-32-le")), pa.string())
                if inside:
                    low, high = (r[w] for r, w in zip(rows, whole, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[0][whole[0]]), pa.array(low), text(at[0][whole[0]]), pa.array(high - low + 1)], ["run_id", "row_start", "sym", "run_len"])
                else:
                    for k in (0, 1):
                        over = ~whole[k]
                        mine, none = pa.array(rows[k][over]), pa.nulls(int(over.sum()), pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array(ids[k][over]), none if k else mine, mine if k else none, text(at[k][over])], ["run_id", "row_start", "__end", "sym"])

        return found

    d = d.select("bin_id", "begins", "ends", "prev", "syms", "next")
    whole = d.mapInArrow(run(True), "run_id long, row_start long, sym string, run_len long")
    over = d.mapInArrow(run(False), "run_id long, row_start long, __end long, sym string").groupBy("run_id").agg(F.max("row_start").alias("row_start"), F.max("__end").alias("__end"), F.max("sym").alias("sym"))
    return whole.unionByName(over.select("run_id", "row_start", "sym", (F.col("__end") - F.col("row_start") + 1).alias("run_len")))


def run_bytes(sym: Column, run_len: Column) -> Column:
    """The bytes of a run: symbol code in the low 3 bits, base-32 digits of the length above, least significant first."""
    places = F.sequence(F.lit(0), F.lit(12))
    used = F.filter(places, lambda i: (i == 0) | (F.call_function("shiftright", run_len.cast("long"), (i * 5).cast("int")) > 0))
    return F.transform(used, lambda i: (F.call_function("shiftright", run_len.cast("long"), (i * 5).cast("int")).bitwiseAND(F.lit(31)) * 8 + code(sym)).cast("int"))


def encode(runs: DataFrame) -> DataFrame:
    """(run_id, part, byte): the compressed form, a row a byte."""
    return runs.select("run_id", F.posexplode(run_bytes(F.col("sym"), F.col("run_len"))).alias("part", "byte"))


def decode_bytes(data: DataFrame) -> DataFrame:
    """Runs from (byte_pos, byte): successive bytes of one symbol are one run."""
    d = data.select("byte_pos", F.col("byte").bitwiseAND(F.lit(7)).alias("c"), F.shiftright("byte", 3).cast("long").alias("digit"))
    marks = run_lengths(d.select(F.col("byte_pos").alias("row"), F.col("c").cast("string").alias("sym")))
    spread = marks.select("run_id", "row_start", F.explode(F.sequence(F.col("row_start"), F.col("row_start") + F.col("run_len") - 1)).alias("byte_pos"))
    sizes = spread.join(d, "byte_pos").groupBy("run_id").agg(F.first("c").alias("c"), F.sum(F.call_function("shiftleft", F.col("digit"), (5 * (F.col("byte_pos") - F.col("row_start"))).cast("int"))).alias("run_len"))
    return sizes.select("run_id", F.substr(F.lit(ALPHABET), F.col("c") + 1, F.lit(1)).alias("sym"), "run_len")


def decode(runs: DataFrame) -> DataFrame:
    """(row, sym) of runs (row_start, sym, run_len)."""
    return runs.select(F.explode(F.sequence(F.col("row_start"), F.col("row_start") + F.col("run_len") - 1)).alias("row"), "sym")


def compressed_size(runs: DataFrame) -> DataFrame:
    """(bytes): size of the compressed form."""
    more = [(F.col("run_len") >= 1 << (5 * i)).cast("long") for i in range(1, 13)]
    return runs.agg(F.coalesce(F.sum(sum(more, F.lit(1))), F.lit(0)).cast("long").alias("bytes"))


def _placed(lines: DataFrame) -> DataFrame:
    """(at, value) of raw index text (line_no, value): lines with the row of their first symbol; others than $ACGNT are rejected.

    Lines are sorted in ranges, which count their own symbols; a range begins behind those before. One number a partition goes through the driver.
    """
    good = F.rlike("value", F.lit(r"^[$ACGNT]*$"))
    v = F.when(F.assert_true(good, F.lit("symbol outside $ACGNT")).isNull(), F.col("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = 0
        for batch in batches:
            size = np.array([len(x) for x in batch.column("value").to_pylist()], np.int64)
            end = low + np.cumsum(size)
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(end - size), pa.array(end), batch.column("value")], ["part", "low", "end", "value"])
            low = int(end[-1]) if len(end) else low

    d = lines.select("line_no", v.alias("value")).repartitionByRange("line_no").sortWithinPartitions("line_no")
    d = stored(d.select(F.spark_partition_id().alias("part"), "value").mapInArrow(run, "part int, low long, end long, value string"))
    sizes = d.groupBy("part").agg(F.max("end").alias("n")).orderBy("part").collect()  # a row a partition of the sort
    starts = np.cumsum([0, *[r["n"] for r in sizes]]).tolist()
    known = lines.sparkSession.createDataFrame([(r["part"], a) for r, a in zip(sizes, starts, strict=False)], "part int, first long")
    return d.join(F.broadcast(known), "part").select((F.col("first") + F.col("low")).alias("at"), "value").filter("value <> ''")


def convert_text(lines: DataFrame) -> DataFrame:
    """(row, sym) of raw index text (line_no, value); line ends are dropped, other symbols rejected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, value in zip(*(batch.column(c).to_pylist() for c in ("at", "value")), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(at + np.arange(len(value))), pa.array(list(value), pa.string())], ["row", "sym"])

    return _placed(lines).mapInArrow(run, "row long, sym string")


def text_runs(lines: DataFrame) -> DataFrame:
    """``run_lengths`` of raw index text (line_no, value): lines are cut where bins end and never become rows."""
    bits = bins.BIN_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at, value in zip(*(batch.column(c).to_pylist() for c in ("at", "value")), strict=True):
                cuts = [at, *range(((at >> bits) + 1) << bits, at + len(value), 1 << bits), at + len(value)]
                out += [(a >> bits, a, value[a - at : b - at]) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string()))], ["bin_id", "at", "syms"])

    return _runs(bins.gathered(_placed(lines).mapInArrow(run, "bin_id long, at long, syms string")))


def lzw_decode(data: bytes, size: int, symbols: int = 6) -> np.ndarray:
    """Symbol codes of one LZW bin: codes are packed from the low bit up and widen as the dictionary grows."""
    width, at, bits, held = max(1, (symbols - 1).bit_length()), 0, 0, 0
    words: list[bytes] = [bytes([i]) for i in range(symbols)]
    out, last = bytearray(), b""
    while len(out) < size:
        while bits < width:
            held |= data[at] << bits
            at, bits = at + 1, bits + 8
        k, held, bits = held & ((1 << width) - 1), held >> width, bits - width
        word = words[k] if k < len(words) else last + last[:1]
        if last:
            words.append(last + word[:1])
        out += word
        last = word
        if len(words) >> width:
            width += 1
    return np.frombuffer(bytes(out[:size]), np.uint8)


def lzw_rows(parts: DataFrame, bin_rows: int) -> DataFrame:
    """(row, sym) of an LZW form: (bin_id, data, size), one stream of codes for each bin of ``bin_rows`` rows. Bins are decoded apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = np.array(list(ALPHABET))
        for batch in batches:
            for k, data, size in zip(*(batch.column(c).to_pylist() for c in ("bin_id", "data", "size")), strict=True):
                codes = lzw_decode(data, size)
                yield pa.RecordBatch.from_arrays([pa.array(k * bin_rows + np.arange(size)), pa.array(letters[codes])], ["row", "sym"])

    return parts.select("bin_id", "data", "size").mapInArrow(run, "row long, sym string")
