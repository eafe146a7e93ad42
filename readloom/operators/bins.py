"""Search on bins of the index, by symbols or by runs, without suffixes.

A bin stands for 2^BIN_BITS rows: for each symbol its base (C + occurrences before the bin), and the bin's symbols, as one
string or as runs. What a row leads to, and how many rows are smaller than a pattern, follows from one bin a step. All
patterns step together, from their last symbol to the first: a step joins the ends of their ranges to the bins that hold
them. A few patterns read only those bins (a filter that prunes stored bins); many are shuffled to them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.dna import ALPHABET, SYMBOLS, checked, code
from readloom.operators.index import BIN_BITS
from readloom.operators.packed import Sorted
from readloom.plans.prefix import before, neighbours
from readloom.plans.ranking import ranked
from readloom.plans.store import stored

SIZE = 1 << BIN_BITS
#: Rows of a piece into which a very long run is cut first.
PIECE_BITS = 30
#: Ends of ranges that step over the driver, a filter of their bins at a time; more are joined to the bins.
FEW = 256
_COUNTS = [f"n{i}" for i in range(len(SYMBOLS))]


def _based(parts: DataFrame) -> DataFrame:
    """(bin_id, bases, the rest of ``parts``) of bins (bin_id, n0 to n5: occurrences, ...), and an empty bin behind the last."""
    parts = stored(parts)
    spark = parts.sparkSession
    total = parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _COUNTS], F.coalesce(F.max("bin_id") + 1, F.lit(0)).alias("bins")).first()
    c = [sum(total[x] for x in _COUNTS[:i]) for i in range(len(_COUNTS))]
    sums = before(parts, "bin_id", _COUNTS)
    rest = [x for x in parts.columns if x not in ("bin_id", *_COUNTS)]
    d = sums.select("bin_id", F.array(*[F.col(x) + F.lit(c[i]) for i, x in enumerate(_COUNTS)]).alias("bases"), *rest)
    kinds = {x: parts.schema[x].dataType for x in rest}
    none = {x: F.lit("").cast(k) if k.typeName() == "string" else F.array().cast(k) for x, k in kinds.items()}
    behind = spark.range(1).select(F.lit(total["bins"]).cast("long").alias("bin_id"), F.array(*[F.lit(c[i] + total[x]).cast("long") for i, x in enumerate(_COUNTS)]).alias("bases"), *[v.alias(x) for x, v in none.items()])
    d = d.unionByName(behind)
    return stored(d.repartitionByRange("bin_id").sortWithinPartitions("bin_id"))


def stretches(rows: DataFrame | Sorted, row: str = "row", sym: str = "sym") -> DataFrame:
    """(bin_id, syms) of rows (row, sym) in any order, each once: a bin's symbols in one string, one letter a row.

    Stored rows come in order: what follows one another in a batch is one stretch, so whole stretches are shuffled, not rows.
    Sorted rows are cut from their chunks and never become rows.
    """
    return gathered(pieces(rows, BIN_BITS, row, sym))


def gathered(d: DataFrame) -> DataFrame:
    """(bin_id, syms) of pieces (bin_id, at, syms)."""
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "syms"))), lambda x: x["syms"]), "")  # at most SIZE rows
    return d.groupBy("bin_id").agg(line.alias("syms"))


def pieces(rows: DataFrame | Sorted, bits: int, row: str = "row", sym: str = "sym") -> DataFrame:
    """(bin_id, at, syms): the stretches that bins of 2^bits rows are put together from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.column(0).to_numpy()
            text = "".join(batch.column(1).to_pylist())
            if len(text) != len(at):
                raise ValueError("a symbol is one letter")
            cut = np.nonzero((np.diff(at) != 1) | (np.diff(at >> bits) != 0))[0] + 1
            first = np.concatenate([[0], cut])
            parts = [text[a:b] for a, b in zip(first.tolist(), [*cut.tolist(), len(text)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(at[first] >> bits), pa.array(at[first]), pa.array(parts, pa.string())], ["bin_id", "at", "syms"])

    if isinstance(rows, Sorted):
        return rows.stretches(bits)
    return rows.select(F.col(row).cast("long").alias("row"), F.col(sym).alias("sym")).mapInArrow(run, "bin_id long, at long, syms string")


def text_bins(rows: DataFrame | Sorted) -> DataFrame:
    """(bin_id, bases, syms) of rows (row, sym): a bin's symbols in one string."""
    count = lambda s: (F.length("syms") - F.length(F.replace("syms", F.lit(s), F.lit("")))).cast("long")
    return _based(stretches(rows).select("bin_id", "syms", *[count(s).alias(c) for s, c in zip(SYMBOLS, _COUNTS, strict=True)]))


def _in_tasks() -> tuple[Callable, Callable]:
    """Inner functions go to workers by value, so that these need not import this package."""

    def codes(syms: str) -> np.ndarray:
        """0 to 5 of each symbol."""
        return np.searchsorted(np.frombuffer(ALPHABET.encode(), np.uint8), np.frombuffer(syms.encode(), np.uint8))

    def letters(seen: np.ndarray, at: np.ndarray) -> list[str | None]:
        """The symbols of rows ``at`` of a bin; null where the bin ends."""
        last = len(seen) - 1
        one = seen[np.minimum(at + 1, last)] - seen[at]
        return [ALPHABET[c] if a < last else None for a, c in zip(at.tolist(), one.argmax(1).tolist(), strict=True)]

    return codes, letters


_codes, _letters = _in_tasks()


def _expanded(bins: DataFrame, numbers: Callable[[np.ndarray, np.ndarray], list[np.ndarray]], names: list[str]) -> DataFrame:
    """(row, sym, names) of all rows of text bins: ``numbers`` gives the columns of a bin by its bases and codes."""
    bits = BIN_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, base, syms in zip(*(batch.column(c).to_pylist() for c in ("bin_id", "bases", "syms")), strict=True):
                if syms:
                    columns = numbers(np.array(base, np.int64), _codes(syms))
                    yield pa.RecordBatch.from_arrays([pa.array((k << bits) + np.arange(len(syms))), pa.array(list(syms)), *map(pa.array, columns)], ["row", "sym", *names])

    return bins.select("bin_id", "bases", "syms").mapInArrow(run, "row long, sym string, " + ", ".join(f"{n} long" for n in names))


def every_lf(bins: DataFrame) -> DataFrame:
    """(row, sym, lf) of all rows of text bins."""

    def numbers(base: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
        order = np.argsort(c, kind="stable")
        sizes = np.bincount(c, minlength=len(base))
        out = np.empty(len(c), np.int64)
        out[order] = np.repeat(base - np.cumsum(sizes) + sizes, sizes) + np.arange(len(c))
        return [out]

    return _expanded(bins, numbers, ["lf"])


def every_fm(bins: DataFrame) -> DataFrame:
    """(row, fm_end, fm_a, ..., fm_t) of all rows of text bins."""

    def numbers(base: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
        return [base[i] + np.cumsum(c == i) - (c == i) for i in range(len(base))]

    names = ["fm_end" if s == "$" else f"fm_{s.lower()}" for s in SYMBOLS]
    return _expanded(bins, numbers, names).drop("sym")


def _pieces(runs: DataFrame, bits: int) -> DataFrame:
    """``runs`` (row_start, run_len, ...) cut where blocks of 2^bits rows end."""
    end = F.col("row_start") + F.col("run_len")
    d = runs.withColumn("__k", F.explode(F.sequence(F.shiftright("row_start", bits), F.shiftright(end - 1, bits))))
    low = F.greatest("row_start", F.col("__k") * (1 << bits))
    return d.withColumn("run_len", F.least(end, (F.col("__k") + 1) * (1 << bits)) - low).withColumn("row_start", low).drop("__k")


def run_bins(runs: DataFrame) -> DataFrame:
    """(bin_id, bases, runs) of runs (row_start, sym, run_len): the parts (at, sym, n) of runs in the bin, from row ``at`` of it on."""
    d = _pieces(_pieces(runs.select("row_start", "sym", "run_len"), PIECE_BITS), BIN_BITS)
    d = d.withColumn("bin_id", F.shiftright("row_start", BIN_BITS)).groupBy("bin_id")
    part = F.struct(F.col("row_start").bitwiseAND(SIZE - 1).cast("int").alias("at"), "sym", F.col("run_len").cast("int").alias("n"))
    held = F.array_sort(F.collect_list(part))  # at most SIZE runs
    d = d.agg(held.alias("runs"), *[F.coalesce(F.sum(F.when(F.col("sym") == s, F.col("run_len"))), F.lit(0)).alias(c) for s, c in zip(SYMBOLS, _COUNTS, strict=True)])
    return _based(d)


def runs_of(bins: DataFrame) -> DataFrame:
    """The run bins of text bins, bin by bin."""
    kind = pa.list_(pa.struct([("at", pa.int32()), ("sym", pa.string()), ("n", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [np.array(list(x)) for x in batch.column("syms").to_pylist()]
            first = [np.nonzero(np.append(True, c[1:] != c[:-1]))[0] if len(c) else np.zeros(0, np.int64) for c in every]
            parts = pa.StructArray.from_arrays(
                [
                    pa.array(np.concatenate([*first, np.zeros(0)]).astype(np.int32)),
                    pa.array([x for c, a in zip(every, first, strict=True) for x in c[a].tolist()], pa.string()),
                    pa.array(np.concatenate([*[np.diff(np.append(a, len(c))) for c, a in zip(every, first, strict=True) if len(c)], np.zeros(0)]).astype(np.int32)),
                ],
                fields=list(kind.value_type),
            )
            ends = np.concatenate([[0], np.cumsum([len(a) for a in first])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("bin_id"), batch.column("bases"), pa.ListArray.from_arrays(pa.array(ends), parts)], ["bin_id", "bases", "runs"])

    return stored(bins.select("bin_id", "bases", "syms").mapInArrow(run, "bin_id long, bases array<bigint>, runs array<struct<at:int,sym:string,n:int>>"))


#: Groups of the points of one bin at most; each group meets its bin once.
GROUPS = 64
#: Bins whose counts a task holds for other groups of points: 100 kB each.
HELD = 256


def _answered(bins: DataFrame, points: DataFrame, numbers: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], list], names: list[str], kinds: str) -> DataFrame:
    """``points`` (row, sym if they have it, ...) and ``names``: what ``numbers`` gives by bases, the occurrences before each row
    of the bin (a line a row, and one behind the last), the rows' places in the bin and the codes asked for.

    The points of a bin are gathered, so that a bin is copied to at most GROUPS of them and not to each.
    """
    kept, coded = points.columns, "sym" in points.columns
    asked = F.struct(F.col("row").bitwiseAND(SIZE - 1).cast("int").alias("at"), (code(F.col("sym")) if coded else F.lit(0)).alias("code"), F.struct(*kept).alias("own"))
    d = points.select(_held(points, "row").alias("bin_id"), F.pmod(F.hash(*kept), F.lit(GROUPS)).alias("__g"), asked.alias("asked"))
    d = d.groupBy("bin_id", "__g").agg(F.collect_list("asked").alias("asked")).join(bins, "bin_id")
    form = "runs" if "runs" in bins.columns else "syms"

    held_most = HELD

    def letters(x: pa.Array, i: int) -> np.ndarray:
        if form == "syms":
            return _codes(x[i].as_py())
        r = x.slice(i, 1).flatten()
        return np.repeat(_codes("".join(r.field("sym").to_pylist())), r.field("n").to_numpy(zero_copy_only=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, (k, base) in enumerate(zip(batch.column("bin_id").to_pylist(), batch.column("bases").to_pylist(), strict=True)):
                if k not in known:
                    if len(known) == held_most:
                        known.pop(next(iter(known)))
                    c = letters(batch.column(form), i)
                    known[k] = np.zeros((len(c) + 1, len(base)), np.int64)
                    known[k][np.arange(1, len(c) + 1), c] = 1
                    np.cumsum(known[k], axis=0, out=known[k])
                seen = known[k]
                last = len(seen) - 1
                own = batch.column("asked").slice(i, 1).flatten()
                at, sym = (own.field(x).to_numpy(zero_copy_only=False) for x in ("at", "code"))
                got = numbers(np.array(base, np.int64), seen, np.minimum(at, last), sym)
                own = own.field("own")
                yield pa.RecordBatch.from_arrays([*[own.field(x) for x in kept], *[pa.array(x, pa.string() if isinstance(x, list) else pa.int64()) for x in got]], [*kept, *names])

    have = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
    return d.select("bin_id", "bases", form, "asked").mapInArrow(run, f"{have}, {kinds}")


def _inside(bins: DataFrame, at: Column, sym: Column) -> Column:
    """Occurrences of ``sym`` in the first ``at`` rows of a bin."""
    if "runs" not in bins.columns:
        head = F.substr("syms", F.lit(1), at)
        return F.length(head) - F.length(F.replace(head, sym, F.lit("")))
    part = lambda r: F.when(r["sym"] == sym, F.greatest(F.least(r["n"], at - r["at"]), F.lit(0))).otherwise(0)
    return F.aggregate("runs", F.lit(0), lambda n, r: n + part(r))


def _held(d: DataFrame, at: str) -> Column:
    return F.shiftright(at, BIN_BITS)


def occurrences(bins: DataFrame, points: DataFrame) -> DataFrame:
    """``points`` (sym, row, ...) with occ = C[sym] + occurrences of sym above row; row may be the number of rows."""
    return _answered(bins, points, lambda base, seen, at, sym: [base[sym] + seen[at, sym]], ["occ"], "occ long")


def symbols_at(bins: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (row, ...) with their sym; rows that are not there go."""
    d = _answered(bins, rows, lambda _, seen, at, __: [_letters(seen, at)], ["sym"], "sym string")
    return d.filter("sym is not null")


def symbols_between(bins: DataFrame, low: int, high: int) -> DataFrame:
    """(row, sym) of rows low to high - 1: only the bins that hold them are read."""
    d = bins.filter(F.col("bin_id").between(low >> BIN_BITS, (high - 1) >> BIN_BITS)).withColumn("base", F.col("bin_id") * SIZE)
    if "runs" not in bins.columns:
        d = d.select("base", F.posexplode(F.split("syms", "")).alias("at", "sym")).filter("sym <> ''")
    else:
        d = d.select("base", F.explode("runs").alias("r")).select("base", F.explode(F.sequence("r.at", F.col("r.at") + F.col("r.n") - 1)).alias("at"), "r.sym")
    return d.select((F.col("base") + F.col("at")).alias("row"), "sym").filter((F.col("row") >= low) & (F.col("row") < high))


def lf(bins: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (row, ...) with sym and lf, the row of the rotation that starts one symbol earlier: one bin a row."""

    def numbers(base: np.ndarray, seen: np.ndarray, at: np.ndarray, _: np.ndarray) -> list:
        sym = _letters(seen, at)
        c = np.array([0 if x is None else ALPHABET.index(x) for x in sym], np.int64)
        return [sym, base[c] + seen[at, c]]

    return _answered(bins, rows, numbers, ["sym", "lf"], "sym string, lf long").filter("sym is not null")


def fm_at(bins: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (row, ...) with fm_end, fm_a, ..., fm_t: C + occurrences above the row of every symbol."""
    names = ["fm_end" if s == "$" else f"fm_{s.lower()}" for s in SYMBOLS]
    return _answered(bins, rows, lambda base, seen, at, _: list((base + seen[at]).T), names, ", ".join(f"{n} long" for n in names))


def _step(bins: DataFrame, points: DataFrame) -> DataFrame:
    """Points (pattern, side, at, left) one symbol on: the last of ``left``, what is left of the pattern. Points at their end stay."""
    d = points.withColumn("bin_id", _held(points, "at")).join(bins, "bin_id")
    sym = F.substr("left", F.length("left"), F.lit(1))
    moved = F.get("bases", code(sym)) + _inside(bins, F.col("at").bitwiseAND(SIZE - 1).cast("int"), sym)
    at = F.when(F.col("left") == "", F.col("at")).otherwise(moved)
    return d.select("pattern", "side", at.cast("long").alias("at"), F.substr("left", F.lit(1), F.greatest(F.length("left") - 1, F.lit(0))).alias("left"))


def _met(points: DataFrame) -> DataFrame:
    """(pattern, left, l, h) of points."""
    return points.groupBy("pattern", "left").agg(F.max(F.when(F.col("side") == 0, F.col("at"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("at"))).alias("h"))


#: Steps of one stored table.
STRIDE = 8


def _few(bins: DataFrame, state: list, least: int) -> list:
    """The points (pattern, side, at, left) when nothing is left, or ranges hold fewer than ``least`` rows; a step reads their bins only."""
    spark = bins.sparkSession
    while True:
        at = {(r["pattern"], r["side"]): r["at"] for r in state}
        live = [r for r in state if r["left"] and (not least or at[r["pattern"], 1] - at[r["pattern"], 0] >= least)]
        if not live:
            return state
        asked = bins.filter(F.col("bin_id").isin(sorted({r["at"] >> BIN_BITS for r in live})))
        moved = _step(asked, F.broadcast(spark.createDataFrame(live, KIND))).collect()  # at most FEW rows
        keys = {(r["pattern"], r["side"]) for r in moved}
        state = [r for r in state if (r["pattern"], r["side"]) not in keys] + moved


def _many(bins: DataFrame, points: DataFrame, least: int) -> DataFrame:
    """(pattern, left, l, h) of the same, with the points shuffled to the bins."""
    done: list[DataFrame] = []
    points = stored(points)
    while points.filter("left <> ''").limit(1).count():
        if least:
            r = stored(_met(points))
            on = (F.col("left") != "") & (F.col("h") - F.col("l") >= least)
            done.append(r.filter(~on))
            points = r.filter(on).select("pattern", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("l").alias("at")), F.struct(F.lit(1).alias("side"), F.col("h").alias("at")))).alias("x"), "left").select("pattern", "x.side", "x.at", "left")
            points = stored(_step(bins, points))
        else:
            done.append(_met(points.filter("left = ''")))
            points = points.filter("left <> ''")
            for _ in range(STRIDE):
                points = _step(bins, points)
            points = stored(points)
    return reduce(DataFrame.unionByName, [*done, _met(points)])


KIND = "pattern string, side int, at long, left string"


def _advance(bins: DataFrame, points: DataFrame, least: int) -> DataFrame:
    state = points.limit(FEW + 1).collect()
    return _met(bins.sparkSession.createDataFrame(_few(bins, state, least), KIND)) if len(state) <= FEW else _many(bins, points, least)


def places(bins: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, l): how many rows are smaller than each distinct pattern. One end a pattern is searched, whether it occurs or not."""
    p = patterns.select("pattern").distinct()
    points = p.select("pattern", F.lit(0).alias("side"), F.lit(0).cast("long").alias("at"), F.col("pattern").alias("left"))
    return _advance(bins, points, 0).select("pattern", "l")


def rows_of(bins: DataFrame) -> int:
    """The number of rows: the last base of the bin behind the last."""
    return bins.orderBy(F.desc("bin_id")).select(F.element_at("bases", -1)).first()[0]


def extended(bins: DataFrame, ranges: DataFrame) -> DataFrame:
    """``ranges`` (l, h, ...) with lows and highs: the range of the rows that lead to them by A, C, G, N and T."""
    rest = F.col("at").bitwiseAND(SIZE - 1).cast("int")
    five = F.array(*[(F.get("bases", F.lit(i)) + _inside(bins, rest, F.lit(s))).cast("long") for i, s in enumerate(SYMBOLS) if s != "$"])
    # stored, so that it is known how few ends there are: then they go to the bins, not bins to them
    ends = stored(ranges.select(F.explode(F.array("l", "h")).alias("at")).distinct())
    ends = stored(ends.withColumn("bin_id", _held(ends, "at")).join(bins, "bin_id").select("at", five.alias("five")))
    for at, name in (("l", "lows"), ("h", "highs")):
        ranges = ranges.join(ends.select(F.col("at").alias(at), F.col("five").alias(name)), at)
    return ranges


def find(bins: DataFrame, patterns: DataFrame, least: int = 0) -> DataFrame:
    """(pattern, l, h, matched) of all distinct patterns, over the cyclic rotations: l rows are smaller, h - l start with it.

    ``patterns`` (pattern) may have given_l and given_h, the range of what follows a pattern, from which its search starts; they
    are then columns of the result, which has a row for each distinct (pattern, given_l, given_h). Patterns may hold ``$``.
    With ``least``, a range of fewer rows is not searched further: l and h are then those of its ``matched`` last symbols.
    Without, absent patterns have l = h, their place. An empty index has (0, 0).
    """
    given = {"given_l", "given_h"} <= set(patterns.columns)
    p = patterns.select("pattern", *(["given_l", "given_h"] if given else [])).distinct()
    p = p.withColumn("pattern", checked(F.col("pattern"), "pattern"))
    rows = rows_of(bins)
    low, high = (F.col("given_l"), F.col("given_h")) if given else (F.lit(0), F.lit(rows))
    key = F.concat_ws("|", "pattern", "given_l", "given_h") if given else F.col("pattern")
    ends = F.array(F.struct(F.lit(0).alias("side"), low.cast("long").alias("at")), F.struct(F.lit(1).alias("side"), high.cast("long").alias("at")))
    points = p.select(key.alias("pattern"), F.explode(ends).alias("x"), F.col("pattern").alias("left")).select("pattern", "x.side", "x.at", "left")
    d = _advance(bins, points, least)
    if given:
        k = F.split("pattern", r"\|")
        d = d.select(k[0].alias("pattern"), k[1].cast("long").alias("given_l"), k[2].cast("long").alias("given_h"), "left", "l", "h")
    return d.select("pattern", *(["given_l", "given_h"] if given else []), "l", "h", (F.length("pattern") - F.length("left")).cast("int").alias("matched"))


def without_rows(runs: DataFrame, rows: DataFrame) -> DataFrame:
    """``runs`` (run_id, row_start, sym, run_len) without the ``rows`` given; runs that come to lie beside one of their symbol are one.

    Rows meet the pieces of runs in their bin; nothing is expanded into rows.
    """
    pieces = _pieces(_pieces(runs.select("run_id", "row_start", "run_len"), PIECE_BITS), BIN_BITS).withColumn("b", F.shiftright("row_start", BIN_BITS))
    gone = rows.select("row").distinct().withColumn("b", F.shiftright("row", BIN_BITS))
    hit = gone.join(pieces, "b").filter((F.col("row") >= F.col("row_start")) & (F.col("row") < F.col("row_start") + F.col("run_len")))
    less = hit.groupBy("run_id").agg(F.count(F.lit(1)).alias("__less"))
    left = runs.join(less, "run_id", "left").withColumn("run_len", F.col("run_len") - F.coalesce("__less", F.lit(0))).filter("run_len > 0")
    return joined_runs(left.select(F.col("run_id").alias("__old"), "sym", "run_len"), "__old")


def joined_runs(runs: DataFrame, order: str) -> DataFrame:
    """(run_id, row_start, sym, run_len) of runs (sym, run_len) in the order of a column; neighbours of one symbol are one run."""
    d = stored(neighbours(ranked(runs, [F.col(order).asc()], "__i").select("__i", "sym", "run_len"), "__i", ["sym"]))
    total = d.agg(F.coalesce(F.sum("run_len"), F.lit(0)).alias("__n"))
    begin = before(d.select("__i", "sym", "__first", F.col("run_len").alias("row_start")), "__i", ["row_start"]).filter("__first")
    begin = ranked(begin.select("row_start", "sym"), [F.col("row_start").asc()], "run_id")
    after = begin.select((F.col("run_id") - 1).alias("run_id"), F.col("row_start").alias("__next"))
    out = begin.join(after, "run_id", "left").crossJoin(F.broadcast(total))  # one row
    return out.select("run_id", "row_start", "sym", (F.coalesce("__next", "__n") - F.col("row_start")).alias("run_len"))
