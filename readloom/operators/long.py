"""The order of all suffixes of long reads, by names of four times the symbols in each round, on compressed columns.

Reads are dealt to blocks. A suffix is named by the place of its first WIDTH symbols among all; suffixes that share a name are open.
In each round the open ones of a block take along the names of the rows 1, 2 and 3 times ``reach`` symbols further in their read, which
lie in the same block, meet those of their name, and come back with the names of four times the symbols. A read without open rows leaves
the rounds. So only open rows cross the shuffle, and only reads that have some are stored again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions.dna import ALPHABET
from readloom.operators import packed
from readloom.plans.store import stored

#: Symbols of the first names, 3 bits each.
WIDTH = packed.WIDTH
#: Rows of a block of reads, and of a part of names, at least; with many rows they grow up to MOST, as each block sends a line to each part.
BLOCK, PART, MOST = 1 << 19, 1 << 19, 1 << 21
#: Blocks and parts from which on they grow.
MANY = 256
#: A name is the number of its part and its place in the part.
PLACE = 32
MAX_ROUNDS = 60
#: Windows of the sample for the bounds of parts, about; bounds decide how even parts are, not what is in the result.
SAMPLE = 40_000
#: Rows of the result that leave a task together.
CHUNK = 1 << 17

_STATE = "done boolean, n long, open long, counts array<bigint>, block int, rank binary, size binary, code binary, name binary, more binary"
_UPDATE = "block int, i binary, name binary, more binary"


def build(reads: DataFrame) -> DataFrame:
    """(row, read_rank, pos, sym) of prepared reads (read_rank, seq) of any length."""
    t, width, shift, further, step = packed._T, WIDTH, PLACE, ("next", "next2", "next3"), CHUNK
    symbols = np.zeros(256, np.uint8)
    symbols[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))
    _, total, _ = packed.measured(reads)
    blocks, parts = (-(-total // max(least, min(MOST, total // MANY))) for least in (BLOCK, PART))
    if not total:
        return reads.sparkSession.createDataFrame([], "row long, read_rank long, pos int, sym string")
    bounds = _bounds(reads, total, parts)
    masks = t["masks"](1)[0] if width == packed.WIDTH else np.array([sum(7 << (3 * (width - 1 - j)) for j in range(n)) for n in range(width + 1)], np.int64)
    fields = [x.split() for x in _STATE.split(", ")]
    kinds = {"boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    schema = pa.schema([(n, kinds[k]) for n, k in fields])
    update = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in _UPDATE.split(", "))])

    def table(lines: list, form: pa.Schema) -> pa.Table:
        return pa.table([pa.array([x[i] for x in lines], f.type) for i, f in enumerate(form)], schema=form)

    def line_batch(lines: list, columns: list[str]) -> pa.RecordBatch:
        names = ["part", "block", "n", "i", *columns]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in lines], pa.int32() if i < 3 else pa.binary()) for i in range(len(names))], names)

    def gathered(group: pa.Table) -> pa.Table:
        group = group.sort_by("read_rank")
        text = "$".join(group.column("seq").to_pylist()) + "$"
        code = symbols[np.frombuffer(text.encode(), np.uint8)]
        size = np.diff(np.nonzero(code == 0)[0], prepend=-1)
        return table([[False, len(code), 0, None, group.column("block")[0].as_py(), t["put"](group.column("read_rank").to_numpy()), t["put"](size), t["put"](code), None, None]], schema)

    def sorted_keys(size: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first symbols of a block's suffixes, their order, and the letters up to the end. What is alike stays in its order, wherever this runs."""
        left = np.repeat(np.cumsum(size), size) - 1 - np.arange(len(code))
        tail, key = np.append(code, np.zeros(width, np.int64)), np.zeros(len(code), np.int64)
        for j in range(width):
            key = (key << 3) | tail[j : j + len(code)]
        key &= masks[np.minimum(left, width)]
        return key, np.argsort(key, kind="stable"), left

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ranks, sizes, codes in zip(*(batch.column(c).to_pylist() for c in ("block", "rank", "size", "code")), strict=True):
                rank, size, code = map(t["got"], (ranks, sizes, codes))
                key, order, left = sorted_keys(size, code)
                # suffixes that end within their key differ by their reads
                tie = np.where(left < width, np.repeat(rank, size), -1)
                key, tie = key[order], tie[order]
                cuts = [0, *np.searchsorted(key, bounds).tolist(), len(key)]
                # rows are known by their order
                lines = [(g, block, b - a, None, *t["put_key"]([key[a:b]]), t["put"](tie[a:b])) for g, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
                yield line_batch(lines, ["key", "tie"])

    def joined(group: pa.Table, *columns: str) -> list[np.ndarray]:
        """The columns of all lines, one after another."""
        return [np.concatenate([t["got"](x) for x in group.column(c).to_pylist()]) for c in columns]

    def sent(group: pa.Table, order: np.ndarray, name: np.ndarray, more: np.ndarray, put: Callable) -> pa.Table:
        """Sorted rows' names go back as their rows came: line by line, with the ``i`` of the line."""
        back = [np.empty_like(x) for x in (name, more)]
        for x, y in zip(back, (name, more), strict=True):
            x[order] = y
        ends = np.cumsum(group.column("n").to_numpy()).tolist()
        lines = zip(group.column("block").to_pylist(), group.column("i").to_pylist(), [0, *ends], ends)
        return table([[block, i, put(back[0][a:b]), t["put"](back[1][a:b])] for block, i, a, b in lines], update)

    def grouped(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the first of each row's group, and whether it has more rows; ``new`` marks first rows."""
        first = np.nonzero(new)[0]
        size = np.diff(np.append(first, len(new)))
        return np.repeat(first, size), np.repeat(size > 1, size)

    def changed(*columns: np.ndarray) -> np.ndarray:
        return np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0))

    def named(group: pa.Table) -> pa.Table:
        key = np.concatenate([t["got_key"]([x])[0] for x in group.column("key").to_pylist()])
        (tie,) = joined(group, "tie")
        order = np.argsort(key, kind="stable")
        # all rows of a key have ties, or none has
        tied = np.nonzero(tie[order] >= 0)[0]
        own = order[tied]
        order[tied] = own[np.lexsort((tie[own], key[own]))]
        first, more = grouped(changed(key[order], tie[order]))
        return sent(group, order, (group.column("part")[0].as_py() << shift) + first, more, lambda x: t["put_key"]([x])[0])

    def lines_of(block: int, rank, size, code, name, more, counts: list | None) -> pa.Table:
        """A line of the reads that have open rows, and one of those that have none."""
        start = np.cumsum(size) - size
        live = np.add.reduceat(more, start) > 0
        out = []
        for done, reads_ in ((True, ~live), (False, live)):
            if reads_.any():
                own = np.repeat(reads_, size)
                out.append([done, int(own.sum()), int(more[own].sum()), counts, block, *(t["put"](x) for x in (rank[reads_], size[reads_], code[own], name[own], more[own]))])
                counts = None
        return table(out, schema)

    def taken(base: pa.Table, some: pa.Table) -> pa.Table:
        """The reads of a block with the names that have come; the first time these are all, and are counted by parts."""
        line = base.to_pylist()[0]
        rank, size, code = (t["got"](line[c]) for c in ("rank", "size", "code"))
        begun = line["name"] is None
        name, more = (np.zeros(line["n"], np.int64), np.zeros(line["n"], np.int64)) if begun else (t["got"](line["name"]), t["got"](line["more"]))
        if begun:  # rows come in the order of their keys
            got = sorted(((t["got_key"]([u["name"]])[0], t["got"](u["more"])) for u in some.to_pylist()), key=lambda x: x[0][0])
            _, order, _ = sorted_keys(size, code)
            name[order], more[order] = (np.concatenate(x) for x in zip(*got, strict=True))
        else:
            for u in some.to_pylist():
                i = np.cumsum(t["got"](u["i"]))
                name[i], more[i] = t["got"](u["name"]), t["got"](u["more"])
        return lines_of(line["block"], rank, size, code, name, more, np.bincount(name >> shift, minlength=parts).tolist() if begun else None)

    def asked(reach: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, names, mores in zip(*(batch.column(c).to_pylist() for c in ("block", "name", "more")), strict=True):
                    name, more = t["got"](names), t["got"](mores) > 0
                    i = np.nonzero(more)[0]
                    part = name[i] >> shift
                    order = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
                    i, part = i[order], part[order]
                    # an open row has at least ``reach`` letters; one that is not open is decided by its own name
                    after, at, on = [], i, np.ones(len(i), bool)
                    for _ in further:
                        at = np.where(on, at + reach, 0)
                        after.append(np.where(on, name[at], -1))
                        on = on & more[at]
                    cuts = np.nonzero(np.diff(part, prepend=-1))[0].tolist()
                    lines = [(int(part[a]), block, b - a, *map(t["put"], (np.diff(i[a:b], prepend=0), name[i[a:b]], *(x[a:b] for x in after)))) for a, b in zip(cuts, [*cuts[1:], len(i)])]
                    yield line_batch(lines, ["name", *further])

        return run

    def refined(group: pa.Table) -> pa.Table:
        name, *after = joined(group, "name", *further)
        order = np.lexsort((*after[::-1], name))
        name, after = name[order], [x[order] for x in after]
        begin, _ = grouped(changed(name))
        first, more = grouped(changed(name, *after))
        return sent(group, order, name + first - begin, more, t["put"])

    some = min(max(blocks, 1), 2048)
    base = stored(reads.select((F.col("read_rank") % blocks).cast("int").alias("block"), "read_rank", "seq").repartition(some, "block").groupBy("block").applyInArrow(gathered, _STATE))
    line = lambda *columns: "part int, block int, n int" + "".join(f", {c} binary" for c in ("i", *columns))
    d = base.select("block", "rank", "size", "code").mapInArrow(keyed, line("key", "tie")).repartition(min(parts, 2048), "part")
    d = d.groupBy("part").applyInArrow(named, _UPDATE)
    now = stored(base.groupBy("block").cogroup(d.groupBy("block")).applyInArrow(taken, _STATE))
    counts = {r["p"]: r["n"] for r in now.filter("counts is not null").select(F.posexplode("counts").alias("p", "c")).groupBy("p").agg(F.sum("c").alias("n")).collect()}  # a row a part
    pieces, reach = [now.filter("done")], width
    for _ in range(MAX_ROUNDS):
        live = now.filter("not done")
        if not live.limit(1).count():
            break
        d = live.select("block", "name", "more").mapInArrow(asked(reach), line("name", *further)).groupBy("part").applyInArrow(refined, _UPDATE)
        now = stored(live.groupBy("block").cogroup(d.groupBy("block")).applyInArrow(taken, _STATE))
        pieces.append(now.filter("done"))
        reach *= 1 + len(further)
    else:
        raise RuntimeError(f"suffixes are not in order after {MAX_ROUNDS} rounds")
    size = np.array([counts.get(p, 0) for p in range(parts)], np.int64)
    offset = np.cumsum(size) - size

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ranks, sizes, codes, names in zip(*(batch.column(c).to_pylist() for c in ("rank", "size", "code", "name")), strict=True):
                rank, size, code, name = map(t["got"], (ranks, sizes, codes, names))
                row = offset[name >> shift] + (name & ((1 << shift) - 1))
                pos = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                rank, sym = np.repeat(rank, size), np.roll(code, 1)
                for a in range(0, len(row), step):
                    b = a + step
                    yield pa.RecordBatch.from_arrays([pa.array(row[a:b]), pa.array(rank[a:b]), pa.array(pos[a:b].astype(np.int32)), t["text_of"](sym[a:b])], ["row", "read_rank", "pos", "sym"])

    return reduce(DataFrame.unionByName, pieces).select("rank", "size", "code", "name").mapInArrow(rows, "row long, read_rank long, pos int, sym string")


def _bounds(reads: DataFrame, total: int, parts: int) -> np.ndarray:
    """The first keys of parts but the first: those of a sample of windows, at equal distances."""
    if parts < 2:
        return np.zeros(0, np.int64)
    rate, width = min(1.0, SAMPLE / total), WIDTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(1)
        for batch in batches:
            text = "$".join(batch.column("seq").to_pylist()) + "$"
            at = rng.integers(0, len(text), rng.binomial(len(text), rate)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([text[a : a + width].split("$")[0] for a in at], pa.string())], ["x"])

    low = ALPHABET.index
    some = reads.select("seq").mapInArrow(run, "x string").limit(2 * SAMPLE).collect()
    keys = sorted(int("".join(str(low(c)) for c in r["x"].ljust(width, "$")), 8) for r in some)
    return np.array(sorted({keys[len(keys) * g // parts] for g in range(1, parts)}) if keys else [], np.int64)
