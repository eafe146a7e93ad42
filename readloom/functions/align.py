"""Pairwise alignment. All pairs of a batch fill a row of their tables at once; none takes a step a cell."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The costs of the end-to-end alignment.
MISMATCH, GAP_OPEN, GAP_EXTEND = 6, 5, 3
_FAR = 1 << 30
#: Cells of the tables that a task holds at once, but for one larger pair.
CELLS = 1 << 24
_OPS = np.array(list("=XDI"))


def _batches(pairs: list[tuple[bytes, bytes]]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(which pairs, originals, modifieds, their lengths) padded to one size, pairs of like size together."""
    order = sorted(range(len(pairs)), key=lambda k: (len(pairs[k][0]), len(pairs[k][1])))
    while order:
        n = m = size = 0
        for k in order:
            n, m = max(n, len(pairs[k][0])), max(m, len(pairs[k][1]))
            if size and (n + 1) * (m + 1) * (size + 1) > CELLS:
                break
            size += 1
        held, order = order[:size], order[size:]
        of = [[pairs[k][s] for k in held] for s in (0, 1)]
        sizes = [np.array([len(x) for x in xs]) for xs in of]
        # pads differ from each other and from all letters
        padded = [np.frombuffer(b"".join(x.ljust(int(z.max()), p) for x in xs), np.uint8).reshape(len(held), -1) for xs, z, p in zip(of, sizes, (b"\0", b"\1"), strict=True)]
        yield held, *padded, *sizes


def _lowest(base: np.ndarray, step: int) -> np.ndarray:
    """The least of each entry and its forerunners in a row, each ``step`` dearer a place."""
    ramp = step * np.arange(base.shape[1])
    return np.minimum.accumulate(base - ramp, axis=1) + ramp


def _choose(diag: np.ndarray, gone: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pick, least = np.where(diag < gone, 0, 1), np.minimum(diag, gone)
    return np.where(more < least, 2, pick), np.minimum(least, more)


def _runs(steps: np.ndarray) -> list[tuple[int, str]]:
    """Runs of the operations (0 to 3, others are none) of one pair, given from the end."""
    ops = steps[steps >= 0][::-1]
    edge = np.flatnonzero(np.diff(ops, prepend=-1))
    return [(int(n), str(_OPS[ops[a]])) for a, n in zip(edge, np.diff(edge, append=len(ops)), strict=True)]


def affine_cigars(pairs: list[tuple[bytes, bytes]], mismatch: int = MISMATCH, gap_open: int = GAP_OPEN, gap_extend: int = GAP_EXTEND) -> list[list[tuple[int, str]]]:
    """For each (original, modified) the runs of ``=``, ``X``, ``D`` (missing in modified) and ``I`` of a cheapest global alignment.

    Three layers (diagonal, deletion, insertion), whose gaps open at a cost. Of equally cheap ways a deletion is taken before
    the diagonal, and an insertion only where it is strictly cheaper.
    """
    out: list[list[tuple[int, str]]] = [[] for _ in pairs]
    start = gap_open + gap_extend
    for held, a, b, n, m in _batches(pairs):
        rows, width = a.shape[1] + 1, b.shape[1] + 1
        cost = np.full((3, len(held), width), _FAR, np.int64)
        cost[:, :, 0] = 0
        cost[2, :, 1:] = gap_open + gap_extend * np.arange(1, width)
        back = np.zeros((rows, 3, len(held), width), np.int8)
        back[0, 2, :, 1:] = 2
        each = np.arange(len(held))
        last = np.zeros((3, len(held)), np.int64)
        last[:, n == 0] = cost[:, each, m][:, n == 0]
        for i in range(1, rows):
            now = np.full_like(cost, _FAR)
            back[i, 0, :, 1:], low = _choose(*cost[:, :, :-1])
            now[0, :, 1:] = low + np.where(b == a[:, i - 1 : i], 0, mismatch)
            back[i, 1, :, 1:], now[1, :, 1:] = _choose(cost[0, :, 1:] + start, cost[1, :, 1:] + gap_extend, cost[2, :, 1:] + start)
            now[1, :, 0], back[i, 1, :, 0] = gap_open + gap_extend * i, 1
            now[2, :, 1:] = _lowest(np.minimum(now[0], now[1])[:, :-1] + start, gap_extend)
            back[i, 2, :, 1:] = _choose(now[0, :, :-1] + start, now[1, :, :-1] + start, now[2, :, :-1] + gap_extend)[0]
            cost = now
            last[:, n == i] = cost[:, each, m][:, n == i]
        layer, i, j = _choose(*last)[0], n.copy(), m.copy()
        steps = []
        while (live := (i > 0) | (j > 0)).any():
            prior = back[i, layer, each, j]
            same = (i > 0) & (j > 0) & (a[each, np.maximum(i, 1) - 1] == b[each, np.maximum(j, 1) - 1]) if a.size and b.size else np.zeros(len(held), bool)
            steps.append(np.where(live, np.where(layer == 0, np.where(same, 0, 1), layer + 1), -1))
            i = np.where(live & (layer != 2), i - 1, i)
            j = np.where(live & (layer != 1), j - 1, j)
            layer = np.where(live, prior, layer)
        table = np.array(steps, np.int64).reshape(-1, len(held))
        for x, k in enumerate(held):
            out[k] = _runs(table[:, x])
    return out


def affine_cigar(original: str, modified: str, mismatch: int = MISMATCH, gap_open: int = GAP_OPEN, gap_extend: int = GAP_EXTEND) -> list[tuple[int, str]]:
    """The same for one pair."""
    return affine_cigars([(original.encode(), modified.encode())], mismatch, gap_open, gap_extend)[0]


def _unit_rows(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of the edit distances between prefixes, and whether a cell came by the diagonal (0), a deletion (1) or an insertion (2).

    Of equally cheap ways the first of these is taken.
    """
    row = np.broadcast_to(np.arange(b.shape[1] + 1), (len(a), b.shape[1] + 1))
    yield row, np.full(row.shape, 2, np.int8)
    for i in range(1, a.shape[1] + 1):
        diag, gone = row[:, :-1] + (b != a[:, i - 1 : i]), row[:, 1:] + 1
        least = np.concatenate([np.full((len(a), 1), i), np.minimum(diag, gone)], axis=1)
        row = _lowest(least, 1)
        pick = np.where(row[:, 1:] < least[:, 1:], 2, np.where(gone < diag, 1, 0))
        yield row, np.concatenate([np.ones((len(a), 1), np.int8), pick.astype(np.int8)], axis=1)


def unit_cigars(pairs: list[tuple[bytes, bytes]]) -> list[list[tuple[int, str]]]:
    """The same runs where a substitution and each inserted or deleted letter cost 1: they add up to the edit distance."""
    out: list[list[tuple[int, str]]] = [[] for _ in pairs]
    for held, a, b, n, m in _batches(pairs):
        back = np.stack([way for _, way in _unit_rows(a, b)])
        each, i, j, steps = np.arange(len(held)), n.copy(), m.copy(), []
        while (live := (i > 0) | (j > 0)).any():
            way = back[i, each, j]
            same = (i > 0) & (j > 0) & (a[each, np.maximum(i, 1) - 1] == b[each, np.maximum(j, 1) - 1]) if a.size and b.size else np.zeros(len(held), bool)
            steps.append(np.where(live, np.where(way == 0, np.where(same, 0, 1), way + 1), -1))
            i, j = np.where(live & (way != 2), i - 1, i), np.where(live & (way != 1), j - 1, j)
        table = np.array(steps, np.int64).reshape(-1, len(held))
        for x, k in enumerate(held):
            out[k] = _runs(table[:, x])
    return out


def best_prefixes(pairs: list[tuple[bytes, bytes]]) -> list[tuple[int, int]]:
    """(ed, length): the least edit distance of the original to a prefix of the modified, and the longest such prefix: one table's last row."""
    out = [(0, 0)] * len(pairs)
    for held, a, b, n, m in _batches(pairs):
        outside = np.arange(b.shape[1] + 1) > m[:, None]
        for i, (row, _) in enumerate(_unit_rows(a, b)):
            for x in np.flatnonzero(n == i).tolist():
                ends = np.where(outside[x], _FAR, row[x])
                out[held[x]] = (int(ends.min()), int(len(ends) - 1 - ends[::-1].argmin()))
    return out


def _of_pairs(run: Callable, kind: str) -> Callable[[Column, Column], Column]:
    """A column function of (original, modified); null if either is."""

    def column(original: pd.Series, modified: pd.Series) -> pd.Series:
        there = [k for k, (x, y) in enumerate(zip(original, modified, strict=True)) if x is not None and y is not None]
        out: list = [None] * len(original)
        for k, v in zip(there, run([(original.iloc[k].encode(), modified.iloc[k].encode()) for k in there]), strict=True):
            out[k] = v
        return pd.Series(out, dtype=object)

    return F.pandas_udf(column, kind)


def _named(run: Callable) -> Callable:
    return lambda pairs: [[{"n": n, "op": op} for n, op in x] for x in run(pairs)]


def cigar(original: Column, modified: Column) -> Column:
    """Array of (n, op) runs, see :func:`affine_cigars`; null if either string is."""
    return _of_pairs(_named(affine_cigars), "array<struct<n:int,op:string>>")(original, modified)


def unit_cigar(original: Column, modified: Column) -> Column:
    """Array of (n, op) runs, see :func:`unit_cigars`; null if either string is."""
    return _of_pairs(_named(unit_cigars), "array<struct<n:int,op:string>>")(original, modified)


def best_prefix(original: Column, modified: Column) -> Column:
    """(ed, length), see :func:`best_prefixes`; null if either string is."""
    pack = lambda pairs: [f"{ed} {length}" for ed, length in best_prefixes(pairs)]
    both = F.split(_of_pairs(pack, "string")(original, modified), " ")
    return F.when(both.isNotNull(), F.struct(both[0].cast("int").alias("ed"), both[1].cast("int").alias("length")))


def cigar_cost(runs: Column, mismatch: int = MISMATCH, gap_open: int = GAP_OPEN, gap_extend: int = GAP_EXTEND) -> Column:
    """What a CIGAR costs: its substitutions, and its gaps by their length and opening."""
    one = lambda r: F.when(r["op"] == "X", r["n"] * mismatch).when(r["op"] == "=", 0).otherwise(gap_open + gap_extend * r["n"])
    return F.aggregate(runs, F.lit(0), lambda x, r: x + one(r))


def cigar_length(runs: Column, ops: str) -> Column:
    """Letters of the runs of these operations: ``=XD`` give the original's, ``=XI`` the modified's."""
    return F.aggregate(runs, F.lit(0), lambda x, r: x + F.when(r["op"].isin(list(ops)), r["n"]).otherwise(0))
