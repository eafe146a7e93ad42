"""The order of all suffixes of short reads, sorted as packed keys, not as strings.

Three bits a symbol, 21 symbols a word: a suffix is WORDS words and its read's rank. A task packs, sorts and cuts the suffixes
of some reads at the bounds of groups, and each piece crosses the shuffle as compressed columns. A group sorts what it meets,
derives what is asked for while neighbours lie side by side, and is stored as compressed columns, which are expanded into rows
where they are read. Bounds come from a sample of reads; they decide how even groups are, not what is in the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions.dna import ALPHABET
from readloom.plans.store import stored

#: Symbols in a word: 3 bits each.
WIDTH = 21
#: Words of a key at most; longer reads are sorted as strings.
MOST_WORDS = 4
#: Rows of a group, of the pieces that a task sorts, and of a stored chunk.
GROUP, PIECE, CHUNK = 1 << 19, 1 << 21, 1 << 14
#: Reads of the sample for bounds at most.
SAMPLE = 20_000
NULL = -(1 << 63)


def _in_tasks() -> dict[str, Callable]:
    """Inner functions go to workers by value, so that these need not import this package."""
    width, step = WIDTH, CHUNK
    codes = np.zeros(256, np.uint8)
    codes[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))
    letters = np.frombuffer(ALPHABET.encode(), np.uint8)

    def put(a: np.ndarray) -> bytes:
        """Integers as bytes: less the smallest, the first bytes of all, then the second, ..., compressed."""
        a = a.astype(np.int64)
        low, high = (int(a.min()), int(a.max())) if len(a) else (0, 0)
        if high - low >= 1 << 63:
            low, high = 0, (1 << 64) - 1
        size, a = max(1, -(-(high - low).bit_length() // 8)), a - low
        raw = b"".join([(a >> (8 * i)).astype(np.uint8).tobytes() for i in range(size)])
        return bytes([size]) + low.to_bytes(8, "little", signed=True) + len(a).to_bytes(6, "little") + pa.compress(raw, "zstd", asbytes=True)

    def got(b: bytes) -> np.ndarray:
        size, low, n = b[0], int.from_bytes(b[1:9], "little", signed=True), int.from_bytes(b[9:15], "little")
        raw = np.frombuffer(pa.decompress(b[15:], size * n, "zstd", asbytes=True), np.uint8).reshape(size, n)
        out = raw[0].astype(np.int64)
        for i in range(1, size):
            out |= raw[i].astype(np.int64) << (8 * i)
        return out + low

    def put_key(keys: list[np.ndarray]) -> list[bytes]:
        """Words in their order: the first by its steps."""
        return [keys[0][:1].astype("<i8").tobytes() + put(np.diff(keys[0])), *map(put, keys[1:])]

    def got_key(parts: list[bytes]) -> list[np.ndarray]:
        first = np.frombuffer(parts[0][:8], "<i8").astype(np.int64)
        return [np.cumsum(np.concatenate([first, got(parts[0][8:])])), *map(got, parts[1:])]

    def masks(words: int) -> np.ndarray:
        """[word, length]: the bits of the first symbols."""
        n = np.arange(words * width + 1)
        held = np.clip(n[None, :] - width * np.arange(words)[:, None], 0, width)
        full = (1 << (3 * width)) - 1
        return np.array([[full ^ ((1 << (3 * (width - int(x)))) - 1) for x in line] for line in held], np.int64)

    def digits(keys: list[np.ndarray]) -> np.ndarray:
        """(rows, symbols): the codes in the words."""
        at = 3 * np.arange(width - 1, -1, -1)
        return np.concatenate([(k[:, None] >> at) & 7 for k in keys], axis=1).astype(np.uint8)

    def shared(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
        """Common first symbols of rows of words; -1 where all are alike."""
        n = np.full(len(x[0]), -1, np.int64)
        for w in range(len(x) - 1, -1, -1):
            d = x[w] ^ y[w]
            # no two neighbouring bits on top, so floats don't round up to the next power
            top = np.frexp((d & ~(d >> 1)).astype(np.float64))[1] - 1
            n = np.where(d != 0, w * width + (3 * width - 1 - top) // 3, n)
        return n

    def common(x: list[np.ndarray], y: list[np.ndarray], size: tuple, full: tuple, cap: int) -> np.ndarray:
        """Common prefixes of rotations, at most ``cap``: x and y are their words, size their suffixes' lengths, full those of their reads."""
        n = shared(x, y)
        out = np.where(n < 0, cap, np.minimum(n, cap))
        # suffixes alike, reads of other lengths: what comes behind are the reads from their starts
        m = masks(len(x))
        tied = (size[0] == size[1]) & (full[0] != full[1])
        for w in range(len(x)):
            tied &= ((x[w] ^ y[w]) & m[w][np.minimum(size[0], size[1])]) == 0
        tied = np.nonzero(tied)[0]
        for i in range(0, len(tied), step):
            own, at = [], tied[i : i + step]
            for k, s, q in ((x, size[0], full[0]), (y, size[1], full[1])):
                d, s, q = digits([w[at] for w in k]), s[at][:, None], q[at][:, None]
                j = np.arange(d.shape[1])[None, :]
                own.append(np.where(j < q, np.take_along_axis(d, (j + s) % q, axis=1), 0))
            out[at] = np.minimum(cap, size[0][at] + (own[0] != own[1]).argmax(axis=1))
        return out

    def rows_of(text: bytes, lengths: np.ndarray, rank: np.ndarray, words: int, turned: bool) -> dict:
        """key (words), read (place in ``rank``), pos, sym, full of all suffixes, read by read; of rotations, if ``turned``."""
        n, full = len(lengths), lengths + 1
        span = int(full.max())
        d = np.zeros((n, words * width), np.uint8)
        d[np.arange(words * width)[None, :] < lengths[:, None]] = codes[np.frombuffer(text, np.uint8)]
        k = []
        for w in range(words):
            x = np.zeros(n, np.int64)
            for j in range(width):
                x = (x << 3) | d[:, w * width + j]
            k.append(x)
        bits = (1 << (3 * width)) - 1
        end = full - 1
        out = [np.empty((n, span), np.int64) for _ in range(words)]
        for p in range(span):
            for w in range(words):
                out[w][:, p] = k[w]
            if p + 1 < span:
                first = k[0] >> (3 * (width - 1))
                for w in range(words):
                    k[w] = ((k[w] << 3) & bits) | (k[w + 1] >> (3 * (width - 1)) if w + 1 < words else 0)
                    if turned:
                        k[w] |= np.where(end // width == w, first << (3 * (width - 1 - end % width)), 0)
        there = np.arange(span)[None, :] < full[:, None]
        read, pos = np.nonzero(there)
        sym = np.where(pos == 0, 0, d[read, pos - 1])
        return {"key": [x[there] for x in out], "read": read, "pos": pos, "sym": sym, "full": full[read]}

    def below(keys: list[np.ndarray], rank: np.ndarray, bound: tuple) -> int:
        """How many of the sorted rows lie before a bound."""
        low, high = 0, len(rank)
        for x, b in zip([*keys, rank], bound, strict=True):
            part = x[low:high]
            low, high = low + int(np.searchsorted(part, b)), low + int(np.searchsorted(part, b, "right"))
            if low == high:
                break
        return low

    def together(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
        """Rows of batches, up to some ``most`` and a batch at once."""
        held, n = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, most):
                held.append(batch.slice(i, most))
                n += held[-1].num_rows
                if n >= most:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held, n = [], 0
        if n:
            yield pa.Table.from_batches(held).combine_chunks()

    def text_of(codes_: np.ndarray, lengths: np.ndarray | None = None) -> pa.Array:
        """Strings of codes, one symbol each or of ``lengths``."""
        n = len(codes_) if lengths is None else len(lengths)
        ends = np.arange(n + 1) if lengths is None else np.concatenate([[0], np.cumsum(lengths)])
        return pa.StringArray.from_buffers(n, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(letters[codes_].tobytes()))

    return locals()


_T = _in_tasks()


class Sorted:
    """The sorted rows of reads, stored as compressed columns.

    ``keep``: columns of the index (read_rank, pos, sym, suffix) and of ``reads`` (whole numbers) that are stored. ``lcp`` is the
    cap of common prefixes with the next row, if they are asked for. Rows whose ``gone`` (a column of reads) is true are sorted
    and compared like all, then left out: a row's common prefix is the least up to the next row left. ``sources``: reads are of so
    many indexes, by source_id; old_row is then the number of a row among those of its source.
    """

    def __init__(self, reads: DataFrame, keep: tuple[str, ...], lcp: int | None = None, gone: str | None = None, sources: int = 0, known: tuple | None = None):
        self.reads, self.keep, self.cap, self.gone, self.sources = reads, keep, lcp, gone, sources
        self.n, self.total, longest = known or measured(reads)
        self.words = max(1, -(-(longest + 1) // WIDTH))
        self.carried = [c for c in keep if c not in ("read_rank", "pos", "sym", "suffix")]
        for c in ("source_id",) if sources else ():
            self.carried += [c] if c not in self.carried else []
        self.held = stored(self._sorted())
        self._number()

    def _bounds(self) -> list[tuple]:
        """Where groups begin: rows of a sample at equal distances."""
        groups = -(-self.total // GROUP)
        if groups < 2:
            return []
        share = min(1.0, max(2_000, min(SAMPLE, 8 * groups)) / self.n)
        some = sorted((r["read_rank"], r["seq"]) for r in self.reads.select("read_rank", "seq").sample(share, seed=1).limit(2 * SAMPLE).collect())
        if not some:
            return []
        rank = np.array([r for r, _ in some], np.int64)
        got = _T["rows_of"]("".join(s for _, s in some).encode(), np.array([len(s) for _, s in some]), rank, self.words, False)
        own = rank[got["read"]]
        order = np.lexsort((own, *got["key"][::-1]))
        at = order[[len(order) * i // groups for i in range(1, groups)]]
        return sorted({(*[int(k[i]) for k in got["key"]], int(own[i])) for i in at})

    def _sorted(self) -> DataFrame:
        t, words, turned, cap, gone, sources = _T, self.words, self.cap is not None, self.cap, self.gone, self.sources
        bounds, carried = self._bounds(), [*self.carried, *([self.gone] if self.gone else [])]
        piece, chunk, null = PIECE, CHUNK, NULL
        m = t["masks"](words)
        keys = [f"w{i}" for i in range(words)]
        # what a piece needs to hold besides its keys and ranks
        also = [*(["pos"] if turned or {"pos", "suffix"} & {*self.keep} else []), *(["full"] if turned or "suffix" in self.keep else []), *(["sym"] if "sym" in self.keep else [])]

        def pieces(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            d = pa.Table.from_batches(batches).combine_chunks()
            d = d.sort_by("read_rank")
            rank = d.column("read_rank").to_numpy()
            text = d.column("seq").to_pylist()
            x = t["rows_of"]("".join(text).encode(), np.array([len(s) for s in text]), rank, words, turned)
            key = [k & m[w][x["full"] - x["pos"]] for w, k in enumerate(x["key"])] if turned else x["key"]
            order = np.lexsort(key[::-1])  # rows come read by read, so alike ones stay in the order of reads
            key, own = [k[order] for k in key], rank[x["read"]][order]
            cuts = [0, *[t["below"](key, own, b) for b in bounds], len(own)]
            columns = {c: x[c][order] for c in also} | {c: d.column(c).cast(pa.int64()).fill_null(null).to_numpy()[x["read"]][order] for c in carried}
            shown = [k[order] for k in x["key"]] if turned else key
            lines = []
            for g, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if a < b:
                    part = [k[a:b] for k in shown]
                    line = list(map(t["put"], part)) if turned else t["put_key"](part)
                    lines.append([g, *line, t["put"](own[a:b]), *[t["put"](c[a:b]) for c in columns.values()]])
            names = ["__g", *keys, "read_rank", *columns]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in lines], pa.int32() if i == 0 else pa.binary()) for i in range(len(names))], names)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0
            for batch in batches:
                step = max(1, piece // (words * 21))
                for i in range(0, batch.num_rows, step):
                    held.append(batch.slice(i, step))
                    n += held[-1].num_rows
                    if n >= step:
                        yield from pieces(held)
                        held, n = [], 0
            if n:
                yield from pieces(held)

        names = ["read_rank", *also, *carried]
        kept = list(dict.fromkeys([*[c for c in self.keep if c != "suffix"], *self.carried]))
        form = [*kept, *(["lcp"] if turned else []), *(["own_row"] if sources else []), *([*keys, "size"] if "suffix" in self.keep else [])]

        def met(group: pa.Table) -> pa.Table:
            parts = [[group.column(k)[i].as_py() for k in keys] for i in range(group.num_rows)]
            parts = [list(map(t["got"], p)) if turned else t["got_key"](p) for p in parts]
            key = [np.concatenate([p[w] for p in parts]) for w in range(words)]
            x = {c: np.concatenate([t["got"](b) for b in group.column(c).to_pylist()]) for c in names}
            if "full" in x:
                x["size"] = x["full"] - x["pos"]
            by = [k & m[w][x["size"]] for w, k in enumerate(key)] if turned else key
            order = np.lexsort((x["read_rank"], *by[::-1]))
            key, x = [k[order] for k in key], {c: v[order] for c, v in x.items()}
            first = last = None
            if turned:
                pair = lambda c: (x[c][:-1], x[c][1:])
                x["lcp"] = np.append(t["common"]([k[:-1] for k in key], [k[1:] for k in key], pair("size"), pair("full"), cap), cap)
            if gone:
                left = np.nonzero(x[gone] == 0)[0]
                if turned and len(left):
                    least = np.minimum.reduceat(x["lcp"], left)
                key, x = [k[left] for k in key], {c: v[left] for c, v in x.items()}
                if turned and len(left):
                    x["lcp"] = least
            n = len(x["read_rank"])
            if turned and n:
                first, last = ([*[int(k[i]) for k in key], int(x["size"][i]), int(x["full"][i])] for i in (0, -1))
            if "suffix" in self_keep and turned:
                key = [k & m[w][x["size"]] for w, k in enumerate(key)]
            counts = np.zeros(0, np.int64)
            if sources:
                x["own_row"] = np.empty(n, np.int64)
                for s in range(sources):
                    own = x["source_id"] == s
                    x["own_row"][own] = np.arange(int(own.sum()))
                counts = np.bincount(x["source_id"], minlength=sources)
            x |= dict(zip(keys, key, strict=True))
            lines = [[group.column("__g")[0].as_py(), a, min(chunk, n - a), n, counts.tolist(), first, last, *[t["put"](x[c][a : a + chunk]) for c in form]] for a in range(0, n, chunk)]
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 3, *[pa.binary()] * len(form)]
            return pa.table([pa.array([y[i] for y in lines], k) for i, k in enumerate(kinds)], names=["part", "at", "n", "rows", "counts", "first", "last", *[f"c_{c}" for c in form]])

        self_keep = self.keep
        self.form = form
        d = self.reads.select("read_rank", "seq", *[F.col(c).cast("long").alias(c) for c in carried])
        kind = ", ".join(f"{c} binary" for c in (*keys, *names))
        d = d.mapInArrow(cut, f"__g int, {kind}").repartition(max(1, len(bounds) + 1), "__g")
        got = ", ".join(f"c_{c} binary" for c in form)
        return d.groupBy("__g").applyInArrow(met, f"part int, at long, n int, rows long, counts array<bigint>, first array<bigint>, last array<bigint>, {got}")

    def _number(self) -> None:
        """Numbers of the first rows of groups, and the common prefix over their edges: a row a group."""
        groups = self.held.filter("at = 0").select("part", "rows", "counts", "first", "last").orderBy("part").collect()
        offsets, row, own = [], 0, [0] * self.sources
        for i, g in enumerate(groups):
            edge = 0
            if self.cap is not None and i + 1 < len(groups):
                x, y = (np.array(v, np.int64)[:, None] for v in (g["last"], groups[i + 1]["first"]))
                edge = int(_T["common"](list(x[:-2]), list(y[:-2]), (x[-2], y[-2]), (x[-1], y[-1]), self.cap)[0])
            offsets.append((g["part"], row, list(own), edge))
            row += g["rows"]
            own = [a + b for a, b in zip(own, g["counts"], strict=True)]
        self.rows_left = row
        self.offsets = self.held.sparkSession.createDataFrame(offsets, "part int, __row long, __own array<bigint>, __edge int")

    def rows(self, *columns: str, only: np.ndarray | None = None, prefix: str = "") -> DataFrame:
        """(row, columns): of the columns kept, and lcp and old_row. Of all rows, or of the sorted numbers ``only``, or of those
        whose suffix starts with the letters ``prefix`` (up to WIDTH of them); others aren't expanded."""
        t, words = _T, self.words
        head, shift = 0, 3 * (WIDTH - len(prefix := prefix[:WIDTH]))
        for x in prefix:
            head = (head << 3) | ALPHABET.index(x)
        kinds = {"row": "long", "read_rank": "long", "pos": "int", "sym": "string", "suffix": "string", "lcp": "int", "old_row": "long"}
        kinds |= {c: self.reads.schema[c].dataType.simpleString() for c in self.carried}
        keys, null = [f"c_w{i}" for i in range(words)], NULL
        needs = {"suffix": [*keys, "c_size"], "old_row": ["c_own_row", "c_source_id"]}
        asked = list(dict.fromkeys([*(keys[:1] if prefix else []), *[n for c in columns for n in needs.get(c, [f"c_{c}"])]]))
        shown = ["row", *columns]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for line in batch.to_pylist():
                    n, out, first = line["n"], [], line["__row"] + line["at"]
                    at = np.arange(n)
                    if only is not None:
                        at = only[np.searchsorted(only, first) : np.searchsorted(only, first + n)] - first
                    if prefix and len(at):
                        at = at[(t["got"](line[keys[0]])[at] >> shift) == head]
                    if not len(at):
                        continue
                    for c in shown:
                        if c == "row":
                            v = pa.array(first + at)
                        elif c == "sym":
                            v = t["text_of"](t["got"](line["c_sym"])[at])
                        elif c == "suffix":
                            size = t["got"](line["c_size"])[at]
                            d = t["digits"]([t["got"](line[k])[at] for k in keys])
                            v = t["text_of"](d[np.arange(d.shape[1])[None, :] < size[:, None]], size)
                        elif c == "old_row":
                            v = pa.array((np.array(line["__own"], np.int64)[t["got"](line["c_source_id"])] + t["got"](line["c_own_row"]))[at])
                        else:
                            x = t["got"](line[f"c_{c}"])
                            if c == "lcp" and line["at"] + n == line["rows"]:
                                x[-1] = line["__edge"]
                            x = x[at]
                            v = pa.array(x, mask=x == null).cast({"int": pa.int32()}.get(kinds[c], pa.int64()))
                        out.append(v)
                    yield pa.RecordBatch.from_arrays(out, shown)

        d = self.held.select("part", "at", "n", "rows", *asked).join(F.broadcast(self.offsets), "part")  # a row a group
        return d.mapInArrow(run, ", ".join(f"{c} {'int' if kinds[c] == 'int' else 'string' if kinds[c] == 'string' else 'long'}" for c in shown))

    def stretches(self, bits: int) -> DataFrame:
        """(bin_id, at, syms): the symbols of each chunk as strings, cut where bins of 2^bits rows end; ``at`` is the row of the first."""
        t = _T

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for line in batch.to_pylist():
                    low = line["__row"] + line["at"]
                    high = low + line["n"]
                    first = np.concatenate([[low], np.arange((low >> bits) + 1, ((high - 1) >> bits) + 1) << bits])
                    syms = t["text_of"](t["got"](line["c_sym"]), np.diff(np.append(first, high)))
                    yield pa.RecordBatch.from_arrays([pa.array(first >> bits), pa.array(first), syms], ["bin_id", "at", "syms"])

        d = self.held.select("part", "at", "n", "c_sym").join(F.broadcast(self.offsets.select("part", "__row")), "part")  # a row a group
        return d.mapInArrow(run, "bin_id long, at long, syms string")

    def places(self, patterns: DataFrame, most: int) -> DataFrame | None:
        """(pattern, l, h) of distinct patterns of letters: l suffixes are smaller, h - l start with it. None if there are more than ``most``.

        Patterns go to all tasks as sorted keys. A chunk of rows says where those between its first and last row lie, and
        which pattern is the first behind it; others lie where the nearest smaller one does. Suffixes have to be kept.
        """
        t, words, low = _T, self.words, ALPHABET.index
        some = [r["pattern"] for r in patterns.select("pattern").distinct().limit(most + 1).collect()]
        if len(some) > most:
            return None
        span, spark = words * WIDTH, self.held.sparkSession

        def key(x: str, rest: int) -> tuple:
            d = [low(c) for c in x[:span]]
            d += [rest] * (span - len(d))
            return tuple(int("".join(map(str, d[w * WIDTH : (w + 1) * WIDTH])), 8) for w in range(words))

        ends = [{x: key(x, rest) for x in some} for rest in (0, 7)]
        bounds = sorted({k for e in ends for k in e.values()})
        number = {k: i for i, k in enumerate(bounds)}
        sorted_ = [np.array([b[w] for b in bounds], np.int64) for w in range(words)]
        keys = [f"c_w{i}" for i in range(words)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            none = np.zeros(len(bounds), np.int64)
            for batch in batches:
                out = []
                for line in batch.to_pylist():
                    k, first = [t["got"](line[c]) for c in keys], line["__row"] + line["at"]
                    # bounds up to the first row lie before this chunk, those behind the last row are known by the first of them
                    begin, end = (t["below"](sorted_, none, (*[int(x[i]) for x in k], 1)) for i in (0, -1))
                    out += [(j, first + t["below"](k, np.zeros(line["n"], np.int64), (*bounds[j], 0))) for j in range(begin, end)]
                    if end < len(bounds):
                        out.append((end, first + line["n"]))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["i", "at"])

        d = self.held.select("part", "at", "n", *keys).join(F.broadcast(self.offsets.select("part", "__row")), "part")  # a row a group
        met = d.mapInArrow(run, "i long, at long").groupBy("i").agg(F.max("at").alias("at")).collect()  # at most two a pattern
        upto = np.zeros(len(bounds), np.int64)
        for r in met:
            upto[r["i"]] = r["at"]
        upto = np.maximum.accumulate(upto)
        got = [(x, *[int(upto[number[e[x]]]) for e in ends]) for x in some]
        return spark.createDataFrame(got, "pattern string, l long, h long")


class Rotations(Sorted):
    """The sorted rows of reads with their whole cyclic strings, which no table holds: the keys that cross the shuffle are these strings.

    Rows are numbered by the sizes of groups, which are counted first; so groups leave as rows, and aren't stored. What crosses the
    shuffle of a key's first word is the suffix, by its steps, and the rest of the rotation apart.
    """

    def __init__(self, reads: DataFrame, known: tuple | None = None):
        self.reads = reads
        self.n, self.total, longest = known or measured(reads)
        self.words = max(1, -(-(longest + 1) // WIDTH))
        self.bounds = self._bounds()

    def _sizes(self) -> np.ndarray:
        """Rows of each group: rows are counted between bounds by their first words, and only those that share a bound's are sorted."""
        t, words, bounds, step = _T, self.words, self.bounds, max(1, PIECE // (self.words * WIDTH))
        if not bounds:
            return np.array([self.total], np.int64)
        low = np.array([b[0] for b in bounds], np.int64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            upto = np.zeros(len(bounds) + 1, np.int64)
            for d in t["together"](batches, step):
                text, rank = d.column("seq").to_pylist(), d.column("read_rank").to_numpy()
                x = t["rows_of"]("".join(text).encode(), np.array([len(s) for s in text]), rank, words, False)
                at = np.searchsorted(low, x["key"][0])
                tied = low[np.minimum(at, len(low) - 1)] == x["key"][0]
                upto += np.cumsum(np.bincount(at[~tied], minlength=len(upto)))
                key, own = [k[tied] for k in x["key"]], rank[x["read"]][tied]
                order = np.lexsort((own, *key[::-1]))
                key, own = [k[order] for k in key], own[order]
                upto += np.array([*[t["below"](key, own, b) for b in bounds], len(own)])
            yield pa.RecordBatch.from_arrays([pa.array(range(len(upto))), pa.array(upto)], ["g", "n"])

        got = self.reads.select("read_rank", "seq").mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).orderBy("g").collect()  # a row a group
        return np.diff([r["n"] for r in got], prepend=0)

    def rows(self) -> DataFrame:
        """(row, read_rank, pos, rotation)."""
        t, words, bounds, piece, chunk = _T, self.words, self.bounds, PIECE, CHUNK
        m, size = t["masks"](words), self._sizes()
        start, keys = np.cumsum(size) - size, [f"w{i}" for i in range(words)]
        columns = ["__g", *keys, "rest", "read_rank", "pos", "full"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for d in t["together"](batches, max(1, piece // (words * 21))):
                rank, text = d.column("read_rank").to_numpy(), d.column("seq").to_pylist()
                x = t["rows_of"]("".join(text).encode(), np.array([len(s) for s in text]), rank, words, True)
                key = [k & m[w][x["full"] - x["pos"]] for w, k in enumerate(x["key"])]
                own = rank[x["read"]]
                order = np.lexsort((own, *key[::-1]))
                key, own = [k[order] for k in key], own[order]
                cuts = [0, *[t["below"](key, own, b) for b in bounds], len(own)]
                first, rest, full, pos = key[0], x["key"][0][order] ^ key[0], x["full"][order], x["pos"][order]
                shown = [k[order] for k in x["key"][1:]]
                lines = [[g, *t["put_key"]([first[a:b]]), *(t["put"](c[a:b]) for c in (*shown, rest, own, pos, full))] for g, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
                yield pa.RecordBatch.from_arrays([pa.array([y[j] for y in lines], pa.int32() if j == 0 else pa.binary()) for j in range(len(columns))], columns)

        def met(group: pa.Table) -> pa.Table:
            g = group.column("__g")[0].as_py()
            x = {c: np.concatenate([t["got"](b) for b in group.column(c).to_pylist()]) for c in columns[2:]}
            first = np.concatenate([t["got_key"]([b])[0] for b in group.column("w0").to_pylist()])
            key = [first | x["rest"], *[x[k] for k in keys[1:]]]
            order = np.lexsort((x["read_rank"], *[(k & m[w][x["full"] - x["pos"]]) for w, k in list(enumerate(key))[::-1]]))
            if len(order) != size[g]:
                raise ValueError("a group has other rows than were counted")
            out = []
            for a in range(0, len(order), chunk):
                at = order[a : a + chunk]
                d, full = t["digits"]([k[at] for k in key]), x["full"][at]
                text = t["text_of"](d[np.arange(d.shape[1])[None, :] < full[:, None]], full)
                out.append(pa.table([pa.array(start[g] + a + np.arange(len(at))), pa.array(x["read_rank"][at]), pa.array(x["pos"][at].astype(np.int32)), text], names=["row", "read_rank", "pos", "rotation"]))
            return pa.concat_tables(out)

        kind = ", ".join(f"{c} binary" for c in columns[1:])
        d = self.reads.select("read_rank", "seq").mapInArrow(run, f"__g int, {kind}").repartition(max(1, len(bounds) + 1), "__g")
        return d.groupBy("__g").applyInArrow(met, "row long, read_rank long, pos int, rotation string")


def measured(reads: DataFrame) -> tuple[int, int, int]:
    """Reads, rows of their index, letters of the longest read."""
    r = reads.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("seq") + 1), F.lit(0)).alias("rows"), F.coalesce(F.max(F.length("seq")), F.lit(0)).alias("most")).first()
    return r["n"], r["rows"], r["most"]


def fits(known: tuple[int, int, int]) -> bool:
    return known[2] + 1 <= MOST_WORDS * WIDTH
