"""Lexical retrieval packing.

Documents are tokenised, laid out by a similarity hash of their tf-idf weights and cut into shards. Each shard holds
an inverted index with BM25 scores; its terms are token ids, so the global document frequencies are one bounded table.
A window starts with a seed document; the unused neighbours that the index returns for it fill the window greedily,
best first. The document that overflows is cut there and its rest seeds the next window.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import materialize
from readloom.llm.tokens import encoder

WINDOW = 2048
#: Documents that one inverted index holds, about; twice as many, or so many ids, at most (one longer document is a shard of its own).
SHARD_DOCS = 2048
SHARD_IDS = 1 << 22
#: Bytes of ids in a partition, which may hold many shards.
PARTITION = 256 << 20
K1, B = 1.2, 0.75
HASH_BITS = 32
#: A term in one of so many documents of a shard, or in more, is scored by matrix products; the others by postings.
COMMON = 8
BLOCK = 256


def id_type(path: str, end_id: int) -> str:
    """The narrowest unsigned type for the ids of a tokenizers file."""
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    top = max([end_id, *j["model"]["vocab"].values(), *[x["id"] for x in j["added_tokens"]]])
    return "<u2" if top < 1 << 16 else "<u4"


def binaries(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """An Arrow column of binaries: ``values`` cut into ``sizes``."""
    offsets = np.concatenate([[0], np.cumsum(sizes * values.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(values, sizes) of a column of binaries without nulls."""
    if not len(column):
        return np.zeros(0, kind), np.zeros(0, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind), np.diff(at) // np.dtype(kind).itemsize


def tokenized(docs: DataFrame, path: str, end_id: int, kind: str) -> DataFrame:
    """(ident, ids binary) of (ident, text)."""
    own = docs.schema["ident"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            done = 0
            for ids, sizes in coder.encode([t or b"" for t in batch.column("text").to_pylist()], end_id):
                yield pa.RecordBatch.from_arrays([batch.column("ident").slice(done, len(sizes)), binaries(ids.astype(kind), sizes)], ["ident", "ids"])
                done += len(sizes)

    return docs.select("ident", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"ident {own}, ids binary")


def terms_of(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms, their counts, where each document's begin) of documents of at least one id."""
    v = values.copy()
    ends = np.cumsum(sizes)
    for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
        v[a:b].sort()
    new = np.empty(len(v), bool)
    np.not_equal(v[1:], v[:-1], out=new[1:])
    new[ends - sizes] = True
    at = np.flatnonzero(new)
    return v[at], np.diff(at, append=len(v)), np.searchsorted(at, ends - sizes)


def parts(values: np.ndarray, sizes: np.ndarray, held: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(values, sizes) of runs of documents of about ``held`` ids."""
    ends = np.cumsum(sizes)
    a = start = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, start + held)))
        yield values[start : ends[b - 1]], sizes[a:b]
        a, start = b, int(ends[b - 1])


def frequencies(tokens: DataFrame, kind: str) -> tuple[np.ndarray, int, float]:
    """Documents that hold each id, number of documents and mean length. The vocabulary bounds the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, words = np.zeros(0, np.int64), 0, 0
        for batch in batches:
            for values, sizes in parts(*flat(batch.column("ids"), kind)):
                n, words = n + len(sizes), words + len(values)
                seen = np.bincount(terms_of(values, sizes)[0], minlength=len(held))
                seen[: len(held)] += held
                held = seen
        at = np.nonzero(held)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, [-1, -2]])), pa.array(np.concatenate([held[at], [n, words]]))], ["id", "n"])

    got = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    by = dict(zip(got["id"].tolist(), got["n"].tolist(), strict=True))
    n, words = by.pop(-1, 0), by.pop(-2, 0)
    df = np.zeros(max(by, default=0) + 1, np.float64)
    df[list(by)] = list(by.values())
    return df, n, words / max(1, n)


def weights(df: np.ndarray, n: int) -> np.ndarray:
    """The BM25 idf of ids that ``df`` of ``n`` documents hold; above 0 for all."""
    return np.log(1 + (n - df + 0.5) / (df + 0.5)) if n else np.zeros(1)


def _signs(terms: int) -> np.ndarray:
    return np.random.default_rng(11).choice(np.array([-1, 1], np.float32), (terms, HASH_BITS))


def layout(tokens: DataFrame, idf: np.ndarray, kind: str) -> DataFrame:
    """Adds ``place``, a similarity hash: texts of like tf-idf weights share leading bits."""
    sent = tokens.sparkSession.sparkContext.broadcast(idf.astype(np.float32))
    own = tokens.schema["ident"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = sent.value
        signs = _signs(len(weight))
        for batch in batches:
            out = []
            for values, sizes in parts(*flat(batch.column("ids"), kind), held=1 << 18):
                terms, n, starts = terms_of(values, sizes)
                w = weight[terms] * np.log1p(n.astype(np.float32))
                bits = np.packbits(np.add.reduceat(signs[terms] * w[:, None], starts, axis=0) > 0, axis=1)
                out.append(bits.view(">u4")[:, 0].astype(np.int64))
            places = np.concatenate(out) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("ident"), batch.column("ids"), pa.array(places)], ["ident", "ids", "place"])

    return tokens.mapInArrow(run, f"ident {own}, ids binary, place long")


class Index:
    """BM25 over the documents of a shard: postings of rare terms, a matrix of the common ones."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray, idf: np.ndarray, mean: float) -> None:
        terms, counts, starts = terms_of(values, sizes)
        self.n = n = len(sizes)
        owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(starts, append=len(terms)))
        w = (idf[terms] * counts * (K1 + 1) / (counts + K1 * (1 - B + B * sizes[owner] / mean))).astype(np.float32)
        df = np.bincount(terms)
        common = df * COMMON >= n
        column = np.cumsum(common) - 1
        own = common[terms]
        self.matrix = np.zeros((n, int(common.sum())), np.float32)
        self.matrix[owner[own], column[terms[own]]] = w[own]
        rest = ~own
        rare, owner, w = terms[rest], owner[rest], w[rest]
        order = np.argsort(rare, kind="stable")
        self.docs, self.weights = owner[order], w[order]
        self.ends = np.cumsum(np.where(common, 0, df))
        self.starts = self.ends - np.where(common, 0, df)
        self.rare, self.own = rare, np.searchsorted(owner, np.arange(n + 1))
        self.blocks: dict[int, np.ndarray] = {}

    def scores(self, doc: int) -> np.ndarray:
        block, at = divmod(doc, BLOCK)
        if block not in self.blocks:
            rows = self.matrix[block * BLOCK : (block + 1) * BLOCK]
            self.blocks[block] = (rows > 0).astype(np.float32) @ self.matrix.T
        terms = self.rare[self.own[doc] : self.own[doc + 1]]
        start, size = self.starts[terms], self.ends[terms] - self.starts[terms]
        upto = np.cumsum(size)
        where = np.arange(int(size.sum())) + np.repeat(start - upto + size, size)
        return self.blocks[block][at] + np.bincount(self.docs[where], self.weights[where], self.n)


def fill(values: np.ndarray, sizes: np.ndarray, idf: np.ndarray, mean: float, window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of the pieces of one shard.

    All sequences but the last are full; the last is cut into powers of two, which need no padding.
    """
    index, n = Index(values, sizes, idf, mean), len(sizes)
    used = np.zeros(n, bool)
    seq = held = first = 0
    scores: np.ndarray | None = None
    pieces: list[tuple[int, int, int, int, int]] = []
    long = sizes.tolist()

    def put(doc: int) -> bool:
        """Lay out a whole document; whether a new window has begun with its rest."""
        nonlocal seq, held
        start, size, turned = 0, long[doc], False
        while start < size:
            part = min(size - start, window - held)
            pieces.append((doc, start, part, seq, held))
            start, held = start + part, held + part
            if held == window:
                seq, held, turned = seq + 1, 0, True
        return turned

    while True:
        if scores is None:
            while first < n and used[first]:
                first += 1
            if first == n:
                break
            doc = first
        else:
            doc = int(scores.argmax())
            scores[doc] = -1.0
        used[doc] = True
        begun = held == 0
        turned = put(doc)
        if begun or (turned and held) or scores is None or scores.max() <= 0:
            scores = index.scores(doc)
            scores[used] = -1.0
            if scores.max() <= 0:
                scores = None  # no unused neighbour
    full = [p for p in pieces if p[3] < seq]
    yield from full
    last, cut, at = [p for p in pieces if p[3] == seq], held, 0
    number, room, offset = seq, 0, 0
    for doc, start, size, _, _ in last:
        while size:
            if room == offset:
                if at:
                    number += 1
                room, offset = 1 << (cut.bit_length() - 1), 0
                cut -= room
                at = 1
            part = min(size, room - offset)
            yield doc, start, part, number, offset
            start, size, offset = start + part, size - part, offset + part


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = 1, text: str = "text", ident: str = "doc_id", shard_docs: int = SHARD_DOCS) -> DataFrame:
    """(ident, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row a piece; each id lies in one piece.

    Null texts are empty: their only id is ``end_id``. Each row of ``docs`` is a document of its own, repeated or not;
    a null ident stays null. Sequences are ``window`` ids long but for the last few of a shard, which are powers of two.
    A text of any length is tokenised in parts and laid over as many windows as it needs. An empty table gives no rows;
    other columns are left out, whatever their names.
    """
    spark = docs.sparkSession
    kind = id_type(tokenizer_path, end_id)
    tokens = materialize(tokenized(docs.select(F.col(ident).alias("ident"), F.col(text).alias("text")), tokenizer_path, end_id, kind))
    df, n, mean = frequencies(tokens, kind)
    idf = weights(df, n)
    own = tokens.schema["ident"].dataType.simpleString()
    sent = spark.sparkContext.broadcast(idf)
    placed = layout(tokens, idf, kind)
    least = int(n * mean * np.dtype(kind).itemsize) // PARTITION + 1
    dealt = max(least, min(-(-n // shard_docs), 4 * spark.sparkContext.defaultParallelism), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        weight, base = sent.value, TaskContext.get().partitionId() << 40
        done = docs_held = ids_held = 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            nonlocal done, docs_held, ids_held
            values, sizes = np.concatenate([v for _, v, _ in held]), np.concatenate([s for _, _, s in held])
            doc, start, length, seq, offset = np.array(list(fill(values, sizes, weight, mean, window)), np.int64).T
            begin = (np.cumsum(sizes) - sizes)[doc] + start
            crc = [zlib.crc32(values[a:b].astype("<u4").tobytes()) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
            whose = pa.concat_arrays([i for i, _, _ in held]).take(pa.array(doc))
            columns = [whose, *(pa.array(np.ascontiguousarray(x)) for x in (start, length)), pa.array(crc, pa.int64()), *(pa.array(x) for x in (sizes[doc], seq + base + done, np.ascontiguousarray(offset)))]
            done += int(seq.max()) + 1
            held.clear()
            docs_held = ids_held = 0
            return pa.RecordBatch.from_arrays(columns, ["ident", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            values, sizes = flat(batch.column("ids"), kind)
            ends, a = np.cumsum(sizes), 0
            while a < len(sizes):
                begin = int(ends[a] - sizes[a])
                b = min(int(np.searchsorted(ends, begin + SHARD_IDS - ids_held, "right")), a + 2 * shard_docs - docs_held)
                if b <= a and not held:
                    b = a + 1  # longer than a shard
                if b > a:
                    held.append((batch.column("ident").slice(a, b - a), values[begin : int(ends[b - 1])], sizes[a:b]))
                    docs_held, ids_held = docs_held + b - a, ids_held + int(ends[b - 1]) - begin
                if b < len(sizes):
                    yield out()
                a = b
        if held:
            yield out()

    pieces = placed.repartitionByRange(dealt, "place", F.xxhash64("ident", "ids")).sortWithinPartitions("place").mapInArrow(
        run, f"ident {own}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
    return pieces.withColumnRenamed("ident", ident)
