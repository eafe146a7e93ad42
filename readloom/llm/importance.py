"""Resampling towards a target distribution: hashed n-gram counts of corpus and target, gains, scores, the best kept.

Features are runs of one to three words. Each block of texts has its dictionary of distinct words and distinct features with
their counts; a feature is hashed once for it, and counts are added up by hash bucket in the block, then in Spark. The gains of the buckets
(a fixed number of rows) go back to the blocks, whose dictionaries give each document the sum over its features. No feature
string leaves its block: the README has the figures of one dictionary for all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import materialize
from readloom.plans.ranking import ranked

BUCKETS, WIDTH = 10_000, 3
#: Words of a block, whose dictionary a worker holds, and bits of a word's number in it.
BLOCK, ID_BITS = 1 << 18, 21
LEAST_WORDS, PERCENT, SEED = 20, 5, 42
#: Bytes of words: digits, lower-case letters and all beyond ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def _words(text: bytes, size: int) -> Iterator[list[bytes]]:
    """The words of a text, ``size`` at a time, each part but the first after the WIDTH - 1 last words of the one before."""
    text = text.lower()  # of bytes: A-Z only
    if len(text) <= 2 * size:  # no more than ``size`` words
        yield _WORD.findall(text)
        return
    part: list[bytes] = []
    for m in _WORD.finditer(text):
        part.append(m[0])
        if len(part) == size + WIDTH - 1:
            yield part
            part = part[1 - WIDTH :]
    yield part


def _blocks(texts: list[bytes | None], size: int) -> Iterator[list[tuple[int, int, list[bytes]]]]:
    """(text, words known from the part before, words) of parts of texts, about ``size`` words together."""
    held, n = [], 0
    for i, text in enumerate(texts):
        for j, words in enumerate(_words(text or b"", size)):
            held.append((i, WIDTH - 1 if j else 0, words))
            n += len(words)
            if n >= size:
                yield held
                held, n = [], 0
    if held:
        yield held


def _dictionary(block: list[tuple[int, int, list[bytes]]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For features of 1, 2, ... WIDTH words: the hash of each distinct feature, and, for every occurrence, which it is and in which part.

    A feature is the numbers of its words in the block, packed, so features are told apart exactly. Its hash goes on from that
    of the feature without its last word. Occurrences within the words known from the part before are left out.
    """
    words = [w for _, _, ws in block for w in ws]
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    names = list(ids)
    code = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    sizes = np.array([len(ws) for _, _, ws in block])
    part = np.repeat(np.arange(len(block)), sizes)
    at = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    new = at >= np.repeat([k for _, k, _ in block], sizes)
    hashes = np.fromiter(map(crc32, names), np.int64, len(names))
    yield hashes, code[new], part[new]
    # ``keys`` are the distinct features of n - 1 words, ``longer`` those of each place
    keys, longer = np.arange(len(names)), code
    for n in range(2, WIDTH + 1):
        there = part[n - 1 :] == part[: 1 - n]
        spaced = np.fromiter((crc32(b" ", h) for h in hashes.tolist()), np.int64, len(hashes))
        whole = longer[: len(there)] << ID_BITS | code[n - 1 :]
        before, (distinct, which) = keys, np.unique(whole[there], return_inverse=True)
        last = map(names.__getitem__, (distinct & (1 << ID_BITS) - 1).tolist())
        hashes = np.fromiter(map(crc32, last, spaced[np.searchsorted(before, distinct >> ID_BITS)].tolist()), np.int64, len(distinct))
        fresh = new[n - 1 :][there]
        yield hashes, which[fresh], part[n - 1 :][there][fresh]
        keys, longer = distinct, whole


def bucket_counts(texts: DataFrame, text: str = "text", block: int = BLOCK) -> DataFrame:
    """(bucket, n): occurrences of features by the CRC-32 of their bytes, of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for held in _blocks(batch.column("t").cast(pa.binary()).to_pylist(), block):
                for hashes, which, _ in _dictionary(held):
                    n = np.bincount(which, minlength=len(hashes))
                    np.add.at(total, hashes % BUCKETS, n)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return texts.select(F.col(text).alias("t")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame) -> DataFrame:
    """(bucket, gain): floor of 1000 times the log ratio of the smoothed shares in target and corpus. BUCKETS rows."""
    spark = corpus.sparkSession
    every = spark.range(BUCKETS).select(F.col("id").alias("bucket"))
    d = every.join(corpus.select("bucket", F.col("n").alias("s")), "bucket", "left").join(target.select("bucket", F.col("n").alias("t")), "bucket", "left").fillna(0, ["s", "t"])
    d = materialize(d)
    sums = d.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    x = {c: F.col(c).cast("double") for c in ("s", "t", "all_s", "all_t")}
    ratio = (x["t"] + 1) * (x["all_s"] + BUCKETS) / ((x["s"] + 1) * (x["all_t"] + BUCKETS))
    return d.crossJoin(F.broadcast(sums)).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))  # one row


def weighed(docs: DataFrame, gain: DataFrame, text: str = "text", block: int = BLOCK) -> DataFrame:
    """``docs`` without the text but with n_words, n_features and weight, the sum of the gains of its features (long)."""
    table = np.zeros(BUCKETS, np.int64)
    for r in gain.collect():  # BUCKETS rows
        table[r["bucket"]] = r["gain"]
    sent = docs.sparkSession.sparkContext.broadcast(table)
    keep = [c for c in docs.columns if c != text]
    d = docs.select(*keep, F.col(text).alias("__t"))
    added = "n_words long, n_features long, weight long"
    schema = f"{docs.select(*keep).schema.toDDL()}, {added}" if keep else added

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for held in _blocks(batch.column("__t").cast(pa.binary()).to_pylist(), block):
                of = np.array([i for i, _, _ in held])
                np.add.at(out[0], of, [len(ws) - known for _, known, ws in held])
                for hashes, which, part in _dictionary(held):
                    own = sent.value[hashes % BUCKETS][which]
                    ends = np.concatenate([[0], np.cumsum(own)])
                    upto = np.searchsorted(part, np.arange(len(held) + 1))
                    np.add.at(out[1], of, np.diff(upto))
                    np.add.at(out[2], of, np.diff(ends[upto]))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(x) for x in out], [*keep, "n_words", "n_features", "weight"])

    return d.mapInArrow(run, schema)


def _noise(ident: Column, seed: int) -> Column:
    """1000 times a Gumbel value, floored, drawn by the hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, text: str = "text", ident: str = "doc_id", percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """``docs`` without the text but with n_words, n_features, weight, score and rank (long): the best ``percent`` of the documents
    with ``least`` words or more are drawn, by score, ties to smaller ids; the others have a null rank.

    weight is the sum of gains towards the texts of ``target``; score adds Gumbel noise, so drawing the best is sampling
    without replacement. Null texts have no words; null ids count as empty in the hash and come last among ties. Rows alike
    in score and id have ranks of their own. An empty target gives gains by the smoothing alone; an empty table gives no
    rows. Columns of the names added are replaced, others stay. Texts of any length are read whole.
    """
    docs = docs.drop("n_words", "n_features", "weight", "score", "rank")
    gain = gains(materialize(bucket_counts(docs, text, block)), materialize(bucket_counts(target, text, block)))
    d = materialize(weighed(docs, gain, text, block).withColumn("score", F.col("weight") + _noise(F.col(ident), seed)))
    drawn = d.filter(F.col("n_words") >= least).count() * percent // 100
    place = ranked(d.filter(F.col("n_words") >= least), [F.col("score").desc(), F.col(ident).asc_nulls_last()], "__place")
    place = place.withColumn("rank", F.when(F.col("__place") < drawn, F.col("__place") + 1)).drop("__place")
    return place.unionByName(d.filter(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long")))
