"""Language identification with language-bitmask n-gram filters.

All languages share one Bloom filter whose every position holds a mask with a bit a language (bit-sliced), in as many
words of 63 bits as the languages need: the masks at an n-gram's positions, and-ed, name all languages that have it. A text's hits a language, less those that the filter's
fill makes by chance, decide.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM, HASHES, BITS = 4, 3, 20
#: Labelled texts that are learned from: about so many, chosen by a hash of the text; all, if there are fewer. Each
#: language gives as many as any other, or all that it has.
SAMPLE = 20_000
#: A language has an n-gram that it uses at least LEAST times in the sample, and RATIO times as often as the language that uses it most.
LEAST, RATIO = 3, 0.2
#: Languages in a word of a mask.
WORD_BITS = 63
SLICE = 400_000


@cache
def _letters() -> np.ndarray:
    """For each code point its lower case if it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if unicodedata.category(x := chr(c))[0] == "L":
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(text: str | None) -> Iterator[np.ndarray]:
    """64-bit hashes of the runs of GRAM letters or word ends of a whole text, slice by slice."""
    if not text:
        return
    table, tail = _letters(), np.zeros(1, np.uint32)
    for at in range(0, len(text), SLICE):
        x = table[np.frombuffer(text[at : at + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)]
        x = np.concatenate([tail, x] if at + SLICE < len(text) else [tail, x, np.zeros(1, np.uint32)])
        x = x[np.concatenate([[True], (x[1:] != 0) | (x[:-1] != 0)])].astype(np.uint64)
        n = len(x) - GRAM + 1
        if n > 0:
            h = np.zeros(n, np.uint64)
            for k in range(GRAM):
                h = (h ^ x[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            yield h
        elif at + SLICE >= len(text) and len(x) == GRAM - 1 and x.any():
            yield (x[:1] * np.uint64(31) + x[1:2]) * np.uint64(0x9E3779B97F4A7C15)
        tail = x[-(GRAM - 1) :].astype(np.uint32)


def positions(h: np.ndarray) -> list[np.ndarray]:
    mask = np.uint64((1 << BITS) - 1)
    return [(h >> np.uint64(s)) & mask for s in (0, 21, 43)][:HASHES]


def shares(counts: dict, sample: int) -> dict:
    """The part of each language's texts that is learned from: at most as many of each that about ``sample`` are."""
    left, level = sample, 0
    for i, n in enumerate(sorted(counts.values())):
        level = left / (len(counts) - i)
        if n > level:
            break
        left, level = left - n, n
    return {x: min(1.0, level / n) for x, n in counts.items()}


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """The languages and the filter's masks (words x positions), from the rows of ``docs`` with a text and a language."""
    known = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    langs = sorted(counts)
    if not langs:
        return [], np.zeros((1, 1 << BITS), np.int64)
    part = shares(counts, sample)
    codes = docs.sparkSession.createDataFrame([(x, i, int(1_000_003 * part[x]), max(1.0, counts[x] * part[x])) for i, x in enumerate(langs)], f"lang {known.schema['lang'].dataType.simpleString()}, code int, below int, size double")
    chosen = known.join(F.broadcast(codes), "lang").filter(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < F.col("below")).select("text", "code")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, list[np.ndarray]] = {}
            for t, i in zip(batch.column("text").to_pylist(), batch.column("code").to_pylist(), strict=True):
                found.setdefault(i, []).extend(grams(t))
            for i, hs in found.items():
                if hs:
                    g, n = np.unique(np.concatenate(hs), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), i, np.int32)), pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], ["code", "gram", "n"])

    each = chosen.mapInArrow(count, "code int, gram long, n long").groupBy("code", "gram").agg(F.sum("n").alias("n"))
    rated = each.join(F.broadcast(codes.select("code", "size")), "code").withColumn("rate", F.col("n") / F.col("size"))
    top = rated.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("code", "n", "rate")).alias("in"))
    have = top.select("gram", F.explode(F.filter("in", lambda x: (x["n"] >= LEAST) & (x["rate"] >= RATIO * F.col("top")))).alias("x"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("x.code") % WORD_BITS).cast("int"))
    masks = have.groupBy("gram", F.floor(F.col("x.code") / WORD_BITS).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    mask = (1 << BITS) - 1
    at = F.array(*[F.shiftrightunsigned("gram", s).bitwiseAND(F.lit(mask).cast("long")) for s in (0, 21, 43)][:HASHES])
    spots = masks.select("word", "bits", F.explode(at).alias("at")).groupBy("word", "at").agg(F.bit_or("bits").alias("bits"))
    table = np.zeros((-(-len(langs) // WORD_BITS), 1 << BITS), np.int64)
    got = spots.toPandas()  # at most 2^BITS rows a word
    table[got["word"].to_numpy(np.int64), got["at"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return langs, table


def predict(docs: DataFrame, langs: list[str], table: np.ndarray, text: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of every row, lang_pred and score (0 to 1).

    A text that is null or has no letter is ``und`` with score 0, as is every text where no language was learned. Ties
    go to the language first in order. Whole texts are read, in slices.
    """
    held = docs.sparkSession.sparkContext.broadcast(table)  # 2^BITS masks
    place = [divmod(i, WORD_BITS) for i in range(len(langs))]
    chance = [float(((table[w] >> i) & 1).mean()) ** HASHES for w, i in place]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = held.value
        for batch in batches:
            names, scores = [], []
            for t in batch.column("__text").to_pylist():
                n, hits = 0, np.zeros(len(langs))
                for h in grams(t):
                    first, *more = positions(h)
                    found = masks[:, first]
                    for p in more:
                        found = found & masks[:, p]
                    n += len(h)
                    hits += [np.count_nonzero(found[w] & (1 << i)) for w, i in place]
                if n == 0 or not langs:
                    names.append("und")
                    scores.append(0.0)
                    continue
                own = np.array([max(0.0, (x - n * c) / (1 - c)) if c < 1 else 0.0 for x, c in zip(hits, chance, strict=True)])
                best = int(own.argmax())
                names.append(langs[best])
                scores.append(float(own[best] / own.sum()) if own.sum() > 0 else 1.0 / len(langs))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, f"{schema}, lang_pred string, score double")
