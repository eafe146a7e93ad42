"""Operators 11 to 13 against brute force on small tables: nulls, blanks, ties, repeated rows, long texts, clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.llm import exact_dedup, importance, spelling

BLANK = re.compile("[\x20\x09-\x0d]+")


# ---- exact deduplication


def _same(text):
    return BLANK.sub(" ", text or "")


def _by_text(rows):
    groups = defaultdict(list)
    for i, (ident, text) in enumerate(rows):
        groups[_same(text)].append((ident is None, ident or 0, i))
    return groups


def test_exact_groups(spark):
    rng = random.Random(1)
    base = ["a b", "a\t\n b", " a b", "", None, " ", "\n\t", "a b ", "ä\xa0b", "ä b", "x" * 200_000, "x" * 199_999 + "y", "p" * 70 + "1", "p" * 70 + "2"]
    rows = [(i, rng.choice(base)) for i in range(120)] + [(None, "a b"), (None, "only here"), (3, "twice"), (3, "twice"), (2, "twice")]
    rng.shuffle(rows)
    d = spark.createDataFrame([(i, t, "own") for i, t in rows], "doc_id long, text string, kept string").repartition(5)
    got = exact_dedup.mark(d, digests=True).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "text", "keep_id", "group_size", "kept", "text_sha256"}
    groups = _by_text(rows)
    stays = Counter()
    for r in got:
        g = groups[_same(r["text"])]
        assert r["group_size"] == len(g) and r["text_sha256"] == hashlib.sha256(_same(r["text"]).encode()).hexdigest()
        assert r["keep_id"] == (min(g)[1] if not min(g)[0] else None)
        stays[_same(r["text"])] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(stays.values()) == {1} and len(stays) == len(groups)


def test_exact_whole_texts_beyond_the_prefix_and_unique_ones_unhashed(spark):
    head = "w " * 400
    d = spark.createDataFrame([(1, head + "a"), (2, head + "b"), (3, head + "a"), (4, "alone"), (5, "alone, longer")], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["kept"], r["text_sha256"] is None) for r in exact_dedup.mark(d).collect()}
    assert got == {1: (1, True, False), 2: (2, True, False), 3: (1, False, False), 4: (4, True, True), 5: (5, True, True)}


def test_exact_deduplicate_keeps_columns(spark):
    d = spark.createDataFrame([(1, "a", 7, "x"), (1, "a", 7, "x"), (2, " ", 8, None), (4, None, 9, "z")], "doc_id long, text string, keep_id int, __several string")
    got = sorted(map(tuple, exact_dedup.deduplicate(d.drop("__several")).collect()))
    assert got == [(1, "a", 7), (2, " ", 8), (4, None, 9)]
    empty = d.limit(0).drop("__several")
    assert exact_dedup.deduplicate(empty).columns == ["doc_id", "text", "keep_id"] and exact_dedup.mark(empty).count() == 0


def test_exact_hot_group(spark, monkeypatch):
    """A group of a third of all rows is dealt over several tasks and loses none."""
    from readloom.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 50)
    d = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same text")).otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.mark(d, with_text=False)
    assert got.filter("keep_id = 0 and group_size = 300").count() == 300 and got.filter("kept").count() == 601


# ---- importance resampling


def _features(text):
    ws = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return ws, [" ".join(ws[i : i + n]) for n in (1, 2, 3) for i in range(len(ws) - n + 1)]


def _resampled(docs, target, percent=5, least=20):
    bucket = lambda f: crc32(f.encode()) % 10_000
    s, t = (Counter(bucket(f) for x in texts for f in _features(x)[1]) for texts in ([x for _, x in docs], target))
    ss, tt = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ss + 10_000) / ((s[b] + 1) * (tt + 10_000)))) for b in range(10_000)}
    rows = []
    for ident, text in docs:
        ws, fs = _features(text)
        h = int(hashlib.sha256(f"42:{'' if ident is None else ident}".encode()).hexdigest()[:8], 16)
        w = sum(gain[bucket(f)] for f in fs)
        rows.append((ident, len(ws), len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {id(r): i + 1 for i, r in enumerate(able[: len(able) * percent // 100])}
    key = lambda r: tuple((x is None, x or 0) for x in r)
    return sorted(((*r, rank.get(id(r))) for r in rows), key=key), key


@pytest.mark.parametrize("block", [1 << 17, 7])
def test_importance_is_brute_force(spark, block):
    """Also with blocks so small that a text has several, whose features across their borders count once."""
    rng = random.Random(3)
    pool = ["Alpha", "beta", "ÄÖ", "x1", "don't", "naïve", "日本", "z", "Q9"]
    docs = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))) for i in range(90)]
    docs += [(200, None), (201, ""), (202, "--- ..."), (None, "beta " * 25), (5, "beta z " * 15), (203, "alpha, beta;z\n" * 3000)]
    target = ["beta beta z", None, "日本 x1 x1 x1", "ÄÖ äö"]
    d = spark.createDataFrame([(i, x, 1.0) for i, x in docs], "doc_id long, text string, score double").repartition(3)
    out = importance.resample(d, spark.createDataFrame([(x,) for x in target], "text string"), percent=20, block=block)
    want, key = _resampled(docs, target, 20)
    got = sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_features", "weight", "score", "rank")) for r in out.collect()), key=key)
    assert got == want and out.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]


def test_importance_parts_of_a_text():
    """Parts of a text have each of its features once, wherever the text is cut."""
    text = b"a b c a b c d e f a b"
    want = Counter(crc32(f.encode()) for f in _features(text.decode())[1])
    for n in range(3, 12):
        got, words = Counter(), 0
        for held in importance._blocks([text, None, b"", text], n):
            words += sum(len(ws) - known for _, known, ws in held)
            for hashes, which, part in importance._dictionary(held):
                assert len(which) == len(part) and (np.diff(part) >= 0).all()
                got.update(hashes[which].tolist())
        assert got == want + want and words == 22, n


def test_importance_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, none).count() == 0
    one = spark.createDataFrame([(1, "w " * 30)], "doc_id long, text string")
    assert importance.resample(one, none, percent=100).first()["rank"] == 1


# ---- spelling variants


def _near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _variants(counts):
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    out, form = {}, {}
    for w, n in counts.items():
        near = [x for x in counts if _near(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * n else None
        out[w] = [form[w], None, n, len(near), counts[form[w]] if form[w] else None]
    for w in out:
        r = w
        while form[r]:
            r = form[r]
        out[w][1] = r
    return {(w, *v) for w, v in out.items()}


def test_spelling_is_brute_force(spark):
    rng = random.Random(8)
    letters = "abcéßÀ"
    words = Counter()
    for _ in range(60):
        w = "".join(rng.choice(letters) for _ in range(rng.randint(6, 10)))
        for _ in range(25):
            v, i = list(w), rng.randrange(len(w))
            kind = rng.choice("idrr ")
            if kind == "i":
                v.insert(i, rng.choice(letters))
            elif kind == "d":
                del v[i]
            elif kind == "r":
                v[i] = rng.choice(letters)
            words["".join(v)] += rng.choice([1, 2, 2, 3, 30, 400])
    words |= Counter({"aaaaaaa": 5, "aaaaaaaa": 60, "aaaaaaaaa": 700, "abababab": 2, "babababa": 2, "ababababa": 2, "l" * 5000: 2, "l" * 4999 + "m": 40})
    d = spark.createDataFrame([(w, n) for w, n in words.items()], "word string, n int").select("word", F.explode(F.sequence(F.lit(1), "n")).alias("k"))
    got = {tuple(r) for r in spelling.variants(d.unionByName(spark.createDataFrame([(None, 1)], "word string, k int"))).collect()}
    want = _variants(words)
    assert got == want and sum(x[4] for x in want) > 100 and any(x[2] != x[1] for x in want if x[1])


def test_spelling_query_on_texts(spark, tmp_path):
    """Runs of letters, lower-casing of A-Z alone, a letter lost by hash; null and empty texts, repeated rows."""
    from readloom.llm import queries

    rng = random.Random(4)
    pool = ["Äpfelbaum", "äpfelbaum", "receive", "RECEIVED", "recieved", "weather", "wheather", "O'Hara", "naïveté", "straße12straßen"]
    rows = [(i % 300, " ".join(rng.choice(pool) for _ in range(25)) + ("—" if i % 2 else "")) for i in range(330)] + [(900, None), (901, ""), (902, "1 2 3")]
    spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, word string").write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    got = {tuple(r) for r in queries.op13_spelling(spark, str(tmp_path)).collect()}
    assert got == _variants(counts) and any(x[1] for x in got)


def test_spelling_of_nothing(spark):
    assert spelling.variants(spark.createDataFrame([], "word string")).count() == 0
    # a root three forms away
    chain = {"aaaaaaaa": 2, "baaaaaaa": 20, "bbaaaaaa": 200, "bbbaaaaa": 2000}
    d = spark.createDataFrame(list(chain.items()), "word string, n int").select("word", F.explode(F.sequence(F.lit(1), "n")))
    assert {r["word"]: r["root"] for r in spelling.variants(d).collect()} == dict.fromkeys(chain, "bbbaaaaa")
