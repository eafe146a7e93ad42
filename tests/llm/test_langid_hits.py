"""Hits of the n-gram filters recomputed from sets of n-grams, and the correction for those made by chance."""

import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest

from readloom.llm import langid


def grams(text):
    """Runs of four letters or word ends, lower-cased letter by letter."""
    out = [None]
    for c in text + " ":
        low = c.lower() if unicodedata.category(c)[0] == "L" else None
        if low is not None:
            out.append(low if len(low) == 1 else c)
        elif out[-1] is not None:
            out.append(None)
    return [tuple(out[i : i + 4]) for i in range(len(out) - 3)]


@pytest.mark.parametrize("size", [400_000, 13])
def test_hits_are_those_of_sets(spark, monkeypatch, size):
    monkeypatch.setattr(langid, "SLICE", size)
    rng = random.Random(5)
    of = {x: ["".join(rng.choice(s) for _ in range(rng.randint(2, 6))) for _ in range(25)] for x, s in (("de", "abcdäß"), ("en", "abcdeO"), ("fr", "éèabcI"))}
    rows = [(" ".join(rng.choice(of[x]) for _ in range(rng.randint(5, 30))) + rng.choice([".", "!? 12", ""]), x) for x in of for _ in range(30)]
    rows += [rows[0], (None, "de"), ("", "en"), ("text of no language", None)]
    langs, table = langid.learn(spark.createDataFrame(rows, "text string, lang string"))
    assert langs == ["de", "en", "fr"]
    # a language has an n-gram that it uses three times, and a fifth as often a text as the language that uses it most
    counts, texts = defaultdict(Counter), Counter(x for t, x in rows if t is not None and x)
    for t, x in rows:
        if t and x:
            counts[x].update(grams(t))
    rate = {x: {g: n / texts[x] for g, n in counts[x].items()} for x in langs}
    have = {x: {g for g, n in counts[x].items() if n >= 3 and rate[x][g] >= 0.2 * max(rate[y].get(g, 0) for y in langs)} for x in langs}
    asked = [" ".join(rng.choice(of[rng.choice(langs)]) for _ in range(40)) for _ in range(20)] + [rows[5][0] * 30]
    for t in asked:
        got = np.zeros(3)
        for h in langid.grams(t):
            spots = langid.positions(h)
            found = table[0, spots[0]] & table[0, spots[1]] & table[0, spots[2]]
            got += [np.count_nonzero(found >> i & 1) for i in range(3)]
        assert got.tolist() == [sum(g in have[x] for g in grams(t)) for x in langs]  # so few bits are set that none is by chance
    d = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "doc_id long, text string")
    for r in langid.predict(d, langs, table).collect():
        hits = [sum(g in have[x] for g in grams(asked[r["doc_id"]])) for x in langs]
        assert hits[langs.index(r["lang_pred"])] == max(hits) and abs(r["score"] - max(hits) / sum(hits)) < 1e-3


def test_hits_by_chance_are_taken_off(spark):
    """In a filter that is half full an eighth of all n-grams hit; corrected, a language without own n-grams has next to none."""
    rng = np.random.default_rng(6)
    table = (rng.random((1, 1 << langid.BITS)) < 0.5).astype(np.int64) * 2
    r = random.Random(7)
    text = " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(4000))
    for h in langid.grams(text):
        for p in langid.positions(h):
            table[0, p] |= 1  # the first language has every n-gram
    got = langid.predict(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["all", "chance"], table).first()
    assert got["lang_pred"] == "all" and got["score"] > 0.97


def test_edges(spark):
    d = spark.createDataFrame([("aaa bbb aaa", "x")] * 5, "text string, lang string")
    langs, table = langid.learn(d)
    rows = [(1, None, 9), (2, "", 9), (3, "123 --", 9), (4, "aaa bbb", 9), (4, "aaa bbb", 9), (None, "aaa bbb " * 100_000, 9)]
    asked = spark.createDataFrame(rows, "doc_id long, text string, lang_pred_own int")
    got = sorted(((r["doc_id"], r["lang_pred"], round(r["score"], 6)) for r in langid.predict(asked, langs, table).collect()), key=str)
    assert got == sorted([(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0), (4, "x", 1.0), (4, "x", 1.0), (None, "x", 1.0)], key=str)
    assert langid.predict(asked.limit(0), langs, table).count() == 0
    none, empty = langid.learn(d.limit(0))
    assert none == [] and [r["lang_pred"] for r in langid.predict(asked, none, empty).collect()] == ["und"] * 6
