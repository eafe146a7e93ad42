"""Any number of languages, rare ones included."""

import random
from collections import Counter

from readloom.llm import langid


def test_more_languages_than_bits_and_rare_ones(spark):
    rng = random.Random(3)
    of = {f"l{i:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)] for i in range(70)}
    text = lambda x: " ".join(rng.choice(of[x]) for _ in range(40))
    # the last language is a five-hundredth of the texts
    rows = [(text(x), x) for x in of for _ in range(4)] + [(text("l00"), "l00") for _ in range(1720)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    langs, table = langid.learn(docs, sample=600)
    assert langs == sorted(of)
    asked = spark.createDataFrame([(text(x), x) for x in of], "text string, lang string")
    got = langid.predict(asked, langs, table, keep=("lang",)).collect()
    assert all(r["lang_pred"] == r["lang"] for r in got)


def test_shares():
    counts = Counter({"a": 100_000, "b": 30_000, "c": 10})
    part = langid.shares(counts, 20_000)
    assert part["c"] == 1.0 and abs(sum(part[x] * counts[x] for x in counts) - 20_000) < 1
    assert set(langid.shares(counts, 200_000).values()) == {1.0}
