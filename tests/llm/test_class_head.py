"""The frequent words of operator 6 are those of a plain sort, without a large sort on the driver."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from readloom.llm import class_lm


@pytest.mark.parametrize("size", [1, 7, 30, 500])
def test_most_frequent(spark, size):
    rng = random.Random(3)
    held = Counter(f"w{int(rng.paretovariate(0.8)) % 60}".encode() for _ in range(400)) + Counter({b"\xff": 3, b"x" * 65: 50, b"x" * 64: 2})
    counts = spark.createDataFrame(list(held.items()), "word binary, n long").repartition(3)
    want = sorted(((w, n) for w, n in held.items() if len(w) <= 64), key=lambda x: (-x[1], x[0]))[:size]
    got = class_lm.most_frequent(counts, size)
    assert list(zip(got.column("word").to_pylist(), got.column("n").to_pylist(), strict=True)) == want
    assert class_lm.most_frequent(counts.limit(0), size).num_rows == 0


def test_head_is_not_collected_as_rows(spark, monkeypatch):
    """The driver gets the head in columns, and no partition's own list of the most frequent words."""
    docs = spark.createDataFrame([(i, f"a b c{i % 5}") for i in range(40)], "doc_id long, text string")
    limit = type(docs).limit
    monkeypatch.setattr(type(docs), "limit", lambda d, n: limit(d, n) if n == 1 else pytest.fail("a limit is merged on the driver"))
    assert class_lm.score(docs, F.col("doc_id") > 3).count() == 40
