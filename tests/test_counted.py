"""K-mers are counted as numbers where reads are read."""

from collections import Counter

from readloom.functions.dna import clean
from readloom.operators import search
from readloom.plans import catalog
from pyspark.sql import functions as F


def test_counts_of_all_lengths(spark, monkeypatch):
    monkeypatch.setattr(search, "TOGETHER", 30)
    reads = ["", "A", "ACGTNACGTTNNA$", "ACGTNACGTTNNA" * 3, "TTTTTTTTTTTT", "AC|GxTAC", "acé", None]
    d = spark.createDataFrame([(x,) for x in reads], "seq string").repartition(2)
    ks = [1, 3, 7, 8, 21, 22]
    want = Counter(x[i : i + k] for x in reads if x for k in ks for i in range(len(x) - k + 1))
    got = search._every_count(d, ks)
    assert {r["kmer"]: r["cnt"] for r in got.collect()} == dict(want) and got.count() == len(want)
    for k in ks:
        assert {r["kmer"]: r["cnt"] for r in search.kmer_counts(d, k).collect()} == {x: n for x, n in want.items() if len(x) == k}


def test_windows_are_no_rows(spark):
    d = spark.createDataFrame([("ACGT",)], "seq string")
    plan = search.kmer_counts(d, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan


def test_parts_of_texts(spark):
    texts = [(1, "a c\ng|N" + "t" * 80), (2, None), (3, ""), (4, "éüß"), (5, "A" * 40), (6, "xyzé acgnt ÀCΓ" * 20)]
    d = spark.createDataFrame(texts, "i long, t string")
    got = {}
    for r in catalog._cut(d, F.col("i"), F.col("t"), F.lit(0)).orderBy("seq_id", "part").collect():
        assert r["part"] == len(got.setdefault(r["seq_id"], [])) and r["file_id"] == 0
        got[r["seq_id"]].append(r["seq"])
    whole = {r["i"]: r["s"] for r in d.select("i", clean(F.coalesce("t", F.lit(""))).alias("s")).collect()}
    assert got == {i: [s[a : a + 40] for a in range(0, max(1, len(s)), 40)] for i, s in whole.items()}
