"""Symbols are gathered into bins by stretches of rows, and only the columns asked for are stored."""

from pyspark.sql import functions as F

from readloom.operators import bins, codecs, index


def test_runs_over_bins(spark, monkeypatch):
    """Runs inside a bin, over an edge, and over whole bins; rows in any order."""
    monkeypatch.setattr(bins, "BIN_BITS", 3)
    text = "A" * 3 + "C" * 30 + "GT" + "A" * 5 + "$" * 8
    d = spark.createDataFrame(list(enumerate(text)), "row long, sym string").repartition(3, F.hash("row"))
    assert {r["bin_id"]: r["syms"] for r in bins.stretches(d).collect()} == {i: text[8 * i : 8 * i + 8] for i in range(6)}
    got = [tuple(r) for r in codecs.run_lengths(d).orderBy("run_id").select("run_id", "row_start", "sym", "run_len").collect()]
    assert got == [(0, 0, "A", 3), (1, 3, "C", 30), (2, 33, "G", 1), (3, 34, "T", 1), (4, 35, "A", 5), (5, 40, "$", 8)]


def test_columns_stored(spark):
    r = index.prepare_reads(spark.createDataFrame([(1, "ACG"), (2, "")], "seq_id long, seq string"))
    assert index.build(r, ("sym",)).orderBy("row").collect() == [(0, "$"), (1, "G"), (2, "$"), (3, "A"), (4, "C")]
