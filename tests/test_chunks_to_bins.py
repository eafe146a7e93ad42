"""Bins and runs are cut from the chunks of sorted rows; what is counted in a bin is held for its other points."""

import random

import pytest
from pyspark.sql import functions as F

from readloom.operators import bins, codecs, index, packed


@pytest.fixture
def both(spark, monkeypatch):
    monkeypatch.setattr(packed, "GROUP", 900)
    monkeypatch.setattr(packed, "CHUNK", 700)
    rnd = random.Random(3)
    seqs = ["".join(rnd.choice("AACGNT") for _ in range(40)) for _ in range(110)] + ["", "A"]
    r = index.prepare_reads(spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "seq_id long, seq string"))
    return index.sorted_rows(r, ("sym",)), index.build(r, ("sym",))


def test_bins_of_chunks(both, monkeypatch):
    """F17, F26, F32, F6: the same bins and runs as of rows, without rows."""
    held, rows = both
    want = bins.text_bins(rows).orderBy("bin_id").collect()
    runs = codecs.run_lengths(rows).orderBy("run_id").collect()
    monkeypatch.setattr(packed.Sorted, "rows", None)
    assert bins.text_bins(held).orderBy("bin_id").collect() == want and len(want) == 4
    assert codecs.run_lengths(held).orderBy("run_id").collect() == runs


def test_points_of_held_bins(both, monkeypatch):
    """a bin is made into counts once for all groups of its points."""
    held, _ = both
    monkeypatch.setattr(bins, "HELD", 1)
    text = bins.text_bins(held)
    n = bins.rows_of(text)
    points = held.rows("sym").select("row").unionByName(held.held.sparkSession.createDataFrame([(n,), (n,)], "row long"))
    want = bins.every_fm(text).orderBy("row").collect()
    for x in (text, bins.runs_of(text)):
        got = bins.fm_at(x, points.coalesce(1)).orderBy("row").collect()
        assert got[:-2] == want and got[-1] == got[-2] and got[-1]["fm_t"] == n


def test_size_of_runs(spark):
    """bytes are counted by thresholds, not by lists."""
    sizes = [1, 31, 32, 1023, 1024, 1 << 15, (1 << 35) - 1, 1 << 35, (1 << 60) - 1, 1 << 60]
    d = spark.createDataFrame([("A", n) for n in sizes], "sym string, run_len long")
    assert codecs.compressed_size(d).first()["bytes"] == sum(max(1, -(-n.bit_length() // 5)) for n in sizes)
    assert codecs.compressed_size(d.limit(0)).first()["bytes"] == 0
    assert "transform(" not in codecs.compressed_size(d)._jdf.queryExecution().analyzed().toString()


def test_ends_of_ranges(both):
    """F32: both ends of ranges meet the bins at once."""
    held, rows = both
    text = bins.text_bins(held)
    ranges = rows.sparkSession.createDataFrame([(0, 100), (5, 5), (2047, 2048), (0, 4000)], "l long, h long")
    every = {r["row"]: r for r in bins.every_fm(text).collect()}
    for r in bins.extended(text, ranges).collect():
        assert [list(r[x]) for x in ("lows", "highs")] == [[every[r[x]][f"fm_{s}"] for s in "acgnt"] for x in ("l", "h")]
    assert bins.extended(text, ranges.select("h", "l", F.lit(1).alias("x"))).count() == 4
