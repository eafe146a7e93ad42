"""Short reads sorted as packed keys give what sorting their suffixes as strings gives."""

import random

import pytest
from pyspark.sql import functions as F

from readloom.operators import bins, codecs, doubling, index, packed


@pytest.fixture
def few(spark, monkeypatch):
    monkeypatch.setattr(packed, "GROUP", 300)
    monkeypatch.setattr(packed, "CHUNK", 64)
    monkeypatch.setattr(packed, "PIECE", 42 * 30)
    rnd = random.Random(4)
    text = lambda n: "".join(rnd.choice("AACGNT") for _ in range(n))
    base = [text(40) for _ in range(15)] + [text(rnd.randrange(6)) for _ in range(25)] + ["", "A", "AA", "AAA", "TATA", "TA"]
    seqs = base + base[:9] + [x[:20] + text(20) for x in base[:6]] + [x + y for x in base[20:24] for y in base[24:27]]
    make = lambda part: index.prepare_reads(spark.createDataFrame([(i, s) for i, s in enumerate(part)], "seq_id long, seq string"))
    return make(seqs), make(seqs[::3] + ["TATA", "GGG"])


def _by_strings(monkeypatch):
    monkeypatch.setattr(packed, "MOST_WORDS", 0)


def test_build(few, monkeypatch):
    columns = ("read_rank", "pos", "suffix", "sym")
    got = index.build(few[0], columns).orderBy("row").collect()
    _by_strings(monkeypatch)
    assert got == index.build(few[0], columns).orderBy("row").collect() and len(got) > 900


@pytest.mark.parametrize("cap", [6, 255])
def test_lcp_without(few, monkeypatch, cap):
    r = few[0].withColumn("gone", F.col("read_rank") % 3 == 0)
    got = [index.lcp_of(r, cap, gone).orderBy("row").collect() for gone in (None, "gone")]
    _by_strings(monkeypatch)
    assert got == [index.lcp_of(r, cap, gone).orderBy("row").collect() for gone in (None, "gone")]


def test_rows_left(few, monkeypatch):
    r = few[0].withColumn("gone", F.col("read_rank") % 3 == 0)
    got = index.rows_left(r, "gone", ("seq_id", "pos", "sym")).orderBy("row").collect()
    _by_strings(monkeypatch)
    assert got == index.rows_left(r, "gone", ("seq_id", "pos", "sym")).orderBy("row").collect()


def test_runs_left(few):
    """Runs of the rows left are those that deleting rows from all runs leaves."""
    r = few[0].withColumn("gone", F.col("read_rank") % 3 == 0)
    i = index.build(r, ("read_rank", "sym"))
    want = bins.without_rows(codecs.run_lengths(i), i.filter("read_rank % 3 = 0").select("row")).orderBy("run_id").collect()
    assert codecs.run_lengths(index.rows_left(r, "gone", ("sym",))).orderBy("run_id").collect() == want


def test_merge(few, monkeypatch):
    got = [d.orderBy(d.columns[0]).collect() for d in doubling.merge_rows(*[(r, None) for r in few])]
    _by_strings(monkeypatch)
    assert got == [d.orderBy(d.columns[0]).collect() for d in doubling.merge_rows(*[(r, None) for r in few])]


def test_merge_columns(few):
    """Columns that aren't asked for aren't stored; those that are stay the same."""
    every = doubling.merge_rows(*[(r, None) for r in few])[1]
    for keep in (("source_id", "old_row"), ("source_id", "old_rank", "pos", "sym")):
        got = doubling.merge_rows(*[(r, None) for r in few], keep=keep)[1]
        assert got.columns == ["row", *keep] and got.orderBy("row").collect() == every.select(got.columns).orderBy("row").collect()
