"""Long reads: what is open goes round as compressed columns, and the order is that of whole suffixes."""

import random

import pytest

from readloom.operators import doubling, index, long


@pytest.mark.parametrize("width,size", [(3, 40), (21, 1 << 19)])
def test_order_of_copies_and_repeats(spark, monkeypatch, width, size):
    """Copies, near copies, repeats of one letter and empty reads, in many blocks and parts and in one; no row is sorted as a row."""
    monkeypatch.setattr(long, "WIDTH", width)
    monkeypatch.setattr(long, "BLOCK", size)
    monkeypatch.setattr(long, "PART", size)
    monkeypatch.setattr(doubling, "ranked", lambda *_: pytest.fail("rows are sorted"))
    rng = random.Random(6)
    a = "".join(rng.choice("ACGNT") for _ in range(70))
    seqs = [a, a, a[:-1], a + "N", a[5:50] * 2, "A" * 90, "A" * 90, "", "", "T", "N" * 25]
    reads = index.prepare_reads(spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string"))
    got = sorted(tuple(r) for r in doubling.build_long(reads).collect())
    qs = sorted(s + "$" for s in seqs)
    want = sorted((q[p:], i, p, q[p - 1]) for i, q in enumerate(qs) for p in range(len(q)))
    assert got == [(n, *x[1:]) for n, x in enumerate(want)]


def test_no_reads(spark):
    none = spark.createDataFrame([], "read_rank long, seq string")
    assert doubling.build_long(none).collect() == []


def test_rounds_and_lines_of_many_rows(spark, monkeypatch):
    """Names grow fourfold in a round; blocks and parts grow with the rows, so that lines between them don't with the square."""
    rounds, blocks, kept = [], [], long.stored

    def watched(df):
        got = kept(df)
        rounds.append(got.count())
        if "code" in got.columns:
            blocks.append(got.select("block").distinct().count())
        return got

    rng = random.Random(7)
    a = "".join(rng.choice("ACGNT") for _ in range(700))
    reads = index.prepare_reads(spark.createDataFrame([(i, a + "N" * (i > 9)) for i in range(12)], "seq_id long, seq string"))
    monkeypatch.setattr(long, "stored", watched)
    for name, value in {"WIDTH": 3, "BLOCK": 100, "PART": 100, "MOST": 5000, "MANY": 4}.items():
        monkeypatch.setattr(long, name, value)
    got = sorted(tuple(r) for r in doubling.build_long(reads).collect())
    qs = sorted(a + "N" * (i > 9) + "$" for i in range(12))
    want = sorted((q[p:], i, p, q[p - 1]) for i, q in enumerate(qs) for p in range(len(q)))
    assert got == [(n, *x[1:]) for n, x in enumerate(want)]
    # the reads, their first names, and rounds of 3, 12, 48, 192 and 768 symbols
    assert len(rounds) <= 7 and max(blocks) <= 5
