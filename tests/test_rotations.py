"""Whole cyclic strings of all rows: they cross the shuffle once, as keys, and rows don't meet their reads again."""

import random

import pytest

from readloom.operators import index, packed


@pytest.mark.parametrize("longest,group", [(15, 40), (40, 7), (83, 1 << 19)])
def test_rotations(spark, monkeypatch, longest, group):
    """Copies, repeats of one letter, empty reads and reads of other lengths, in many groups and in one."""
    monkeypatch.setattr(packed, "GROUP", group)
    monkeypatch.setattr(packed, "PIECE", 400)
    monkeypatch.setattr(packed, "CHUNK", 16)
    monkeypatch.setattr(index, "recover", lambda *_: pytest.fail("rows meet their reads"))
    monkeypatch.setattr(packed, "stored", lambda *_: pytest.fail("rows are stored"))
    rng = random.Random(longest)
    seqs = ["".join(rng.choice("ACGNT") for _ in range(rng.randrange(longest + 1))) for _ in range(20)]
    seqs += [seqs[0], seqs[0], "", "", "A" * longest, "A" * longest, "A" * (longest - 1), "T" * 5]
    reads = index.prepare_reads(spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string"))
    got = sorted(tuple(r) for r in index.rotations(reads).select("row", "read_rank", "pos", "rotation").collect())
    qs = sorted(s + "$" for s in seqs)
    want = sorted((q[p:], i, p, q[p:] + q[:p]) for i, q in enumerate(qs) for p in range(len(q)))
    assert got == [(n, *x[1:]) for n, x in enumerate(want)]


def test_long_reads_and_none(spark):
    for seqs in ([], ["ACGT" * 30, "A"]):
        reads = index.prepare_reads(spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string"))
        got = sorted(tuple(r) for r in index.rotations(reads).collect())
        want = sorted((q[p:], i, p, q[p:] + q[:p]) for i, q in enumerate(sorted(s + "$" for s in seqs)) for p in range(len(q)))
        assert got == [(n, *x[1:]) for n, x in enumerate(want)]
