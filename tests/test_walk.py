"""All reads walk together: a step moves what is still walking, not all rows."""

import random

import pytest
from test_bins import brute, some_reads

from readloom.operators import index, walk
from readloom.plans.engine import Index


@pytest.mark.parametrize("bits", [3, 19])
def test_reads_are_walked_without_doubling(spark, monkeypatch, bits):
    """In many blocks and in one, from sorted rows and from a table in any order; no row is doubled or joined."""
    monkeypatch.setattr(walk, "BLOCK_BITS", bits)
    monkeypatch.setattr(walk, "positions", lambda *_: pytest.fail("rows are doubled"))
    seqs = [*some_reads(5, 20, 8)[:20], "", "", "A", "GATTACA", "GATTACA"]
    reads, want = Index.from_strings(spark, seqs).reads, brute(seqs)
    place = {(x[1], x[2]): n for n, x in enumerate(want)}
    whole = {(place[x[1], 0], x[2], n, (x[0])[0]) for n, x in enumerate(want)}
    held = index.sorted_rows(reads, ("sym",))
    table = [(n, x[3]) for n, x in enumerate(want)]
    random.Random(1).shuffle(table)
    for symbols in (held, spark.createDataFrame(table, "row long, sym string").repartition(3)):
        got = walk.whole_reads(symbols)
        assert got.schema.simpleString() == "struct<row:bigint,i:int,at_row:bigint,sym:string>"
        assert sorted(tuple(r) for r in got.collect()) == sorted(whole)
        assert sorted(tuple(r) for r in walk.rows_of_symbols(symbols).collect()) == [(n, x[1], x[2], x[3]) for n, x in enumerate(want)]


def test_long_reads_are_doubled(spark, monkeypatch):
    """Beyond the steps of a walk, whether their mean or only some are long, the result is the same."""
    seqs = ["ACGTNACG", "T", "", "", ""]
    want = brute(seqs)
    place = {(x[1], x[2]): n for n, x in enumerate(want)}
    syms = spark.createDataFrame([(n, x[3]) for n, x in enumerate(want)], "row long, sym string")
    for steps in (1, 4):
        monkeypatch.setattr(walk, "STEPS", steps)
        assert {tuple(r) for r in walk.whole_reads(syms).collect()} == {(place[x[1], 0], x[2], n, x[0][0]) for n, x in enumerate(want)}


def test_symbols_that_are_no_index(spark):
    syms = spark.createDataFrame(list(enumerate("$AC")), "row long, sym string")
    with pytest.raises(RuntimeError, match="no index"):
        walk.rows_of_symbols(syms)
