"""Patterns are looked up among sorted rows: no bins, no table of all suffixes, the same results."""

import random

import numpy as np
import pytest

from readloom.operators import approx, bins, index, matching, packed, search


@pytest.fixture
def few(spark, monkeypatch):
    monkeypatch.setattr(packed, "GROUP", 150)
    monkeypatch.setattr(packed, "CHUNK", 32)
    rnd = random.Random(7)
    text = lambda n: "".join(rnd.choice("AACGNT") for _ in range(n))
    seqs = [text(40) for _ in range(12)] + [text(rnd.randrange(6)) for _ in range(12)] + ["", "AAA", "AAA", "TT"]
    r = index.prepare_reads(spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "seq_id long, seq string"))
    own = [s[a:b] for s in seqs for a, b in ((0, 1), (0, 3), (2, 9), (0, 40))]
    return r, sorted({"", "A", "AAAA", "T", "TTTTTTT", "N" * 60, *own, *[x + "C" for x in own], *[text(n) for n in range(1, 50)]})


@pytest.fixture
def no_bins(monkeypatch):
    def none(*_):
        raise AssertionError("rows are made into bins")

    monkeypatch.setattr(bins, "text_bins", none)


def test_places(spark, few):
    r, patterns = few
    p = spark.createDataFrame([(x,) for x in patterns], "pattern string")
    want = {tuple(x) for x in bins.find(bins.text_bins(index.build(r, ("sym",))), p).select("pattern", "l", "h").collect()}
    held = index.sorted_rows(r, ("sym", "suffix"))
    assert {tuple(x) for x in held.places(p, 1000).collect()} == want
    assert held.places(p, len(patterns) - 1) is None
    assert {tuple(x) for x in matching.ranges_of(held, p).collect()} == want


def test_some_rows(few):
    r, _ = few
    held, every = index.sorted_rows(r, ("sym", "suffix")), index.build(r).orderBy("row").collect()
    only = np.array([0, 5, 31, 32, 100, len(every) - 1, len(every) + 9])
    assert [(x["row"], x["suffix"]) for x in held.rows("suffix", only=only).orderBy("row").collect()] == [(x["row"], x["suffix"]) for x in every if x["row"] in only]
    for prefix in ("", "A", "AAC", "TGNA"):
        assert [(x["row"], x["suffix"]) for x in held.rows("suffix", prefix=prefix).orderBy("row").collect()] == [(x["row"], x["suffix"]) for x in every if x["suffix"].startswith(prefix)]


def test_statistics_without_bins(spark, few, monkeypatch):
    """F19, F23, F24."""
    r, _ = few
    seqs = [x["seq"] for x in r.collect()]
    refs = spark.createDataFrame([(0, seqs[-1] + seqs[-3]), (1, "ACGTNNAAACCG"), (2, "")], "ref_id long, seq string")
    rows = index.build(r).localCheckpoint()
    want = [sorted(map(tuple, f(refs, None, n, 40, rows=rows).collect())) for f, n in ((matching.matching_statistics, 2), (matching.matching_statistics_both, 2), (matching.best_other, 1))]
    monkeypatch.setattr(bins, "text_bins", None)
    held = index.sorted_rows(r, ("sym", "suffix"))
    assert [sorted(map(tuple, f(refs, None, n, 40, rows=held).collect())) for f, n in ((matching.matching_statistics, 2), (matching.matching_statistics_both, 2), (matching.best_other, 1))] == want


def test_errors_without_bins(spark, few, no_bins):
    """ranges are those of counting suffixes."""
    r, _ = few
    q = spark.createDataFrame([("AAC", "A"), ("TTTT", "C")], "query string, bonus string")
    suffixes = sorted(x["suffix"] for x in index.build(r, ("suffix",)).collect())
    got = {tuple(x) for x in approx.ranges_with_error(q, index.sorted_rows(r, ("sym", "suffix")), r, 4).collect()}
    want = {(a, v) for a, v in approx.whole_read_variants(q).distinct().collect()}
    assert got == {(a, v, sum(s < v for s in suffixes), sum(s < v or s.startswith(v) for s in suffixes)) for a, v in want if any(s.startswith(v) for s in suffixes)}


@pytest.mark.parametrize("pattern", ["A?C*N$", "A*$A"])
def test_wildcards(few, monkeypatch, pattern):
    """patterns without a symbol behind ``$`` don't join rows to their reads."""
    r, _ = few
    rows = index.build(r)
    rot = index.rotation(rows, r, 41).collect()
    rx = __import__("re").compile(search.wildcard_regex(pattern))
    hit = sorted(x["row"] for x in rot if rx.match(x["rot"]))
    if "$" not in pattern[:-1]:
        monkeypatch.setattr(search, "rotation", None)
    for held in (rows, index.sorted_rows(r, ("read_rank", "pos", "suffix"))):
        got = sorted(tuple(x) for x in search.wildcard_ranges(held, r, pattern, 41).collect())
        assert [i for a, b in got for i in range(a, b)] == hit and all(b < c for (_, b), (c, _) in zip(got, got[1:], strict=False))
