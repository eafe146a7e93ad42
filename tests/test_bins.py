"""Bins, runs, prefix doubling, merges, walks and matching statistics against brute force, with blocks of a few rows."""

import random

import pytest
from pyspark.sql import functions as F

from readloom.operators import bins, codecs, doubling, index, matching, walk
from readloom.plans import prefix
from readloom.plans.engine import Index


def brute(seqs):
    """(suffix, rank, pos, sym, rotation) in row order."""
    rows = []
    for rank, s in enumerate(sorted(x + "$" for x in seqs)):
        rows += [(s[j:], rank, j, s[j - 1], s[j:] + s[:j]) for j in range(len(s))]
    return sorted(rows)


def some_reads(seed, n=40, longest=14, letters="ACGNT"):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(0, longest))) for _ in range(n)] + ["", "ACG", "ACGT", "ACGT", "A" * 30, "A" * 30]


@pytest.fixture
def small(monkeypatch):
    """Bins of 8 rows, blocks of 4 and 16, pieces of 32."""
    monkeypatch.setattr(bins, "BIN_BITS", 3)
    monkeypatch.setattr(bins, "SIZE", 8)
    monkeypatch.setattr(bins, "PIECE_BITS", 5)
    monkeypatch.setattr(prefix, "BLOCK_BITS", 2)
    monkeypatch.setattr(prefix, "ROW_BITS", 4)


@pytest.fixture(scope="module")
def example(spark):
    seqs = some_reads(1)
    i = Index.from_strings(spark, seqs)
    i.rows = i.rows.cache()
    return i, brute(seqs)


def forms(i):
    return bins.text_bins(i.rows), bins.run_bins(i.runs())


def test_rows_of_bins(spark, small, example):
    i, want = example
    syms = "".join(x[3] for x in want)
    place = {(x[1], x[2]): n for n, x in enumerate(want)}
    start = {s: sum(c < s for c in syms) for s in "$ACGNT"}
    every = spark.range(len(want) + 3).select(F.col("id").alias("row"))
    for b in forms(i):
        assert [r["sym"] for r in bins.symbols_at(b, every).orderBy("row").collect()] == list(syms)
        assert [(r["row"], r["sym"]) for r in bins.symbols_between(b, 5, 29).orderBy("row").collect()] == list(enumerate(syms))[5:29]
        assert bins.symbols_between(b, 7, 7).count() == 0
        lf = {r["row"]: r["lf"] for r in bins.lf(b, every).collect()}
        assert lf == {n: place[x[1], (x[2] - 1) % len(x[4])] for n, x in enumerate(want)}
        points = every.filter(F.col("row") <= len(want)).select("row", F.explode(F.array(*[F.lit(x) for x in "$ACGNT"])).alias("sym"))
        occ = {(r["row"], r["sym"]): r["occ"] for r in bins.occurrences(b, points).collect()}
        assert occ == {(n, s): start[s] + syms[:n].count(s) for n in range(len(want) + 1) for s in "$ACGNT"}
        fm = bins.fm_at(b, every).filter(F.col("row") == 17).first()
        assert (fm["fm_end"], fm["fm_t"]) == (syms[:17].count("$"), start["T"] + syms[:17].count("T"))


@pytest.mark.parametrize("few", [0, 256])
def test_search(spark, small, example, monkeypatch, few):
    i, want = example
    monkeypatch.setattr(bins, "FEW", few)
    rng = random.Random(2)
    patterns = {"", "A" * 31, "GT$ACG", "$$", "TTTTTTTT"} | {"".join(rng.choice("$ACGNT") for _ in range(rng.randrange(1, 6))) for _ in range(15)}
    rots = [(x[4] * 40)[:40] for x in want]
    low = lambda p: sum(x[: len(p)] < p for x in rots)
    n = lambda p: sum(x.startswith(p) for x in rots)
    asked = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    for b in forms(i):
        got = {r["pattern"]: (r["l"], r["h"], r["matched"]) for r in bins.find(b, asked).collect()}
        assert got == {p: (low(p), low(p) + n(p), len(p)) for p in patterns}
        if few:
            continue
        assert {r["pattern"]: r["l"] for r in bins.places(b, asked).collect()} == {p: low(p) for p in patterns}
        # a range of fewer than 3 rows ends the search
        for r in bins.find(b, asked, least=3).collect():
            p = r["pattern"]
            ends = [p[len(p) - k :] for k in range(len(p) + 1)]
            stop = next((e for e in ends if n(e) < 3), p)
            assert (r["matched"], r["l"], r["h"]) == (len(stop), low(stop), low(stop) + n(stop)), p


@pytest.mark.parametrize("few", [0, 256])
def test_given_ranges(spark, small, example, monkeypatch, few):
    i, want = example
    monkeypatch.setattr(bins, "FEW", few)
    b = forms(i)[1]
    tails = {r["pattern"]: (r["l"], r["h"]) for r in bins.find(b, spark.createDataFrame([("G",), ("T$",), ("",)], "pattern string")).collect()}
    asked = [(p, *tails[t]) for t in tails for p in ("AC", "C", "")]
    got = {(r["pattern"], r["given_l"], r["given_h"]): (r["l"], r["h"]) for r in bins.find(b, spark.createDataFrame(asked, "pattern string, given_l long, given_h long")).collect()}
    rots = [(x[4] * 40)[:40] for x in want]
    for t, (low, high) in tails.items():
        for p in ("AC", "C", ""):
            first = sum(x[: len(p + t)] < p + t for x in rots)
            assert got[p, low, high] == (first, first + sum(x.startswith(p + t) for x in rots))
    assert i.range("ACG") == i.range("AC", i.range("G")) and i.count("CG", i.range("")) == i.count("CG")


def test_empty_index(spark):
    none = spark.createDataFrame([], "row long, sym string")
    p = spark.createDataFrame([("A",), ("",)], "pattern string")
    for b in (bins.text_bins(none), bins.run_bins(spark.createDataFrame([], "row_start long, sym string, run_len long"))):
        assert {(r["pattern"], r["l"], r["h"]) for r in bins.find(b, p).collect()} == {("A", 0, 0), ("", 0, 0)}


def test_rejects_patterns(spark, example):
    with pytest.raises(Exception, match="outside"):
        bins.find(bins.text_bins(example[0].rows), spark.createDataFrame([("AXG",)], "pattern string")).collect()


def test_removal_on_runs(spark, small, example):
    i, want = example
    runs = i.runs()
    for gone in ([], [0], [3, 4, 5, 6, 7, 8, 40, 41], list(range(0, len(want), 2)), list(range(len(want)))):
        rows = spark.createDataFrame([(n,) for n in gone], "row long")
        text = "".join(x[3] for n, x in enumerate(want) if n not in set(gone))
        got = bins.without_rows(runs, rows).orderBy("run_id").collect()
        assert "".join(r["sym"] * r["run_len"] for r in got) == text
        assert [r["run_id"] for r in got] == list(range(len(got))) and all(a["sym"] != b["sym"] and a["row_start"] + a["run_len"] == b["row_start"] for a, b in zip(got, got[1:], strict=False))


def test_long_runs_are_cut(spark, small):
    """A run over many bins, whose pieces are made in two steps."""
    runs = spark.createDataFrame([(0, 0, "A", 700), (1, 700, "C", 3), (2, 703, "A", 90)], "run_id long, row_start long, sym string, run_len long")
    b = bins.run_bins(runs)
    assert b.count() == 793 // 8 + 2
    assert bins.occurrences(b, spark.createDataFrame([("A", 750), ("C", 793)], "sym string, row long")).orderBy("row").collect()[0]["occ"] == 747
    left = bins.without_rows(runs, spark.createDataFrame([(700,), (701,), (702,), (5,)], "row long")).collect()
    assert [tuple(r) for r in left] == [(0, 0, "A", 789)]


def test_group_starts(spark, small):
    keys = [1] * 3 + [2] + [3] * 60 + [4] * 2 + [5] + [6] * 17
    d = spark.createDataFrame(list(enumerate(keys)), "i long, k int")
    for r in prefix.group_starts(d, "i", ["k"], "start").collect():
        assert r["start"] == keys.index(r["k"]) and r["__single"] == (keys.count(r["k"]) == 1)
    sums = {r["i"]: r["k"] for r in prefix.before(d, "i", ["k"]).collect()}
    assert sums == {n: sum(keys[:n]) for n in range(len(keys))}


# ---- prefix doubling


@pytest.mark.parametrize("seed", range(2))
def test_doubling_is_the_index(spark, small, monkeypatch, seed):
    monkeypatch.setattr(doubling, "WIDTH", 3)
    monkeypatch.setattr(doubling, "CHUNK", 4)
    seqs = some_reads(seed, longest=30, letters="AC" if seed else "ACGNT")
    reads = Index.from_strings(spark, seqs).reads
    got = [(r["read_rank"], r["pos"], r["sym"]) for r in doubling.build_long(reads).orderBy("row").collect()]
    assert got == [(x[1], x[2], x[3]) for x in brute(seqs)]


def test_long_reads(spark):
    """Reads of 20,000 letters with long repeats, alike but for their ends; keys of fixed width, whatever the length."""
    rng = random.Random(3)
    unit = "".join(rng.choice("ACGT") for _ in range(700))
    seqs = [unit * 28, unit * 28 + "A", (unit * 28)[:-1] + "N", "A" * 3000]
    reads = Index.from_strings(spark, seqs).reads
    d = doubling.build_long(reads)
    assert d.columns == ["row", "read_rank", "pos", "sym"]
    got = [(r["read_rank"], r["pos"]) for r in d.orderBy("row").collect()]
    qs = [r["seq"] + "$" for r in reads.orderBy("read_rank").collect()]
    order = sorted(((i, p) for i, q in enumerate(qs) for p in range(len(q))), key=lambda x: (qs[x[0]][x[1] :], x[0]))
    assert got == order


def test_packed_keys_keep_the_order(spark):
    words = ["$", "A$", "AA$", "AC$", "A" * 24, "A" * 25 + "$", "A" * 23 + "$", "T" * 40, "N$", "NA"]
    d = spark.createDataFrame([(w,) for w in words], "s string").select("s", doubling.packed(F.col("s")).alias("k")).collect()
    k = {r["s"]: r["k"] for r in d}
    for a in words:
        for b in words:
            assert (k[a] < k[b]) == (a[:24].ljust(24, "$") < b[:24].ljust(24, "$"))


@pytest.mark.parametrize("width", [3, 24])
def test_merge_by_interleave(spark, small, monkeypatch, width):
    monkeypatch.setattr(doubling, "WIDTH", width)
    parts = [some_reads(5, 15), some_reads(6, 15, letters="AC"), [], ["ACGT", "A" * 30]]
    indexes = [Index.from_strings(spark, p) for p in parts]
    # the third has rows without suffixes
    indexes[1].rows = indexes[1].rows.drop("suffix")
    reads, rows = doubling.merge_rows(*[(i.reads, i.rows) for i in indexes])
    got = rows.orderBy("row").collect()
    want = brute([s for p in parts for s in p])
    assert [(r["row"], r["read_rank"], r["pos"], r["sym"]) for r in got] == [(n, *x[1:4]) for n, x in enumerate(want)]
    # the interleave alone gives the merge: the rows of each source come in their own order
    own = [[x[3] for x in brute(p)] for p in parts]
    for source, syms in enumerate(own):
        mine = [r for r in got if r["source_id"] == source]
        assert [r["old_row"] for r in mine] == list(range(len(syms))) and [r["sym"] for r in mine] == syms
    ties = [(r["source_id"], r["old_rank"]) for r in got if r["pos"] == 0 and want[r["row"]][0] == "ACGT$"]
    assert ties == sorted(ties) and {t[0] for t in ties} == {0, 1, 3}


def test_merged_index_searches(spark, tmp_path):
    a, b = some_reads(7, 10), some_reads(8, 10)
    m = Index.merge(Index.from_strings(spark, a).save(str(tmp_path / "a")), Index.from_strings(spark, b).save(str(tmp_path / "b"))).save(str(tmp_path / "m"))
    want = brute(a + b)
    assert m.count("AC") == sum((x[4] * 9).startswith("AC") for x in want) and m.size() == len(want)
    assert [r["read"] for r in m.query("CG").collect()] == [x[4][len(x[4]) - x[2] :] + x[0] for x in want if (x[4] * 9).startswith("CG")]
    left = m.remove(m.reads.filter("seq = 'ACGT'").select("read_rank"))
    assert "".join(r["sym"] for r in left.rows.orderBy("row").collect()) == "".join(x[3] for x in brute([s for s in a + b if s != "ACGT"]))
    assert sorted((r["l"], r["h"]) for r in m.wildcard("A?G").collect()) == sorted((r["l"], r["h"]) for r in Index.from_strings(spark, a + b).wildcard("A?G").collect())


# ---- walks, common prefixes, matching statistics


def test_reads_from_symbols_alone(spark, small, example):
    i, want = example
    syms = i.rows.select("row", "sym")
    assert {tuple(r) for r in walk.rows_of_symbols(syms).collect()} == {(n, x[1], x[2], x[3]) for n, x in enumerate(want)}
    place = {(x[1], x[2]): n for n, x in enumerate(want)}
    got = {(r["row"], r["i"]): (r["at_row"], r["sym"]) for r in walk.rotations(syms, syms.filter("row % 3 = 0").select("row")).collect()}
    for n, x in enumerate(want):
        for k, c in enumerate(x[4]):
            assert n % 3 or got.pop((n, k)) == (place[x[1], (x[2] + k) % len(x[4])], c)
    assert not got


@pytest.mark.parametrize("cap", [4, 255])
def test_lcp_after_removal(spark, small, example, cap):
    i, want = example
    lcps = index.lcp(i.rows, i.reads, cap)
    rots = [(x[4] * 256)[:cap] for x in want]
    common = lambda a, b: next((k for k in range(cap) if a[k] != b[k]), cap)
    assert [r["lcp"] for r in lcps.orderBy("row").collect()] == [common(a, b) for a, b in zip(rots, rots[1:], strict=False)] + [0]
    for gone in ([], [0, 1, 2], list(range(5, 60)), list(range(0, len(want), 3)), [len(want) - 1], list(range(len(want)))):
        left = [r for n, r in enumerate(rots) if n not in set(gone)]
        got = index.lcp_without(lcps, spark.createDataFrame([(n,) for n in gone], "row long")).orderBy("row").collect()
        assert [r["lcp"] for r in got] == [common(a, b) for a, b in zip(left, left[1:], strict=False)] + [0] * bool(left)
        assert [r["row"] for r in got] == list(range(len(left)))


@pytest.mark.parametrize("threshold", [1, 2, 5])
def test_matching_statistics(spark, small, threshold):
    seqs = [s for s in some_reads(9, 40) if s] + ["ACGTACGTACGTACGTACGTACGTACGTA", "CCGTACGTACGTACGTACGTACGTACGTA"] * 3
    i = Index.from_strings(spark, seqs)
    refs = [(1, "ACGTACGTACGTACGTACGTACGTACGTACGTNN"), (2, ""), (3, "T"), (4, "GGGGACGNTAAAAA"), (5, "ACGTACGTACGTACGTACGTACGTACGTA")]
    longest = max(map(len, seqs))
    times = lambda x: sum(s.startswith(x, k) for s in seqs for k in range(len(s)))

    def stats(s):
        out = []
        for p in range(len(s)):
            n = max((k for k in range(1, min(len(s) - p, longest) + 1) if times(s[p : p + k]) >= threshold), default=0)
            out.append(n or int(times(s[p]) > 0))
        return out

    d = spark.createDataFrame(refs, "ref_id long, seq string")
    got = {(r["ref_id"], r["pos"]): r["len"] for r in matching.matching_statistics(d, i.reads, threshold, longest).collect()}
    assert got == {(n, p): v for n, s in refs for p, v in enumerate(stats(s))}
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    both = {(r["ref_id"], r["pos"]): r["len"] for r in matching.matching_statistics_both(d, i.reads, threshold, longest, i.rows).collect()}
    assert both == {(n, p): v + stats(rc(s))[len(s) - 1 - p] for n, s in refs for p, v in enumerate(stats(s))}
    other = {(r["ref_id"], r["pos"]): r["other"] for r in matching.best_other(d, i.reads, threshold, longest).collect()}
    assert other == {(n, p - 1): max(times(a + s[p : p + v]) for a in "ACGNT" if a != s[p - 1]) for n, s in refs for p, v in enumerate(stats(s)) if v > 20 and p}
    assert threshold > 3 or any(other.values())


def test_runs_round_trip(spark, example):
    i, want = example
    assert "".join(r["sym"] for r in codecs.decode(i.runs()).orderBy("row").collect()) == "".join(x[3] for x in want)
