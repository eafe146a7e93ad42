"""Cases that earlier versions lost, and the pipeline's stages against brute force on tables with nulls, repeats and clashing columns."""

import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from readloom.llm import ann, line_dedup, mixing, oracles


def _cosine(a, b):
    return float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))


@pytest.mark.parametrize("shard", [16_384, 40])
def test_neighbours_of_repeated_ids(spark, monkeypatch, shard):
    """Rows of one id are one candidate, by its nearest row, and take nobody's place; in one shard and in several, in blocks of queries."""
    monkeypatch.setattr(ann, "SHARD", shard)
    monkeypatch.setattr(ann, "BLOCK", 2)
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(0, 240, 2)]
    near = np.array(rows[0][1])
    rows += [(7, (near + 0.01 * rng.standard_normal(6)).tolist()) for _ in range(8)] + [(50, rng.standard_normal(6).tolist())]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = defaultdict(dict)
    for r in ann.nearest(d, lambda c: c % 50 == 0, k=5, sure=1.0).collect():
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    asked = {i: min([v for j, v in rows if j == i]) for i, _ in rows if i % 50 == 0}
    assert set(got) == set(asked)
    for q, v in asked.items():
        best = defaultdict(lambda: -2.0)
        for i, w in rows:
            if i != q:
                best[i] = max(best[i], _cosine(np.array(w), np.array(v)))
        want = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5]
        assert [got[q][k + 1][0] for k in range(5)] == [i for i, _ in want]
        assert np.allclose([got[q][k + 1][1] for k in range(5)], [s for _, s in want], atol=1e-12)


def test_boilerplate_on_a_null_site(spark):
    """Null is one site, in the operator and in its SQL."""
    rows = [(1, "a", "the same line\nown 1"), (2, "b", "the same line\nown 2"), (3, None, "the same line\nown 3"), (4, None, "twice null\nx"), (5, None, "twice null\ny"), (6, "a", None)]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert got[2] == ("own 2", 2, 1) and got[3] == ("own 3", 2, 1) and got[5] == ("twice null\ny", 2, 0) and got[6] == (None, 0, 0)
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, source varchar, text varchar)")
    c.executemany("insert into documents values (?, ?, ?)", rows)
    assert {r[0]: r[1:] for r in c.execute(oracles.SQL["op2_line_dedup"]).fetchall()} == got


def test_line_thresholds_given(spark):
    """A line goes where it is long enough and on enough sites, and stays at its first place."""
    rows = [(i, f"site{i % 12}", f"a line on all of the sites\nshort\na line on few of the sites{i % 2 if i < 6 else i}\nown {i}") for i in range(24)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r["doc_id"]: r["text"].split("\n") for r in line_dedup.dedup_lines(d, min_sites=10, min_chars=20).collect()}
    assert got[0][0] == "a line on all of the sites" and all(len(got[i]) == 3 and got[i][0] == "short" for i in range(1, 24))
    got = {r["doc_id"]: r["text"].split("\n") for r in line_dedup.dedup_lines(d, min_sites=10, min_chars=5).collect()}
    assert all(len(got[i]) == 2 for i in range(1, 24))


def test_mix_that_does_not_settle(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_STEPS", 1)
    rows = [(i, "ab"[i % 2], "w " * (i % 9 + 1)) for i in range(40)]
    with pytest.raises(RuntimeError, match="not settled"):
        mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()


# ---- stages of the pipeline

_WORDS = [f"word{i}" for i in range(300)]


def _documents(spark):
    rng = random.Random(6)
    rows = []
    for i in range(60):
        body = [rng.choice(_WORDS) for _ in range(rng.randint(55, 120))]
        lines = [" ".join(body[k : k + 20]) for k in range(0, len(body), 20)]
        if i % 3 == 0:
            lines.insert(1, "shared by the documents of many sites")
        rows.append((i, "\n".join(lines), "en", f"s{i % 5}" if i % 7 else None))
    rows.append((60, rows[1][1] + " and more", "en", "s1"))  # near copy
    rows += [(61, None, "en", "s1"), (62, "", "en", "s1"), (63, " \n ", None, None), (64, "too short", "en", "s2"), (None, rows[2][1][::-1], None, "s0"), rows[5], rows[5]]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    # names that the operators use for columns of their own
    return d.withColumn("n_lines", F.lit("own")).withColumn("Mix_size", F.col("doc_id")).withColumn("kept", F.lit(None).cast("string"))


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_the_columns(spark, k):
    d = _documents(spark)
    for docs in (d, d.limit(0)):
        out = corpus_pipeline.STAGES[k][1](spark, docs, None)
        assert out.columns == d.columns and out.dtypes == d.dtypes
        rows = out.collect()
        assert all(r["n_lines"] == "own" and r["Mix_size"] == r["doc_id"] and r["kept"] is None for r in rows)


def test_rules_stage(spark):
    """Exactly the documents that the rules reject go: here those without enough words."""
    got = sorted(str(r["doc_id"]) for r in corpus_pipeline.quality_rules(spark, _documents(spark), None).collect())
    want = sorted(str(r["doc_id"]) for r in _documents(spark).collect() if len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) >= 50)
    assert got == want


def test_lines_stage(spark):
    """Brute force: lines of 4 characters and more on 3 sites and more stay at their first place only."""
    rows = _documents(spark).collect()
    sites, first = defaultdict(set), {}
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)):
        for at, raw in enumerate((r["text"] or "").split("\n")):
            line = raw.strip(" \t\x0b\x0c\r")
            sites[line].add(r["source"])
            first.setdefault(line, (r["doc_id"], r["text"], at))
    want = []
    for r in rows:
        if r["text"] is None:
            want.append((r["doc_id"], None))
            continue
        lines = r["text"].split("\n")
        left = [x for at, x in enumerate(lines) if not (len(y := x.strip(" \t\x0b\x0c\r")) >= 4 and len(sites[y]) >= 3 and first[y] != (r["doc_id"], r["text"], at))]
        if len(left) == len(lines) or re.search(r"[^\x20\x09-\x0D]", "\n".join(left)):
            want.append((r["doc_id"], "\n".join(left)))
    key = lambda x: (str(x[0]), str(x[1]))
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.dedup_lines(spark, _documents(spark), None).collect()]
    assert sorted(got, key=key) == sorted(want, key=key) and any("shared by" not in (t or "shared by") for i, t in got if i in (3, 6, 9))


def test_near_stage(spark):
    """Brute force: of documents linked by five-word shingles one stays; rows of one id stay or go together."""
    rows = _documents(spark).collect()

    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    held = defaultdict(list)
    for r in rows:
        held[r["doc_id"]].append(grams(r["text"]))
    ids = [i for i in held if i is not None]
    linked = {i: {j for j in ids if any(100 * len(a & b) >= 80 * len(a | b) > 0 for a in held[i] for b in held[j])} for i in ids}
    gone = {i for i in ids if any(j < i for j in linked[i])}
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, _documents(spark), None).collect()}
    assert gone == {60} and {i for i in ids if i not in got} == gone and None in got


def test_mix_and_pack_stages(spark):
    d = _documents(spark).filter("text is not null")
    mixed = corpus_pipeline.mix_sources(spark, d, None)
    own, taken = defaultdict(int), defaultdict(int)
    for r in d.collect():
        own[r["source"]] += len((r["text"] or "").split())
    copies = defaultdict(int)
    rows = mixed.collect()
    for r in rows:
        taken[r["source"]] += len(r["text"].split())
        copies[r["doc_id"], r["text"]] += 1
    limit = {k: 2 * sum((r["doc_id"], r["text"]) == k for r in d.collect()) for k in copies}
    assert all(n <= limit[k] for k, n in copies.items()) and all(taken[s] <= 2 * own[s] for s in own) and abs(sum(taken.values()) - 1.5 * sum(own.values())) <= 0.1 * sum(own.values())
    pieces = corpus_pipeline.pack(spark, mixed, None).collect()
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    for parts in by_sequence.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(n for _, n in parts) <= 2048
    whole = [p["doc_tokens"] for p in pieces if p["start"] == 0]
    assert len(whole) == len(rows) and sum(whole) == sum(p["length"] for p in pieces)
