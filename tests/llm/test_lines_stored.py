"""Line dedup stores few occurrences but those of frequent lines, and misses none of these."""

import pytest
from pyspark.sql import functions as F

from readloom.llm import line_dedup


@pytest.fixture(scope="module")
def docs(spark):
    """400 texts of 50 lines of their own, a line of three sites, and a line of two."""
    own = F.transform(F.sequence(F.lit(1), F.lit(50)), lambda i: F.concat(F.lit("line "), i.cast("string"), F.lit(" of text "), F.col("id").cast("string")))
    site = F.col("id") % 3
    more = F.when(site == 0, F.array(F.lit("on three sites"))).otherwise(F.array(F.lit("on three sites"), F.lit("on two sites")))
    return spark.range(400).select(F.col("id").alias("doc_id"), F.array_join(F.concat(own, more), "\n").alias("text"), site.cast("string").alias("source"))


def test_rare_lines_are_not_stored(docs, monkeypatch):
    rows, store = [], line_dedup.materialize
    monkeypatch.setattr(line_dedup, "materialize", lambda df: rows.append((d := store(df)).count()) or d)
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    assert sum(rows) < 2_000  # of 20,667 lines
    want = {r["doc_id"]: r["text"].replace("\non three sites", "") if r["doc_id"] else r["text"] for r in docs.collect()}
    assert {i: r["text"] for i, r in got.items()} == want
    assert [got[0]["n_removed"], got[1]["n_removed"], got[1]["n_lines"]] == [0, 1, 52]


def test_a_full_bitmap_loses_nothing(spark, docs, monkeypatch):
    want = sorted(map(tuple, line_dedup.dedup_lines(docs.unionByName(docs.selectExpr("doc_id + 1000 as doc_id", "text", "'9' as source")), min_sites=2).collect()))
    monkeypatch.setattr(line_dedup, "MAX_LOG_BITS", 10)
    monkeypatch.setattr(line_dedup, "ROW_LOG_BITS", 8)
    got = line_dedup.dedup_lines(docs.unionByName(docs.selectExpr("doc_id + 1000 as doc_id", "text", "'9' as source")), min_sites=2)
    assert sorted(map(tuple, got.collect())) == want
    assert all(r[4] == 0 for r in want if r[0] == 0) and all(r[1] == "" for r in want if r[0] >= 1000)
