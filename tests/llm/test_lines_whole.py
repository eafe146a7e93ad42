"""The pipeline removes boilerplate of few sites, also from a corpus of few sites, and short lines."""

import corpus_pipeline


def test_boilerplate_of_few_sites(spark):
    boiler, short, two = "A passage that three sites repeat in all of their pages.", "Menu", "This one is on two sites only and stays."
    rows = [(i, f"own line number {i} of its text\n{boiler}\n{short}\n-" + (f"\n{two}" if i % 3 else ""), f"s{i % 3}") for i in range(9)]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "").collect()}
    assert got[0] == rows[0][1]
    assert all(boiler not in got[i] and short not in got[i] and got[i].split("\n")[1] == "-" for i in range(1, 9))
    assert all(two in got[i] for i in range(9) if i % 3)
