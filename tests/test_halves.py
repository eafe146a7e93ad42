"""Reads within one change of a query are met by halves, or by variants where a half is in many reads."""

import random

import pytest

from readloom.operators import approx, index
from readloom.plans import store


@pytest.mark.parametrize("hot", [0, 2, 256])
def test_halves_as_variants(spark, monkeypatch, hot):
    monkeypatch.setattr(approx, "HOT", hot)
    rnd = random.Random(7)
    text = lambda n: "".join(rnd.choice("ACGNT") for _ in range(n))
    queries = [text(n) for n in (1, 2, 5, 15, 16, 17, 18, 24, 39, 40, 40)] + ["A" * 20, "A" * 19 + "C", "AC" * 10]
    seqs = list(queries) + [text(40)]
    for q in queries:
        for _ in range(12):
            i, a = rnd.randrange(len(q)), rnd.choice("ACGNT")
            seqs += [q[:i] + a + q[i + 1 :], (q[: i + 1] + a + q[i + 1 :])[1:], rnd.choice("AC") + q[:i] + q[i + 1 :]]
            j = rnd.randrange(len(q))
            seqs.append("".join(rnd.choice("ACGNT") if x in (i, j) else c for x, c in enumerate(q)))
    r = index.prepare_reads(spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string"))
    q = spark.createDataFrame([(x, b) for x in queries for b in ("A" if len(x) % 2 else "C", "A")] + [("ACGTACGTACGTACGTACGT", None)], "query string, bonus string")
    got = sorted(map(tuple, approx.reads_with_error(q, r).collect()))
    plain = approx.whole_read_variants(q).join(r.withColumnRenamed("seq", "variant"), "variant").select("query", "read_rank").distinct()
    assert got == sorted(map(tuple, plain.collect())) and len(got) > 300


def test_no_broadcast(spark):
    """The table of variants is far larger than its estimate, so it must not be sent whole."""
    q = spark.createDataFrame([("ACGTACGTACGTACGTACGT", "A"), ("ACG", "A")], "query string, bonus string")
    r = store.stored(index.prepare_reads(spark.createDataFrame([(1, "ACGTACGTACGTACGTACGA"), (2, "ACC")], "seq_id long, seq string")))
    sent = []
    plain = approx.stored
    approx.stored = lambda d: (sent.append(d._jdf.queryExecution().executedPlan().toString()), plain(d))[1]
    try:
        assert sorted(map(tuple, approx.reads_with_error(q, r).collect())) == [("ACG", 0), ("ACGTACGTACGTACGTACGT", 1)]
    finally:
        approx.stored = plain
    assert sent and not any("BroadcastHashJoin" in x for x in sent)
