"""One error as a prefix pattern, and the graph query's thresholds."""

from pyspark.sql import functions as F

from readloom.operators import approx, index
from readloom.plans import catalog


def test_ranges_with_error(spark):
    reads = index.prepare_reads(spark.createDataFrame([(0, "ACGTNACCA"), (1, "TTACGAACG"), (2, "CCAGTCA"), (3, "GACTA")], "seq_id long, seq string"))
    queries = ["ACGT", "CCA"]
    qs = [r["seq"] + "$" for r in reads.orderBy("read_rank").collect()]
    rots = [r for _, _, r in sorted((q[p:], i, (q[p:] + q[:p]) * 2) for i, q in enumerate(qs) for p in range(len(q)))]
    want = set()
    for q in queries:
        n = len(q)
        every = {q} | {q[:i] + a + q[i + 1 :] for i in range(n) for a in "ACGNT"}
        every |= {(q[: i + 1] + a + q[i + 1 :])[1:] for i in range(n) for a in "ACGNT"} | {"G" + q[:i] + q[i + 1 :] for i in range(n)}
        for v in every:
            at = [i for i, r in enumerate(rots) if r.startswith(v)]
            if at:
                want.add((q, v, at[0], at[-1] + 1))
    ask = spark.createDataFrame([(q, "G") for q in queries], "query string, bonus string")
    got = {tuple(r) for r in approx.ranges_with_error(ask, index.build(reads), reads, 4).collect()}
    assert got == want and any(v not in q for q, v, _, _ in want for q in queries)
