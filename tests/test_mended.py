"""Cases that earlier versions lost, and successors of tests whose fixtures do not show what they mean to."""

import random

import pytest
from pyspark.sql import functions as F

from readloom.functions.dna import reverse_complement
from readloom.operators import graph, index
from readloom.plans import catalog


def rc(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def test_graph_query_keeps_the_default_thresholds(spark, monkeypatch):
    """The registered graph has the default threshold and overload, and room for all nodes."""
    seen = {}
    monkeypatch.setattr(graph, "explore", lambda *a, **b: (seen.update(b), (spark.range(1).select(F.lit(1).alias("node_id"), F.lit("").alias("seq"), F.lit(1).alias("distance"), F.lit("").alias("state"), F.array(F.lit(1)).alias("pileup"), F.array(F.lit(1)).alias("inverted")), None))[1])
    catalog.assemble_graph(spark, "/root/testdata/sf0.001")
    assert seen["max_nodes"] > 1000 and not {"threshold", "overload"} & set(seen)


def test_pairs_of_nodes_without_palindromes(spark):
    """No k-mer of these nodes is its own reverse complement, so each pair counts once."""
    two = spark.createDataFrame([(0, "AACCTT"), (1, "GGTCCA")], "node_id int, seq string")
    rows = [(0, 1, "AACCT", 1, 1), (1, 1, rc("GTCCA"), 0, 1), (0, 2, "AACCT", 1, 2), (1, 2, "GTCCA", 0, 2), (0, 3, "AACCT", None, None)]
    mates = spark.createDataFrame(rows, "file_id int, seq_id long, seq string, mate_file_id int, mate_seq_id long")
    assert {tuple(r) for r in graph.node_pairs(two, mates, 4).collect()} == {(0, 1, 1), (1, 0, 1)}


def test_lcp_of_reads_alike_in_many_letters(spark, monkeypatch):
    rng = random.Random(2)
    base = "".join(rng.choice("ACGT") for _ in range(40))
    seqs = [base, base, base[:39] + "N", base[:30] + "N" * 10, base[:25], ""] + ["".join(rng.choice("ACGT") for _ in range(40)) for _ in range(15)]
    few = index.prepare_reads(spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string"))
    monkeypatch.setattr(catalog, "reads", lambda *_: few)
    qs = sorted(s + "$" for s in seqs)
    rows = sorted((q[p:], i, q[p:] + q[:p]) for i, q in enumerate(qs) for p in range(len(q)))
    rots = [(x[2] * 256)[:255] for x in rows]
    want = [next((j for j in range(255) if a[j] != b[j]), 255) for a, b in zip(rots, rots[1:], strict=False)] + [0]
    got = [r["lcp"] for r in catalog.QUERIES["lcp_array"](spark, "").orderBy("row").collect()]
    assert got == want and {255} < set(got) and {25, 30, 39} <= set(got)


@pytest.mark.parametrize("ident", [10**13, 2**62])
def test_parts_of_texts_with_large_ids(spark, tmp_path, ident):
    """A read is named by its text and its part of it; large ids and long texts stay apart."""
    docs = spark.createDataFrame([(ident, "acgt" * 30), (ident + 1, None), (0, "N" * 41)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(ident, 2_000_000, "GATT" * 11), (ident, 2, "GATTA")], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r["seq_id"], r["part"], r["seq"]) for r in catalog.reads(spark, str(tmp_path)).collect()}
    assert got == {(ident, 0, "ACGT" * 10), (ident, 1, "ACGT" * 10), (ident, 2, "ACGT" * 10), (ident + 1, 0, ""), (0, 0, "N" * 40), (0, 1, "N")}
    b = {(r["file_id"], r["seq_id"], r["part"]) for r in catalog.reads_b(spark, str(tmp_path)).collect()}
    assert b == {(2_000_000, ident, 0), (2_000_000, ident, 1), (2, ident, 0)}


def test_reverse_complement_is_its_own_inverse(spark):
    d = spark.createDataFrame([("GATTACAN$",)], "s string")
    assert d.select(reverse_complement(reverse_complement(F.col("s")))).first()[0] == "GATTACAN$"
