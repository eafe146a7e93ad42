"""Pairs of nodes are counted where mates meet, in numbers, with the results of the join."""

import random

import pytest
from pyspark.sql import functions as F

from readloom.operators import graph

READS = "file_id int, seq_id long, seq string, mate_file_id int, mate_seq_id long"


@pytest.fixture(scope="module")
def mates(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("ACGTN") for _ in range(n))
    nodes = [(i, text(rng.randrange(3, 14))) for i in range(40)]
    nodes.append((40, nodes[0][1]))  # a k-mer of two nodes
    part = lambda: "".join(rng.choice(nodes)[1] for _ in range(rng.randrange(3)))
    rows = [(s, i, part(), 1 - s, i) for i in range(60) for s in (0, 1)]
    rows += [(0, 100, part(), 1, 3), (0, 101, part(), 1, 999), (0, 102, part(), None, None), (0, 103, part(), 0, 103), (0, 5, part(), 1, 5), (1, 104, None, 0, 2)]
    return spark.createDataFrame(nodes, "node_id int, seq string"), spark.createDataFrame(rows, READS)


def test_pairs_are_those_of_the_join(mates, monkeypatch):
    """Also with mates of one side only, of themselves, unknown ones, and reads in two rows; in many parts and buckets."""
    monkeypatch.setattr(graph, "PAIRS", 50)
    got = {tuple(r) for r in graph.node_pairs(*mates, 4).collect()}
    monkeypatch.setattr(graph, "NODE_KMERS", 0)
    want = [tuple(r) for r in graph.node_pairs(*mates, 4).collect()]
    assert len(want) > 100 and got == set(want)


def test_pairs_cross_the_shuffle_as_counts(mates, monkeypatch):
    """Rows of pairs took most of the time: with few k-mers of nodes no hit of a read is joined to those of its mate."""
    monkeypatch.setattr(graph, "_node_hits", lambda *a: pytest.fail("hits are joined"))
    d = graph.node_pairs(*mates, 4)
    assert d.schema.simpleString() == "struct<node_id:int,other:int,n_pairs:bigint>" and d.agg(F.sum("n_pairs")).first()[0] > 0
