"""Seeded exploration of the implicit de Bruijn graph of a read collection.

Everything is a table. A k-mer's ways in and out are the (k + 1)-mers of both strands that end or begin with it; a way is
firm from ``threshold`` occurrences on. A k-mer is left by its firm ways, or, if it has none, by its commonest weak one.
Stretches without a choice are contracted by pointer doubling, so that the search from the seed takes one round for each
branching, not for each symbol; rounds keep the ``max_nodes`` nearest starts. What is reached is cut into nodes by the
rules below, again by pointer doubling:

* a node begins at the seed, at an end seed, behind a k-mer with several ways out, and where several ways in are firm or
  walked;
* TERMINAL: no way out. SPLIT: several firm ways out. OVERLOAD: its first k-mer is too frequent; it is not left.
* MERGE_<node>: its only way out leads to the beginning of a node; with ``, THRESHOLD`` (and a dashed edge) if it is weak.
* ``$ Max``: the only way out is the end of reads, which then is the last symbol. ``$ Ext``: a firm way out of a split
  is the end of reads. Both only with ``dollars``.
* END_SEED_i: an end seed. UNEXPLORED_NODE, UNEXPLORED_DIST: beyond ``max_nodes`` nodes, or ``max_distance`` from the seed.

Nodes are numbered by distance from the seed, then by k-mer; nothing depends on an order of exploration.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readloom.functions.dna import ALPHABET, is_valid, reverse_complement, windows
from readloom.operators import packed
from readloom.operators.search import kmer_counts
from readloom.plans.store import stored

#: Doublings of a pointer: paths of up to 2^40 k-mers.
DOUBLINGS = 40
#: k-mers of nodes, both strands, that go to all tasks as sorted numbers; more are joined to those of the reads.
NODE_KMERS = 1 << 22
#: Pairs of nodes that a task counts at once, and that a bucket of counts holds by its estimate.
PAIRS = 1 << 22


def both_strands(counts: DataFrame) -> DataFrame:
    """(kmer, cnt) with a k-mer's count and its reverse complement's added."""
    rc = counts.select(reverse_complement(F.col("kmer")).alias("kmer"), "cnt")
    return counts.unionByName(rc).groupBy("kmer").agg(F.sum("cnt").alias("cnt"))


def stranded_sum(reads: DataFrame, k: int) -> DataFrame:
    return both_strands(kmer_counts(reads, k))


def longer_counts(reads: DataFrame, k: int, dollars: bool) -> DataFrame:
    """(kmer, cnt) of (k + 1)-mers, both strands; with ``dollars`` also those that begin or end with a read's end."""
    if dollars:
        reads = reads.withColumn("seq", F.concat(F.lit("$"), "seq", F.lit("$")))
    d = both_strands(kmer_counts(reads, k + 1))
    return d.filter(~(F.col("kmer").startswith("$") & F.col("kmer").endswith("$"))) if dollars else d


def ways(longer: DataFrame, k: int, threshold: int) -> DataFrame:
    """(u, v, sym, cnt, firm, only): the ways walked. ``only``: the single way out of u; v is entered by u's first symbol."""
    d = longer.filter(~F.col("kmer").startswith("$"))
    d = d.select(F.substring("kmer", 1, k).alias("u"), F.substring("kmer", 2, k).alias("v"), F.substring("kmer", k + 1, 1).alias("sym"), "cnt", (F.col("cnt") >= threshold).alias("firm"))
    of = d.groupBy("u").agg(F.count_if("firm").alias("n"), F.min(F.struct(-F.col("cnt"), F.col("sym"))).alias("top"))
    d = d.join(of, "u").filter(F.col("firm") | ((F.col("n") == 0) & (F.col("sym") == F.col("top.sym"))))
    return d.select("u", "v", "sym", "cnt", "firm", (F.col("n") <= 1).alias("only"))


def firm_ways_in(longer: DataFrame, k: int, threshold: int) -> DataFrame:
    """(kmer, n_firm): the firm ways into each k-mer that has any."""
    return longer.filter(F.col("cnt") >= threshold).groupBy(F.substring("kmer", 2, k).alias("kmer")).agg(F.count(F.lit(1)).alias("n_firm"))


def _jumps(step: DataFrame) -> tuple[list[DataFrame], DataFrame, bool]:
    """Tables (u, to) of 1, 2, 4, ... steps of a partial function, (u, last, n): its end and the steps there, and whether it has circles."""
    # n counts the steps still taken; a pointer whose target has no step stays
    at = step.select("u", F.col("v").alias("to"))
    reach = stored(at.withColumn("n", F.lit(1).cast("long")))
    levels = [reach.select("u", "to")]
    last, before = reach, -1
    for _ in range(DOUBLINGS):
        # what has taken all its 2^i steps goes on; the others are at their end
        tail = last.select(F.col("u").alias("to"), F.col("to").alias("next"), F.col("n").alias("more"))
        last = stored(last.join(tail, "to", "left").select("u", F.coalesce("next", "to").alias("to"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")))
        level = last.filter(F.col("n") == 1 << len(levels)).select("u", "to")
        # of paths that end, some end in each round; where none does, only circles are left
        if (held := level.count()) in (0, before):
            break
        levels.append(level)
        before = held
    return levels, last.select("u", F.col("to").alias("last"), "n"), held > 0


def _nearest(starts: DataFrame) -> DataFrame:
    return starts.groupBy("kmer").agg(F.min("distance").alias("distance"))


def explore(reads: DataFrame, seed: str | DataFrame, k: int, max_nodes: int, threshold: int = 10, overload: int = 1000, max_distance: int | None = None, end_seeds: tuple = (), count_k: int | None = None, dollars: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of what is reached from ``seed``, a k-mer or a table with one in column kmer.

    nodes: node_id, seq, distance, state, pileup (the count of each of its k-mers, by their last ``count_k`` symbols),
    inverted (nodes that hold a reverse complement). edges: source, target, cnt, style. The older search backward from a
    seed is the search from its reverse complement.
    """
    spark = reads.sparkSession
    seeds = stored(seed.select("kmer").distinct()) if isinstance(seed, DataFrame) else spark.createDataFrame([(seed,)], "kmer string")
    ends = spark.createDataFrame([(x, i) for i, x in enumerate(end_seeds)], "kmer string, end int")
    own = stored(stranded_sum(reads, k))
    counted = own if count_k in (None, k) else stored(stranded_sum(reads, count_k))
    longer = stored(longer_counts(reads, k, dollars))
    e = stored(ways(longer, k, threshold).join(F.broadcast(ends.select(F.col("kmer").alias("u"))), "u", "left_anti"))
    firm_in = stored(firm_ways_in(longer, k, threshold))
    heavy = stored(own.filter(F.col("cnt") > overload).select("kmer"))

    # a way without a choice: the only one out, into a k-mer that no other firm way enters
    entered = e.join(firm_in.withColumnRenamed("kmer", "v"), "v", "left").withColumn("others", F.coalesce("n_firm", F.lit(0)) - F.col("firm").cast("int"))
    plain = F.col("only") & (F.col("others") == 0) & ~F.col("v").isin(list(end_seeds))
    entered = stored(entered.withColumn("plain", plain).join(seeds.select(F.col("kmer").alias("v"), F.lit(True).alias("is_seed")), "v", "left"))
    entered = entered.withColumn("plain", F.col("plain") & F.col("is_seed").isNull()).select("u", "v", "sym", "cnt", "firm", "only", "plain")
    step = stored(entered.filter("plain").select("u", "v"))
    levels, last, circles = _jumps(step)
    last = stored(last)

    far = F.lit(max_distance if max_distance is not None else 1 << 62)
    known = stored(seeds.withColumn("distance", F.lit(0).cast("long")))
    front = known
    while True:
        begin = front.filter(F.col("distance") < far).join(heavy, "kmer", "left_anti")
        stretch = begin.join(last.withColumnRenamed("u", "kmer"), "kmer", "left").select(F.coalesce("last", "kmer").alias("u"), (F.col("distance") + F.coalesce("n", F.lit(0)) + 1).alias("distance"))
        met = stretch.join(entered.filter(~F.col("plain")).select("u", F.col("v").alias("kmer")), "u").select("kmer", "distance")
        nearer = _nearest(met).join(known.withColumnRenamed("distance", "old"), "kmer", "left").filter(F.col("old").isNull() | (F.col("distance") < F.col("old"))).drop("old")
        merged = _nearest(known.unionByName(nearer)).orderBy("distance", "kmer").limit(4 * max_nodes + len(end_seeds) + 1)
        merged = stored(merged)
        front = stored(nearer.join(merged, ["kmer", "distance"], "left_semi"))
        known = merged
        if front.isEmpty():
            break

    # all that is reached: each start with the stretch behind it
    met = stored(known.filter(F.col("distance") < far).join(heavy, "kmer", "left_anti").select(F.col("kmer").alias("u")))
    held = -1
    while True:
        for level in levels:
            met = stored(met.unionByName(met.join(level, "u").select(F.col("to").alias("u"))).distinct())
        if not circles or held == (held := met.count()):
            break  # circles have no end, so they are gone round until nothing new is met
    walked = stored(entered.join(met, "u", "left_semi"))

    # several ways in, firm or walked
    into = walked.groupBy(F.col("v").alias("kmer")).agg(F.count(F.lit(1)).alias("n_in"), F.count_if(~F.col("firm")).alias("weak"), F.max((~F.col("only")).cast("int")).alias("split"))
    into = into.join(firm_in, "kmer", "left").withColumn("n_ways", F.coalesce("n_firm", F.lit(0)) + F.col("weak"))
    heads = into.filter((F.col("n_ways") > 1) | (F.col("split") == 1)).select("kmer")
    heads = stored(heads.unionByName(seeds).unionByName(ends.select("kmer").join(into, "kmer", "left_semi")).distinct())
    inner = stored(walked.join(heads.select(F.col("kmer").alias("v")), "v", "left_anti").select(F.col("v").alias("u"), F.col("u").alias("v")))
    _, back, _ = _jumps(inner)
    places = heads.select("kmer", F.col("kmer").alias("head"), F.lit(0).cast("long").alias("pos")).unionByName(back.select(F.col("u").alias("kmer"), F.col("last").alias("head"), F.col("n").alias("pos")))
    places = stored(places)

    # nodes, their neighbours and distances; a node that is stopped is not left
    stop = stored(heads.join(heavy, "kmer", "left_semi"))
    tails = places.groupBy("head").agg(F.max("pos").alias("top"), F.max_by("kmer", "pos").alias("tail"))
    tails = stored(tails)
    links = walked.join(tails.select(F.col("tail").alias("u"), "head", "top"), "u").join(heads.select(F.col("kmer").alias("v")), "v", "left_semi")
    links = links.join(stop.withColumnRenamed("kmer", "head"), "head", "left_anti")
    links = stored(links.select("head", F.col("v").alias("to"), (F.col("top") + 1).alias("n"), "cnt", "firm", "only", "sym"))
    dist = stored(seeds.withColumn("distance", F.lit(0).cast("long")))
    front = dist
    while True:
        met = front.filter(F.col("distance") < far).join(links.select(F.col("head").alias("kmer"), "to", "n"), "kmer").select(F.col("to").alias("kmer"), (F.col("distance") + F.col("n")).alias("distance"))
        nearer = _nearest(met).join(dist.withColumnRenamed("distance", "old"), "kmer", "left").filter(F.col("old").isNull() | (F.col("distance") < F.col("old"))).drop("old")
        front = stored(nearer)
        if front.isEmpty():
            break
        dist = stored(_nearest(dist.unionByName(front)))
    numbered = dist.withColumn("node_id", (F.row_number().over(W.orderBy("distance", "kmer")) - 1).cast("int"))  # a bounded table
    numbered = stored(numbered.join(F.broadcast(ends), "kmer", "left").withColumn("open", (F.col("node_id") < max_nodes) & (F.col("distance") < far) & F.col("end").isNull()))
    source = numbered.filter("open").select(F.col("kmer").alias("head"), F.col("node_id").alias("source"))
    target = numbered.select(F.col("kmer").alias("to"), F.col("node_id").alias("target"))
    edges = stored(links.join(source, "head").join(target, "to").select("source", "target", "cnt", F.when(F.col("firm"), "solid").otherwise("dashed").alias("style"), "only", "firm"))
    shown = edges.select(F.col("target").alias("node_id")).unionByName(numbered.filter("distance = 0").select("node_id")).distinct()
    d = numbered.join(shown, "node_id", "left_semi").join(stop.withColumn("stopped", F.lit(True)), "kmer", "left")
    d = d.join(edges.filter("only").select(F.col("source").alias("node_id"), "target", "firm"), "node_id", "left")
    d = d.join(tails.select(F.col("head").alias("kmer"), "tail"), "kmer")
    n_out = walked.groupBy(F.col("u").alias("tail")).agg(F.count(F.lit(1)).alias("n_out"))
    d = stored(d.join(n_out, "tail", "left"))
    whole = F.col("open") & F.col("stopped").isNull()
    state = (
        F.when(F.col("end").isNotNull(), F.concat(F.lit("END_SEED_"), F.col("end")))
        .when(F.col("node_id") >= max_nodes, "UNEXPLORED_NODE")
        .when(F.col("distance") >= far, "UNEXPLORED_DIST")
        .when(F.col("kmer").endswith("$"), "$ Ext")
        .when(F.col("stopped"), "OVERLOAD")
        .when(F.col("tail").endswith("$"), "$ Max")
        .when(F.col("n_out") > 1, "SPLIT")
        .when(F.col("target").isNotNull(), F.concat(F.lit("MERGE_"), F.col("target"), F.when(F.col("firm"), "").otherwise(", THRESHOLD")))
        .otherwise("TERMINAL")
    )
    named = stored(d.select("node_id", F.col("kmer").alias("head"), "distance", state.alias("state"), whole.alias("whole")))
    inside = named.join(places, "head").filter(F.col("whole") | (F.col("pos") == 0)).select("node_id", "pos", "kmer")
    cut = lambda c: F.substr(c, F.greatest(F.length(c) - (count_k or k) + 1, F.lit(1)))
    inside = stored(inside.withColumn("asked", cut(F.col("kmer"))).join(counted.withColumnRenamed("kmer", "asked"), "asked", "left").select("node_id", "pos", "kmer", F.coalesce("cnt", F.lit(0)).alias("cnt")))
    listed = F.array_sort(F.collect_list(F.struct("pos", "kmer", "cnt")))
    rows = inside.groupBy("node_id").agg(listed.alias("x"))
    seq = F.concat(F.get("x.kmer", F.lit(0)), F.array_join(F.transform(F.slice("x", 2, F.greatest(F.size("x") - 1, F.lit(0))), lambda y: F.substring(y["kmer"], k, 1)), ""))
    pileup = F.transform(F.filter("x", lambda y: ~y["kmer"].endswith("$")), lambda y: y["cnt"])
    rows = rows.select("node_id", seq.alias("seq"), pileup.alias("pileup"))
    rc = inside.select("node_id", reverse_complement(F.col("kmer")).alias("kmer")).join(inside.select(F.col("node_id").alias("other"), "kmer"), "kmer")
    inverted = rc.groupBy("node_id").agg(F.array_sort(F.collect_set("other")).alias("inverted"))
    nodes = named.select("node_id", "distance", "state").join(rows, "node_id").join(inverted, "node_id", "left")
    nodes = nodes.select("node_id", "seq", "distance", "state", "pileup", F.coalesce("inverted", F.array().cast("array<int>")).alias("inverted"))
    return nodes, edges.select("source", "target", "cnt", "style")


def _node_kmers(nodes: DataFrame, k: int) -> DataFrame:
    """(node_id, kmer, direction): a node's k-mers as they are (0) and reverse complemented (1)."""
    n = nodes.select("node_id", F.explode(windows(F.col("seq"), k)).alias("kmer"), F.lit(0).alias("direction")).distinct()
    return n.unionByName(n.select("node_id", reverse_complement(F.col("kmer")).alias("kmer"), F.lit(1).alias("direction")))


def _node_hits(nodes: DataFrame, reads: DataFrame, k: int, *columns: Column) -> DataFrame:
    """(node_id, direction, columns): reads that hold a k-mer of a node as it is (0) or reverse complemented (1)."""
    n = _node_kmers(nodes, k)
    r = reads.select(*columns, F.explode(F.array_distinct(windows(F.col("seq"), k))).alias("kmer"))
    return r.join(n, "kmer").drop("kmer").distinct()


def node_reads(nodes: DataFrame, reads: DataFrame, k: int) -> DataFrame:
    """(node_id, source_id, n_reads): reads of each source that hold a k-mer of a node, either strand."""
    source = F.col("source_id") if "source_id" in reads.columns else F.lit(0).alias("source_id")
    met = _node_hits(nodes, reads, k, F.col("read_rank"), source).select("node_id", "source_id", "read_rank").distinct()
    return met.groupBy("node_id", "source_id").agg(F.count(F.lit(1)).alias("n_reads"))


def node_pairs(nodes: DataFrame, reads: DataFrame, k: int) -> DataFrame:
    """(node_id, other, n_pairs) of nodes met by the two mates of a pair, on opposite strands.

    ``reads`` has file_id, seq_id, mate_file_id and mate_seq_id; reads without a mate take no part. Up to NODE_KMERS k-mers of nodes are
    looked up where mates meet, and pairs of nodes are counted there as numbers before they cross the shuffle.
    """
    paired = reads.filter("mate_file_id is not null and mate_seq_id is not null")
    if 3 * k < 64:
        kmers = stored(_node_kmers(nodes, k))
        size = kmers.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_and(is_valid(F.col("kmer"))), F.lit(True)).alias("valid"), F.coalesce(F.min("node_id"), F.lit(0)).alias("low"), F.coalesce(F.max("node_id"), F.lit(0)).alias("high")).first()
        if size["n"] <= NODE_KMERS and size["valid"] and 0 <= size["low"] and size["high"] < 1 << 31:
            return _counted_pairs(kmers, paired, k, size["high"] + 1, nodes.schema["node_id"].dataType)
    hits = _node_hits(nodes, paired, k, *[F.col(c) for c in ("file_id", "seq_id", "mate_file_id", "mate_seq_id")])
    mates = hits.select(F.col("node_id").alias("other"), (1 - F.col("direction")).alias("direction"), F.col("file_id").alias("mate_file_id"), F.col("seq_id").alias("mate_seq_id"))
    met = hits.join(mates, ["mate_file_id", "mate_seq_id", "direction"])
    return met.groupBy("node_id", "other").agg(F.count(F.lit(1)).alias("n_pairs"))


def _links(paired: DataFrame) -> DataFrame:
    """(a, b, both): the sequences of a read and of its mate. ``both``: the mate's mate is the read, and this line stands for both."""
    own, mate = F.struct("file_id", "seq_id"), F.struct(F.col("mate_file_id").alias("file_id"), F.col("mate_seq_id").alias("seq_id"))
    # rows of one read and mate are one read, as they meet a node once
    d = paired.select(own.alias("own"), mate.alias("mate"), F.coalesce("seq", F.lit("")).alias("seq"))
    d = d.groupBy("own", "mate").agg(F.array_join(F.collect_list("seq"), " ").alias("a"))
    there = d.select(F.col("own").alias("mate"), F.col("mate").alias("back"), F.col("a").alias("b"))
    both = (F.col("back") == F.col("own")) & (F.col("own") != F.col("mate"))
    d = d.join(there.hint("merge"), "mate").withColumn("both", both)
    return d.filter(~F.col("both") | (F.col("own") < F.col("mate"))).select("a", "b", "both")


def _counted_pairs(kmers: DataFrame, paired: DataFrame, k: int, room: int, kind) -> DataFrame:
    """:func:`node_pairs` for node ids below ``room`` and (node_id, kmer, direction) of few nodes' k-mers.

    An unordered pair of nodes is a number and two counts, one for each order. Tasks count them in buckets, which are summed.
    """
    codes = np.full(256, 7, np.int64)
    codes[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))
    t, most = packed._T, PAIRS

    def numbers(text: bytes) -> np.ndarray:
        """The k-mers at all places as numbers; -1 where there is none."""
        d = codes[np.frombuffer(text, np.uint8)]
        n = max(0, len(d) - k + 1)
        x, good = np.zeros(n, np.int64), np.ones(n, bool)
        for j in range(k):
            x = (x << 3) | d[j : j + n]
            good &= d[j : j + n] < 7
        return np.where(good, x, -1)

    def tabled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = numbers("".join(b.column("kmer").to_pylist()).encode())[::k] if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("node_id"), pa.array(x), b.column("direction")], ["node_id", "kmer", "direction"])

    # a checked number of k-mers
    got = kmers.select(F.col("node_id").cast("long").alias("node_id"), "kmer", "direction").mapInArrow(tabled, "node_id long, kmer long, direction int").toArrow()
    held = []
    for way in (0, 1):
        own = got.filter(pa.compute.equal(got.column("direction"), way)).sort_by([("kmer", "ascending"), ("node_id", "ascending")])
        kmer, first, count = np.unique(own.column("kmer").to_numpy(), return_index=True, return_counts=True)
        held.append((kmer, first, count, own.column("node_id").to_numpy().astype(np.int32)))
    known = kmers.sparkSession.sparkContext.broadcast(held)

    size = paired.agg(F.coalesce(F.sum(F.length("seq").cast("double") * F.length("seq")), F.lit(0.0)).alias("n")).first()["n"]
    buckets = int(min(60_000, max(1, min(size, float(room) * room) / 2 // most)))

    def spread(count: np.ndarray) -> np.ndarray:
        """0, 1, ... of each of the counts."""
        return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)

    def hits(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """(line, node) of either direction, each once, in order."""
        text = column.to_pylist()
        x = numbers(" ".join(text).encode())
        line = np.repeat(np.arange(len(text)), [len(s) + 1 for s in text])[: len(x)]
        out = []
        for kmer, first, count, node in known.value:
            if not len(kmer):
                out.append((np.zeros(0, np.int64),) * 2)
                continue
            i = np.minimum(np.searchsorted(kmer, x), len(kmer) - 1)
            met = np.nonzero(kmer[i] == x)[0]
            i = i[met]
            both = np.unique((np.repeat(line[met], count[i]) << 32) | node[np.repeat(first[i], count[i]) + spread(count[i])])
            out.append((both >> 32, both & 0xFFFFFFFF))
        return out

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(number, one for the smaller node first, one for the larger first) of all pairs, in parts."""
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                flag = part.column("both").to_numpy(zero_copy_only=False)
                a, b = hits(part.column("a")), hits(part.column("b"))
                for way in (0, 1):
                    (line, node), (mate, other) = a[way], b[1 - way]
                    begin, end = (np.searchsorted(mate, line, s) for s in ("left", "right"))
                    upto = np.cumsum(end - begin)
                    low = 0
                    while low < len(line):
                        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + most, "right")))
                        n = (end - begin)[low:high]
                        u = np.repeat(node[low:high], n)
                        v = other[np.repeat(begin[low:high], n) + spread(n)]
                        both = np.repeat(flag[line[low:high]], n)
                        yield np.minimum(u, v) * room + np.maximum(u, v), both | (u <= v), both | (u > v)
                        low = high

    def summed(number: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.argsort(number)
        number = number[order]
        first = np.nonzero(np.concatenate([[True], number[1:] != number[:-1]]))[0]
        return (number[first], *[np.add.reduceat(c[order].astype(np.int64), first) for c in counts])

    def counted(parts: list) -> Iterator[pa.RecordBatch]:
        number, one, two = (np.concatenate([p[i] for p in parts]) for i in range(3))
        if one.all() and two.all():  # each pair is met in both orders
            number, one = np.unique(number, return_counts=True)
            two = one
        else:
            number, one, two = summed(number, one, two)
        bucket = (number // room % buckets).astype(np.uint16)
        order = np.argsort(bucket, kind="stable")
        number, one, two = number[order], one[order], two[order]
        number = number // room // buckets * room + number % room
        ends = np.cumsum(np.bincount(bucket, minlength=buckets)).tolist()
        lines = [(g, t["put"](np.diff(number[a:b], prepend=0)), t["put"](one[a:b]), t["put"](two[a:b] - one[a:b])) for g, (a, b) in enumerate(zip([0, *ends], ends)) if a < b]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in lines], kind) for i, kind in enumerate([pa.int32(), *[pa.binary()] * 3])], ["bucket", "number", "one", "two"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for p in pairs(batches):
            parts.append(p)
            n += len(p[0])
            if n >= 2 * most:
                yield from counted(parts)
                parts, n = [], 0
        if n:
            yield from counted(parts)

    def total(group: pa.Table) -> pa.Table:
        column = lambda c: [t["got"](x) for x in group.column(c).to_pylist()]
        one, two = np.concatenate(column("one")), np.concatenate(column("two"))
        number, one, two = summed(np.concatenate([np.cumsum(x) for x in column("number")]), one, one + two)
        u, v = number // room * buckets + group.column("bucket")[0].as_py(), number % room
        same = u == v
        one[same] += two[same]
        two[same] = 0
        n = np.concatenate([one, two])
        met = n > 0
        return pa.table({"node_id": np.concatenate([u, v])[met], "other": np.concatenate([v, u])[met], "n_pairs": n[met]})

    d = _links(paired).mapInArrow(count, "bucket int, number binary, one binary, two binary").repartition(min(buckets, 2048), "bucket")
    d = d.groupBy("bucket").applyInArrow(total, "node_id long, other long, n_pairs long")
    return d.select(F.col("node_id").cast(kind).alias("node_id"), F.col("other").cast(kind).alias("other"), "n_pairs")
