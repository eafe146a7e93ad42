"""Near duplicates by a MinHash LSH forest.

A signature of 63 minima is read in 21 orders (trees), each a rotation. Texts that share the first DEPTH values of an
order lie in one region; a region of up to SMALL texts gives all its pairs. In a larger one the texts are sorted by the
rest of their order, and each looks at its neighbours on both sides, from the longest common prefix to shorter ones,
until one agrees enough: the depth adapts to how crowded the region is. Pairs are confirmed on full sets, best pairs
first; linked texts need no further pairs. What a large region still holds in several components meets the region's
hub, and what is left then outside its main component is compared, in blocks and on full sets, with all of the region,
so no link is lost to a region's size. Exact copies are one set from the start, and sets, not documents, are the nodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import hot_keys, materialize, salted_join
from readloom.llm.components import components, joined
from readloom.llm.shingles import shingle_runs

VALUES, DEPTH, TREES = 63, 3, 21
SMALL = 24
#: Rows of a sorted order that a text looks back and ahead.
REACH = 8
#: Pairs are not compared if so few signature values agree that a pair at the threshold would do so with at most this probability.
MISS = 1e-9
#: Rounds in which the texts of a large region meet its hub, before the rest is compared in blocks.
HUBS = 2
#: Texts of a block of that comparison.
BLOCK = 128
_A = (np.random.default_rng(20240131).integers(1, 1 << 31, VALUES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = np.random.default_rng(77).integers(0, 1 << 32, VALUES, dtype=np.uint32)


def least_agreement(percent: int) -> int:
    """The number of agreeing values that a pair of this similarity falls short of with a probability of at most MISS."""
    s, miss, t = percent / 100, 0.0, 0
    while t < VALUES and (miss := miss + comb(VALUES, t) * s**t * (1 - s) ** (VALUES - t)) <= MISS:
        t += 1
    return t


def _minima(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The signatures, a row each, of the sets that begin at ``starts``."""
    x = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), VALUES), np.uint32)
    for k in range(VALUES if len(starts) else 0):
        out[:, k] = np.minimum.reduceat((x ^ _B[k]) * _A[k], starts)
    return out.view(np.int32)


def _digests(values: np.ndarray, sizes: np.ndarray) -> list[bytes | None]:
    """A 128-bit key of each set; None for empty ones."""
    ends = np.cumsum(sizes)
    return [xxhash.xxh3_128_digest(values[a:b].tobytes()) if b > a else None for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(ident, n_shingles, set_key, sig) of (ident, text); key and signature are null for texts without words."""
    kind = docs.schema["ident"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for values, sizes in shingle_runs(batch.column("text").to_pylist(), width):
                held = sizes > 0
                sig = _minima(values, (np.cumsum(sizes) - sizes)[held])
                sigs = _lists(sig.ravel(), np.full(len(sig), VALUES), pa.int32()).take(pa.array(np.cumsum(held) - 1, pa.int64(), mask=~held))
                yield pa.RecordBatch.from_arrays([batch.column("ident").slice(done, len(sizes)), pa.array(sizes, pa.int64()), pa.array(_digests(values, sizes), pa.binary()), sigs], ["ident", "n_shingles", "set_key", "sig"])
                done += len(sizes)

    return docs.select("ident", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"ident {kind}, n_shingles long, set_key binary, sig array<int>")


def shingle_table(docs: DataFrame, width: int) -> DataFrame:
    """(set_key, shingles) of (text), texts without words left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for values, sizes in shingle_runs(batch.column("text").to_pylist(), width):
                keys = pa.array(_digests(values, sizes), pa.binary())
                out = pa.RecordBatch.from_arrays([keys, _lists(values.view(np.int64), sizes, pa.int64())], ["set_key", "shingles"])
                yield out.filter(keys.is_valid())

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "set_key binary, shingles array<bigint>")


def _agree(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _sorted_neighbours(large: DataFrame, reps: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b, agree) of neighbours in the sorted orders of large regions; ranges, not regions, are tasks."""
    trees = large.groupBy("node").agg(F.collect_list(F.struct("tree", "key")).alias("trees"))  # at most TREES
    twice = F.concat("sig", "sig")
    rest = F.transform("trees", lambda x: F.struct(x["key"].alias("key"), F.slice(twice, (x["tree"] + 1) * DEPTH + 1, VALUES - DEPTH).alias("rest")))
    d = trees.join(reps, "node").select("node", F.explode(rest).alias("x")).select("x.key", "x.rest", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, nodes = np.zeros(0, np.int64), np.zeros((0, VALUES - DEPTH), np.int32), pa.array([], pa.binary())
        for batch in batches:
            # the last rows of the batch before are looked at once more
            old = len(key)
            key = np.concatenate([key, batch.column("key").to_numpy()])
            rows = np.concatenate([rows, batch.column("rest").flatten().to_numpy().reshape(-1, VALUES - DEPTH)])
            nodes = pa.concat_arrays([nodes, batch.column("node")])
            n = len(key)
            agree = np.full((REACH, n), -1, np.int16)
            for w in range(1, min(REACH, n - 1) + 1):
                both = (rows[w:] == rows[:-w]).sum(1) + DEPTH
                agree[w - 1, w:] = np.where(key[w:] == key[:-w], both, -1)
            good = agree >= least
            back = np.flatnonzero(good.any(0))
            w = good[:, back].argmax(0)
            fresh = back >= old
            one, two, n_agree = [back[fresh]], [(back - w - 1)[fresh]], [agree[w, back][fresh]]
            ahead = np.zeros((REACH, n), bool)
            for w in range(1, min(REACH, n - 1) + 1):
                ahead[w - 1, :-w] = good[w - 1, w:]
            at = np.flatnonzero(ahead.any(0))
            w = ahead[:, at].argmax(0)
            one.append(at)
            two.append(at + w + 1)
            n_agree.append(agree[w, at + w + 1])
            a, b = (pa.array(np.concatenate(x)) for x in (one, two))
            yield pa.RecordBatch.from_arrays([nodes.take(a), nodes.take(b), pa.array(np.concatenate(n_agree).astype(np.int32))], ["a", "b", "agree"])
            key, rows, nodes = key[-REACH:], rows[-REACH:], nodes[-REACH:]

    pairs = d.repartitionByRange("key", "rest", "node").sortWithinPartitions("key", "rest", "node").mapInArrow(run, "a binary, b binary, agree int")
    return pairs.select(*_pair(F.col("a"), F.col("b")), "agree")


def _members(reps: DataFrame) -> DataFrame:
    """(key, node, tree, n) of the regions of several texts; the key stands for a tree and DEPTH values of its order."""
    twice = F.concat("sig", "sig")
    keys = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.xxhash64(t, F.slice(twice, t * DEPTH + 1, DEPTH)))
    keys = reps.select("node", F.posexplode(keys).alias("tree", "key"))
    regions = materialize(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    return materialize(salted_join(keys, regions, "key", hot_keys(regions, "key"), F.col("node")))


def _small_pairs(members: DataFrame, reps: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b, agree) of all texts in the same small region."""
    small = members.filter(F.col("n") <= SMALL).select("key", "node")
    pairs = small.select("key", F.col("node").alias("a")).join(small.select("key", F.col("node").alias("b")), "key").filter("a < b").select("a", "b").distinct()
    one = reps.select(F.col("node").alias("a"), F.col("sig").alias("sa"))
    two = reps.select(F.col("node").alias("b"), F.col("sig").alias("sb"))
    d = pairs.join(one, "a").join(two, "b").select("a", "b", _agree(F.col("sa"), F.col("sb")).alias("agree"))
    return d.filter(F.col("agree") >= least)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the similarity on full sets; a text in many pairs is dealt over several tasks."""
    pairs = materialize(pairs.select("a", "b"))
    for side, other, name in (("a", "b", "s"), ("b", "a", "t")):
        hot = hot_keys(pairs.groupBy(side).agg(F.count(F.lit(1)).alias("n")), side)
        found = pairs if side == "a" else found
        found = salted_join(found, sets.select(F.col("node").alias(side), F.col("shingles").alias(name)), side, hot, F.col(other))
    both = F.size(F.array_intersect("s", "t"))
    d = found.select("a", "b", both.alias("both"), (F.size("s") + F.size("t")).alias("sum"))
    return d.filter(F.col("both") * 100 >= (F.col("sum") - F.col("both")) * percent).select("a", "b")


def _unlinked(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    one = comp.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    two = comp.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    d = pairs.join(one, "a", "left").join(two, "b", "left")
    return d.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).drop("ca", "cb")


def _split(large: DataFrame, comp: DataFrame) -> DataFrame:
    """(key, node, component, main, all) of the texts of large regions that hold several components; main: the largest."""
    d = materialize(large.select("key", "node").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node")))
    sizes = d.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    several = sizes.groupBy("key").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("parts"), F.max_by("component", F.struct("n", "component")).alias("main")).filter("parts > 1").drop("parts")
    several = materialize(several)
    return materialize(salted_join(d, several, "key", hot_keys(several, "key", "all"), F.col("node")))


def _hub_pairs(split: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) of a region's texts with its hub, where their components differ; the hub is the text nearest to its commonest signature.

    After the first round ``split`` has the texts outside the main component only, and their own hub.
    """
    d = materialize(split.join(reps, "node"))
    common = d.groupBy("key").agg(F.array(*[F.mode(F.get("sig", F.lit(k))) for k in range(VALUES)]).alias("common"))
    hot = hot_keys(d.groupBy("key").agg(F.first("all").alias("n")), "key")
    near = salted_join(d, common, "key", hot, F.col("node")).groupBy("key").agg(F.max_by(F.struct("node", "component"), F.struct(_agree(F.col("sig"), F.col("common")), "node")).alias("hub"))
    out = salted_join(split, near, "key", hot, F.col("node")).filter(F.col("hub.component") != F.col("component"))
    return out.select(*_pair(F.col("node"), F.col("hub.node"))).distinct()


def _across(split: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components of a large region: blocks of the texts outside the main component are compared
    with blocks of all its texts on full sets; of a text's links to one component one is given."""
    d = split.join(sets, "node").withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.col("all") / BLOCK)))
    blocks = lambda x, name: x.groupBy("key", "block").agg(F.collect_list(F.struct("node", "component", "shingles")).alias(name))
    left = blocks(d.filter("component <> main"), "left").drop("block")
    right = blocks(d, "right").withColumnRenamed("block", "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found_a, found_b = [], []
            for i in range(batch.num_rows):
                # flatten() minds the offsets of a slice, field() does not
                ix, cx, sx = batch.column("left")[i].values.flatten()
                iy, cy, sy = batch.column("right")[i].values.flatten()
                ix, cx, iy, cy = (v.to_pylist() for v in (ix, cx, iy, cy))
                sizes = np.diff(sy.offsets.to_numpy())
                values, owner = sy.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
                order = np.argsort(values, kind="stable")
                values, owner = values[order], owner[order]
                for own, mine, one in zip(ix, cx, sx, strict=True):
                    x = one.values.to_numpy()
                    low = np.searchsorted(values, x, "left")
                    n = np.searchsorted(values, x, "right") - low
                    at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    both = np.bincount(owner[at], minlength=len(sizes))
                    first: dict = {}
                    for j in np.nonzero(100 * both >= percent * (len(x) + sizes - both))[0].tolist():
                        if cy[j] != mine:
                            first.setdefault(cy[j], iy[j])
                    found_a += [own] * len(first)
                    found_b += list(first.values())
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.binary()), pa.array(found_b, pa.binary())], ["a", "b"])

    return left.join(right, "key").select("left", "right").mapInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(ident, n_shingles, component_id, kept) for every row of ``docs``.

    Texts with 100 * intersection >= percent * union of their sets of ``width``-word shingles are linked; component_id
    is the smallest id reachable. Null and blank texts have no shingles and no links. Rows of one id are one document,
    which has the links of all its texts. A row whose id is null takes no part: its component is null and it is kept.
    Texts of any length are read whole. An empty table gives no rows; other columns are left out, whatever their names.
    """
    held = docs.select(F.col(ident).alias("ident"), F.col(text).alias("text"))
    sig = materialize(signatures(held, width))
    full = sig.filter("set_key is not null and ident is not null")
    groups = full.groupBy("set_key").agg(F.min("ident").alias("ident"), F.count(F.lit(1)).alias("n"), F.first("sig").alias("sig"))
    groups = materialize(groups.withColumnRenamed("set_key", "node"))
    reps = groups.select("node", "sig")
    least = least_agreement(percent)
    members = _members(reps)
    large = members.filter(F.col("n") > SMALL)
    hot = not large.isEmpty()
    pairs = _small_pairs(members, reps, least)
    if hot:
        pairs = pairs.unionByName(_sorted_neighbours(large, reps, least)).distinct()
    pairs = materialize(pairs)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    wanted = (wanted.unionByName(large.select("node")) if hot else wanted).distinct()
    # one document of each set wanted; another text under its id has another key
    mine = groups.join(wanted, "node", "left_semi").select("ident").distinct()
    sets = shingle_table(held.join(mine, "ident", "left_semi"), width).withColumnRenamed("set_key", "node")
    sets = materialize(sets.join(wanted, "node", "left_semi").dropDuplicates(["node"]))
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("agree", "a")).alias("a"))
    comp = components(_confirmed(best, sets, percent))
    if hot:
        # the hubs link most of what the sorted orders left apart, so that fewer pairs are confirmed
        for turn in range(HUBS):
            split = _split(large, comp)
            outside = split.filter("component <> main") if turn else split
            more = materialize(_confirmed(_hub_pairs(outside, reps), sets, percent))
            if more.isEmpty():
                break
            comp = joined(comp, more)
    comp = joined(comp, _confirmed(_unlinked(pairs, comp), sets, percent))
    if hot and not (split := _split(large, comp)).isEmpty():
        comp = joined(comp, _across(split, sets, percent))
    # an id with several texts links them
    repeated = materialize(sig.filter("ident is not null").groupBy("ident").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    again = not repeated.isEmpty()
    if again:
        spread = hot_keys(repeated, "ident")
        theirs = materialize(salted_join(sig.select("ident", "set_key"), repeated.select("ident"), "ident", spread, F.col("set_key")).distinct())
        first = theirs.groupBy("ident").agg(F.min("set_key").alias("a"))
        comp = joined(comp, theirs.join(first, "ident").filter("a <> set_key").select("a", F.col("set_key").alias("b")))
    named = groups.select("node", "ident", "n").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = materialize(named)
    smallest = comp.select("component").distinct().join(named, "component").groupBy("component").agg(F.min("ident").alias("component_id"))
    named = named.join(smallest, "component", "left").select("node", "n", F.coalesce("component_id", "ident").alias("component_id"))
    named = materialize(named)
    out = salted_join(full.select("ident", "n_shingles", F.col("set_key").alias("node")), named.select("node", "component_id"), "node", hot_keys(named, "node"), F.col("ident"))
    out = out.select("ident", "n_shingles", "component_id")
    bare = sig.filter("set_key is null or ident is null").select("ident", "n_shingles", F.col("ident").alias("component_id"))
    out = out.unionByName(bare)
    if again:
        out = materialize(out)
        theirs = salted_join(out, repeated.select("ident"), "ident", spread, F.col("n_shingles"))
        least_id = theirs.groupBy("ident").agg(F.min("component_id").alias("__least"))
        out = salted_join(out, least_id, "ident", spread, F.col("n_shingles"), "left").withColumn("component_id", F.coalesce("__least", "component_id"))
    return out.select(F.col("ident").alias(ident), "n_shingles", "component_id", F.coalesce(F.col("ident") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` but those of documents that near-duplicate one with a smaller id."""
    gone = near_duplicates(docs, width, percent, text, ident).filter(~F.col("kept")).select(F.col(ident).alias("__gone")).distinct()
    return docs.join(gone, F.col(ident) == F.col("__gone"), "left_anti")
