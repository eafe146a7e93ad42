"""Graph exploration against the same rules written down k-mer by k-mer."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from readloom.operators import graph


def rc(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def brute(reads, seed, k, threshold, overload, max_nodes=10**6, far=10**9, ends=(), dollars=False):
    own, longer = Counter(), Counter()
    for r in reads:
        for x in (r, rc(r)):
            own.update(x[i : i + k] for i in range(len(x) - k + 1))
            y = f"${x}$" if dollars else x
            longer.update(z for z in (y[i : i + k + 1] for i in range(len(y) - k)) if not (z[0] == z[-1] == "$"))
    out, firm_in = defaultdict(dict), Counter()
    for z, n in longer.items():
        if z[0] != "$":
            out[z[:-1]][z[-1]] = n
        firm_in[z[1:]] += n >= threshold

    def ways(u):
        if u in ends:
            return []
        firm = [(a, n, True) for a, n in out[u].items() if n >= threshold]
        weak = sorted(out[u].items(), key=lambda x: (-x[1], x[0]))[:1]
        return [(u[1:] + a, n, f) for a, n, f in (firm or [(a, n, False) for a, n in weak])]

    def plain(u, v, f):
        return len(ways(u)) == 1 and firm_in[v] - f == 0 and v not in ends and v != seed

    dist, todo = {(seed, True): 0}, [(seed, True)]
    for u, start in todo:
        if (start and own[u] > overload) or (start and dist[u, start] >= far):
            continue
        for v, _, f in ways(u):
            if (key := (v, not plain(u, v, f))) not in dist:
                dist[key] = dist[u, start] + 1
                todo.append(key)
    left = {u for (u, s), d in dist.items() if not (s and (own[u] > overload or d >= far))}
    walked = [(u, v, n, f, len(ways(u)) == 1) for u in left for v, n, f in ways(u)]
    heads = {seed}
    for v in {w[1] for w in walked}:
        mine = [w for w in walked if w[1] == v]
        if firm_in[v] + sum(not w[3] for w in mine) > 1 or any(not w[4] for w in mine) or v in ends:
            heads.add(v)
    step = {u: v for u, v, *_ in walked if v not in heads}
    chains = {}
    for h in heads:
        chains[h] = [h]
        while (nxt := step.get(chains[h][-1])) is not None:
            chains[h].append(nxt)
    far_of, todo = {seed: 0}, [seed]
    exits = {h: [] if own[h] > overload else [w for w in walked if w[0] == c[-1] and w[1] in heads] for h, c in chains.items()}
    while todo:
        h = min(todo, key=far_of.get)
        todo.remove(h)
        if far_of[h] >= far:
            continue
        for _, v, *_ in exits[h]:
            d = far_of[h] + len(chains[h])
            if d < far_of.get(v, 1 << 60):
                far_of[v] = d
                todo.append(v)
    ids = {h: i for i, h in enumerate(sorted(far_of, key=lambda h: (far_of[h], h)))}
    opened = {h for h, i in ids.items() if i < max_nodes and far_of[h] < far and h not in ends}
    edges = sorted((ids[h], ids[v], n, "solid" if f else "dashed") for h in opened for _, v, n, f, _ in exits[h])
    shown = {seed} | {v for h in opened for _, v, *_ in exits[h]}
    nodes = {}
    for h in shown:
        full = h in opened and own[h] <= overload
        chain = chains[h] if full else [h]
        if h in ends:
            state = f"END_SEED_{ends.index(h)}"
        elif ids[h] >= max_nodes:
            state = "UNEXPLORED_NODE"
        elif far_of[h] >= far:
            state = "UNEXPLORED_DIST"
        elif h[-1] == "$":
            state = "$ Ext"
        elif own[h] > overload:
            state = "OVERLOAD"
        elif chain[-1][-1] == "$":
            state = "$ Max"
        elif len(ways(chain[-1])) > 1:
            state = "SPLIT"
        elif exits[h]:
            state = f"MERGE_{ids[exits[h][0][1]]}" + ("" if exits[h][0][3] else ", THRESHOLD")
        else:
            state = "TERMINAL"
        nodes[ids[h]] = (chain[0] + "".join(x[-1] for x in chain[1:]), far_of[h], state, [own[x] for x in chain if x[-1] != "$"])
    return nodes, edges


@pytest.mark.parametrize("case", range(4))
def test_graph_by_its_rules(spark, case):
    rng = random.Random(case)
    k = 4 + case % 2
    genome = "".join(rng.choice("ACGT") for _ in range(150))
    genome += genome[20:45] + "".join(rng.choice("ACGT") for _ in range(20))
    reads = []
    for _ in range(160):
        a = rng.randrange(len(genome) - 20)
        r = list(genome[a : a + 20])
        if rng.random() < 0.3:
            r[rng.randrange(20)] = rng.choice("ACGTN")
        reads.append("".join(r))
    seed = genome[30 : 30 + k]
    more = [{}, {"dollars": True}, {"ends": (genome[60 : 60 + k],)}, {"max_nodes": 6, "far": 40}][case]
    overload = 60 if case < 3 else 400
    want, edges = brute(reads, seed, k, 3, overload, **more)
    names = {"ends": "end_seeds", "far": "max_distance"}
    kinds = {"max_nodes": 10**5} | {names.get(a, a): b for a, b in more.items()}
    df = spark.createDataFrame([(i, r) for i, r in enumerate(reads)], "read_rank long, seq string")
    nodes, links = graph.explore(df, seed, k, threshold=3, overload=overload, **kinds)
    got = {r["node_id"]: (r["seq"], r["distance"], r["state"], r["pileup"]) for r in nodes.collect()}
    assert got == want and len(want) > 3
    assert sorted(tuple(r) for r in links.collect()) == edges
    assert not any(r["inverted"] and r["node_id"] not in got for r in nodes.collect())


def test_reads_and_pairs_of_nodes(spark):
    reads = spark.createDataFrame([("AACCGTTA",)] * 12 + [("AACCGGAT",)] * 12, "seq string").withColumn("read_rank", F.monotonically_increasing_id())
    nodes, edges = graph.explore(reads, "AACC", 4, max_nodes=10)
    got = {r["node_id"]: r for r in nodes.collect()}
    assert got[0]["seq"] == "AACCG" and got[0]["state"] == "SPLIT" and edges.filter("source = 0").count() == 2
    assert graph.node_reads(nodes, reads, 4).filter("node_id = 0").first()["n_reads"] == 24
    two = spark.createDataFrame([(0, "AACCTT"), (1, "GGTACA")], "node_id int, seq string")
    rows = [(0, 1, "AACCT", 1, 1), (1, 1, rc("GTACA"), 0, 1), (0, 2, "AACCT", 1, 2), (1, 2, "GTACA", 0, 2), (0, 3, "AACCT", None, None)]
    mates = spark.createDataFrame(rows, "file_id int, seq_id long, seq string, mate_file_id int, mate_seq_id long")
    assert {tuple(r) for r in graph.node_pairs(two, mates, 4).collect()} == {(0, 1, 1), (1, 0, 1)}
