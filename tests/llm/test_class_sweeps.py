"""Exchange sweeps over all counted words, and scores against a model recomputed from the classes alone."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.llm import class_lm


def logx(x):
    return x * math.log(x) if x > 0 else 0.0


def likelihood(cls, near, classes, width):
    table = np.zeros((classes, width))
    for w, row in near.items():
        for ctx, n in row.items():
            table[cls[w], ctx] += n
    k = width // 2
    return sum(map(logx, table.ravel())) - sum(logx(x) for half in (table[:, :k], table[:, k:]) for x in half.sum(1))


def random_words(rng, many, width):
    """Neighbours of words, as many successors as predecessors."""
    k, near = width // 2, {}
    for w in range(many):
        row, n = Counter(), rng.randrange(1, 30)
        for _ in range(n):
            row[rng.choice([w % 3, rng.randrange(k)])] += 1
            row[k + rng.choice([w % 2, rng.randrange(k)])] += 1
        near[w] = row
    return near


def test_best_place_is_the_brute_force_one():
    rng = random.Random(1)
    classes, width = 4, 12
    near = random_words(rng, 40, width)
    cls = {w: rng.randrange(classes) for w in near}
    table = np.zeros((classes, width))
    for w, row in near.items():
        for ctx, n in row.items():
            table[cls[w], ctx] += n
    places = class_lm.Places(table)
    assert places.likelihood() == pytest.approx(likelihood(cls, near, classes, width))
    size = np.array([len(r) for r in near.values()])
    ctx = np.array([c for r in near.values() for c in r])
    n = np.array([x for r in near.values() for x in r.values()], float)
    total = np.array([sum(r.values()) / 2 for r in near.values()])
    got = places.best(size, ctx, n, total, np.array(list(cls.values())))
    for w in near:
        value = [likelihood(cls | {w: c}, near, classes, width) for c in range(classes)]
        assert value[got[w]] == pytest.approx(max(value), abs=1e-6)
    assert (got != np.array(list(cls.values()))).any()


def test_sweeps_move_words_outside_and_inside_the_core(spark):
    """Two kinds of words that begin in each other's classes part, and the likelihood never falls."""
    classes, width, core = 2, 8, 6
    kind = {w: w % 2 for w in range(60)}
    near = {w: Counter({kind[w]: 9, 1 - kind[w]: 1, 4 + kind[w]: 8, 4 + 1 - kind[w]: 2}) for w in range(60)}
    rng = random.Random(3)
    cls = {w: kind[w] if rng.random() < 0.7 else 1 - kind[w] for w in near}
    rows = [(f"w{w}".encode(), None, 10, [(c, n) for c, n in near[w].items()], cls[w]) for w in range(core, 60)]
    words = spark.createDataFrame(rows, f"word binary, id int, n long, near {class_lm.NEAR}, cls int").repartition(3)
    dense = np.zeros((core, width))
    for w in range(core):
        for c, n in near[w].items():
            dense[w, c] = n
    begun = np.array([cls[w] for w in range(core)] + [2, 3])
    got, own = class_lm.swept(words, begun, dense)
    after = {int(r["word"][1:]): r["cls"] for r in got.collect()} | dict(enumerate(own.tolist()))
    assert after.keys() == near.keys() and begun[:core].tolist() == [cls[w] for w in range(core)]
    assert all((after[w] == after[v]) == (kind[w] == kind[v]) for w in near for v in near)
    assert likelihood(after, near, classes, width) > likelihood(cls, near, classes, width)


def test_scores_are_those_of_the_classes(spark, monkeypatch):
    """Scores recomputed in plain Python from each word's class; probabilities of words in a class and of moves sum to 1."""
    monkeypatch.setattr(class_lm, "CORE", 12)
    monkeypatch.setattr(class_lm, "HEAD", 20)
    monkeypatch.setattr(class_lm.exchange, "__defaults__", (4, 6))
    rng = random.Random(9)
    texts = [" ".join(f"v{int(rng.paretovariate(0.7)) % 90}" for _ in range(rng.randrange(60))) for _ in range(80)] + ["", None, "new1 new2 v1", "v1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = {}
    sent = class_lm.Model.sent
    monkeypatch.setattr(class_lm.Model, "sent", lambda m: seen.setdefault("model", m) and sent(m))
    got = {r["doc_id"]: r for r in class_lm.score(docs, F.col("doc_id") % 4 != 0).collect()}
    m = seen["model"]
    tokens = [(t or "").split() for t in texts]
    counts = Counter(w for i, t in enumerate(tokens) if i % 4 for w in t)
    head = sorted(counts, key=lambda w: (-counts[w], w.encode()))[:20]
    cls = {w: int(m.cls[i]) for i, w in enumerate(head)}
    others = {(r["word"] or head[r["id"]].encode()).decode(): r["cls"] for r in m.others.collect()}
    assert all(cls.get(w, c) == c for w, c in others.items()) and {w for w in counts if counts[w] >= 3} <= cls.keys() | others.keys()
    cls |= others
    place = lambda w: cls.get(w, m.rare)
    mass, rare = Counter(), [w for w in counts if place(w) == m.rare]
    for w, n in counts.items():
        mass[place(w)] += n
    unit = mass[m.rare] + 0.1 * (len(rare) + 1)
    emit = lambda w: counts[w] / mass[place(w)] if place(w) != m.rare else (counts[w] + 0.1) / unit
    sums = Counter()
    for w in counts:
        sums[place(w)] += emit(w)
    sums[m.rare] += 0.1 / unit  # all unknown words
    assert all(x == pytest.approx(1) for x in sums.values())
    moves = Counter()
    ways = [[m.end, *[place(w) for w in t], m.end] for t in tokens]
    for i, way in enumerate(ways):
        if i % 4:
            moves.update(zip(way, way[1:], strict=False))
    out = Counter()
    for (a, _), n in moves.items():
        out[a] += n
    p = lambda a, b: (moves[a, b] + 0.1) / (out[a] + 0.1 * m.k)
    assert all(sum(p(a, b) for b in range(m.k)) == pytest.approx(1) for a in range(m.k))
    for i, (t, way) in enumerate(zip(tokens, ways, strict=True)):
        want = sum(math.log10(p(a, b)) for a, b in zip(way, way[1:], strict=False)) + sum(math.log10(emit(w)) for w in t)
        assert got[i]["score"] == pytest.approx(want)


def test_no_training_rows_and_very_long_texts(spark):
    long = " ".join(f"x{i % 700}" for i in range(300_000))
    docs = spark.createDataFrame([(1, long), (2, None), (2, "x1 x2"), (3, "")], "doc_id long, text string")
    none = class_lm.score(docs, F.lit(False)).collect()
    assert len(none) == 4 and all(r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in none)
    got = {(r["doc_id"], r["n_tokens"]): r for r in class_lm.score(docs, F.col("doc_id") == 1).collect()}
    assert got[1, 300_001]["n_known"] == 300_001 and got[2, 3]["n_known"] == 3 and got[3, 1]["n_known"] == 1
