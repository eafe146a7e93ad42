"""Nothing is left out: cases that bounded forms of the operators missed."""

import random

from readloom.llm import class_lm


def test_words_beyond_the_core_get_classes(spark, monkeypatch):
    """Two kinds of words alternate; words outside core and head are put among their own kind and score by it."""
    rng = random.Random(5)
    kinds = [[f"{x}{i}" for i in range(120)] for x in "ab"]
    rows = [(d, " ".join(rng.choice(kinds[i % 2]) for i in range(100))) for d in range(60)]
    monkeypatch.setattr(class_lm, "CORE", 30)
    monkeypatch.setattr(class_lm, "HEAD", 60)
    monkeypatch.setattr(class_lm.exchange, "__defaults__", (2, 6))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = {}

    def spy(codes, head, own, table):
        seen["core"] = {w: int(c) for w, c in zip(head, own[:30], strict=False)}
        seen["others"] = {bytes(r["word"]) if r["word"] else head[r["id"]]: r["cls"] for r in assigned(codes, head, own, table).collect()}
        return assigned(codes, head, own, table)

    assigned = class_lm.assigned
    monkeypatch.setattr(class_lm, "assigned", spy)
    from pyspark.sql import functions as F

    got = class_lm.score(docs, F.lit(True)).collect()
    every = seen["core"] | seen["others"]
    assert len(every) == 240
    of = [{every[w.encode()] for w in k} for k in kinds]
    assert len(of[0]) == len(of[1]) == 1 and of[0] != of[1]
    # a class says which half of the words comes next
    assert all(r["score"] > r["base_score"] + 0.25 * 90 for r in got)


def test_repeated_ids_with_other_texts(spark):
    """An id with two texts has the links of both, whatever the order of the rows."""
    from readloom.llm import near_dedup

    a = " ".join(f"a{i}" for i in range(60))
    b = " ".join(f"b{i}" for i in range(60))
    rows = [(3, a), (3, b), (2, b + " more"), (7, a + " more"), (7, None), (9, "else where now")]
    for some in (rows, rows[::-1]):
        got = {(r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(spark.createDataFrame(some, "doc_id long, text string"), 3, 85).collect()}
        assert got == {(3, 2), (2, 2), (7, 2), (9, 9)}


def test_rest_of_large_regions_is_exact(spark, monkeypatch):
    """With no neighbours from the forest's sorted orders, hubs and blocks alone find all links of a large region."""
    from readloom.llm import near_dedup

    rng = random.Random(2)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(60):
        words = list(base)
        for j in rng.sample(range(80), rng.choice([0, 1, 2, 3, 5])):
            words[j] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))

    def grams(t):
        w = t.split()
        return {tuple(w[j : j + 3]) for j in range(len(w) - 2)}

    sets, of = [grams(t) for _, t in rows], list(range(60))

    def top(x):
        while of[x] != x:
            x = of[x]
        return x

    for i in range(60):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if 100 * n >= 85 * (len(sets[i]) + len(sets[j]) - n):
                x, y = top(i), top(j)
                of[max(x, y)] = min(x, y)
    none = near_dedup._sorted_neighbours
    monkeypatch.setattr(near_dedup, "_sorted_neighbours", lambda large, reps, least: none(large, reps, 64))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: top(i) for i in range(60)}


def test_agreement_bound():
    from math import comb

    from readloom.llm.near_dedup import VALUES, least_agreement

    for p in (80, 85, 99):
        t = least_agreement(p)
        miss = [sum(comb(VALUES, k) * (p / 100) ** k * (1 - p / 100) ** (VALUES - k) for k in range(n)) for n in (t, t + 1)]
        assert miss[0] <= 1e-9 < miss[1]


def test_cosines_of_very_large_and_small_vectors(spark):
    from readloom.llm import ann

    rows = [(0, [1.0, 1.0]), (1, [1e200, 1e200]), (2, [1e-200, 0.0]), (3, [1e-320, -1e-320]), (4, [-3.0, 1.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda c: c == 0, k=4).collect()
    want = {1: 1.0, 2: 0.5**0.5, 3: 0.0, 4: -2 / 20**0.5}
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == [1, 2, 3, 4]
    assert all(abs(r["score"] - want[r["vec_id"]]) < 1e-12 for r in got)


def test_roles_come_back(spark):
    from pyspark.sql import functions as F

    from readloom.llm.chat import escape_role, unescape_role

    roles = ["user", "a\0b", "a\\nb", "a\nb", "\\", "\\\\n", "<|im_end|>", "<\\|x", "\\b", "<\\b|", "a\\\n\\b"]
    got = spark.createDataFrame([(r,) for r in roles], "role string").select("role", escape_role(F.col("role")).alias("x")).select("role", "x", unescape_role(F.col("x")).alias("back")).collect()
    assert all(r["back"] == r["role"] and "\n" not in r["x"] and "<|" not in r["x"] for r in got)


def test_hot_keys_are_split(spark):
    from pyspark.sql import functions as F

    from readloom.llm import common

    big = spark.range(20000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"), "id")
    counts = big.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    hot = common.hot_keys(counts, "k")
    assert [r["__parts"] for r in hot.collect()] == [4]
    small = big.select("k").distinct().withColumn("v", F.length("k"))
    got = common.salted_join(big, small, "k", hot, F.col("id"))
    assert got.count() == 20000 and got.filter("v <> length(k)").isEmpty()
    assert common.salted_join(big, small.filter("k = 'hot'"), "k", hot, F.col("id"), "left_semi").count() == counts.filter("k = 'hot'").first()["n"]


def test_components_of_one_and_of_many_partitions(spark, monkeypatch):
    from readloom.llm import components

    rng = random.Random(7)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 112)]
    of = {x: x for e in edges for x in e}
    for _ in of:
        for a, b in edges:
            of[a] = of[b] = min(of[a], of[b])
    want = {(x, c) for x, c in of.items() if any(x in e and e[0] != e[1] for e in edges)}
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    for most in (1000, 16):
        monkeypatch.setattr(components, "EDGES", most)
        assert {tuple(r) for r in components.components(df).collect()} == want
    assert components.components(df.limit(0)).count() == 0
