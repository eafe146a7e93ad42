"""The operators on documents against brute force, and their edge cases."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from readloom.llm import class_lm, langid, line_dedup, mixing, near_dedup, packing, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, lam double, mean double, n_words long, row long, site string"
WORDS = {"en": "the of and to in a is that river stone".split(), "de": "der die und in den von zu das fluss stein".split()}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "", ".", "x" + str(rng.randrange(9))]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = []
    for i in range(60):
        lang = rng.choice(["en", "de"])
        out.append((i, prose(rng, lang, rng.choice([1, 2, 3, 60, 90, 300])), lang, rng.choice(["a", "a", "a", "b", "c", None])))
    base = prose(rng, "en", 120)
    for i in range(60, 75):
        words = base.split()
        words[rng.randrange(len(words))] = "changed"
        out.append((i, " ".join(words), "en", "b"))
    out += [(75, base, "en", "a"), (76, base, "en", "c"), (76, base, "en", "c"), (77, None, None, "a"), (78, "", "en", None), (79, " \n\t ", None, "b"), (80, "word " * 9000, "en", "a"), (81, "Grüße 日本 <|x|> 12", None, None)]
    return [(*r, None if r[1] is None else len(r[1]), 1.0, 2.0, 7, 8, "s") for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_mixing(docs, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and {"lam", "mean"} <= set(got[0].asDict())
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len(words(r[1]))
    keys = sorted([k for k in size if k is not None]) + [None]
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(keys)}
    total, fixed = 1.5 * sum(size.values()), {}
    while True:
        free = [k for k in keys if k not in fixed]
        level = (total - sum(fixed.values())) / sum(weight[k] for k in free)
        over = [k for k in free if level * weight[k] > 2 * size[k]]
        if not over:
            break
        fixed |= {k: 2.0 * size[k] for k in over}
    want = {k: fixed.get(k, level * weight[k]) for k in keys}
    taken = defaultdict(int)
    for r in got:
        assert r["mix_size"] == len(words(r["text"])) and r["mix_source_size"] == size[r["source"]] and 0 <= r["mix_copies"] <= 2
        assert r["mix_target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["mix_copies"] * r["mix_size"]
    for k in keys:
        largest = max(len(words(r[1])) for r in rows if r[3] == k)
        assert abs(taken[k] - want[k]) <= max(0.02 * want[k], largest / 2 + 1)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.repeated(mixing.mix(docs)).count() == sum(r["mix_copies"] for r in got)


def test_mixing_solves_the_dual(docs):
    """Rates are min(2, exp(lam * size / mean)) and meet the targets in expectation."""
    state = {r["source"]: r for r in mixing.solve(docs.select("doc_id", "text", "source")).collect()}
    for r in mixing.mix(docs).collect():
        s = state[r["source"]]
        if r["mix_size"] and math.isfinite(s["lam"]):
            assert r["mix_rate"] == pytest.approx(min(2.0, math.exp(min(50.0, s["lam"] * r["mix_size"] / s["mean"]))))
    sums = defaultdict(float)
    for r in mixing.mix(docs).collect():
        sums[r["source"]] += r["mix_rate"] * r["mix_size"]
    for k, s in state.items():
        assert sums[k] == pytest.approx(s["target"], rel=2e-4)


def test_quality(docs, rows):
    got = quality.judge(docs).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        w, t = words(text[r["doc_id"]]), text[r["doc_id"]] or ""
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if words(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r["n_repeat_words"], r["n_dup_lines"]) == (len(covered), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r["kept"] and r["base_failed"])


def test_quality_distance(spark):
    rng = random.Random(1)
    good = [(i, prose(rng, "en", 200), "en") for i in range(40)]
    bad = [(100, " ".join(f"{''.join(rng.sample('bcdfghkm', 6))}***%%%$$$" for _ in range(200)), "en")]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(good + bad, "doc_id long, text string, lang string")).collect()}
    assert not got[100]["kept"] and got[100]["class_distance"] > 0.3
    assert all(got[i]["class_distance"] < 0.2 for i in range(40))


def test_line_dedup(spark):
    boiler, near = "All rights reserved by the site owner.", "This line is on nine sites and stays."
    rows = [(i, f"own line number {i} of its text\n{boiler}\nshort" + (f"\n{near}" if i < 9 else ""), f"s{i}") for i in range(12)]
    rows += [(50, None, "s1"), (51, "", None), (52, boiler, None), (53, f"{boiler}\n{boiler}", "s3"), (53, f"{boiler}\n{boiler}", "s3")]
    got = defaultdict(list)
    for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        got[r["doc_id"]].append(r)
    assert got[0][0]["text"] == rows[0][1] and got[0][0]["n_removed"] == 0
    assert all(boiler not in got[i][0]["text"] and "short" in got[i][0]["text"] for i in range(1, 12))
    assert near in got[8][0]["text"] and got[50][0]["text"] is None and got[51][0]["text"] == ""
    assert got[52][0]["text"] == "" and len(got[53]) == 2 and got[53][0]["n_removed"] == 2


def brute_components(rows, width, percent):
    sets = {}
    for r in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        sets[r[0]] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    ids = sorted(sets)
    comp = {i: i for i in ids}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = sorted((root(x), root(y)))
                comp[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, rows, width, percent):
    want = brute_components(rows, width, percent)
    got = near_dedup.near_duplicates(docs, width, percent).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_large_region(spark):
    """A chain of texts, each near the next only, and a group far larger than a region that is compared pair by pair."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randrange(1, 9)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        rows.append((1000 + i, " ".join(w)))
    rows += [(i, " ".join(f"c{j}" for j in range(8 * i, 8 * i + 200))) for i in range(30)]
    want = brute_components(rows, 3, 85)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {k: v[1] for k, v in want.items()}


def test_language(docs, spark, rows):
    rng = random.Random(2)
    train = spark.createDataFrame([(prose(rng, x, 80), x) for x in ("en", "de") for _ in range(40)] + [(None, "en"), ("the", None)], "text string, lang string")
    langs, table = langid.learn(train)
    assert langs == ["de", "en"]
    got = {r["doc_id"]: r for r in langid.predict(docs, langs, table).collect()}
    assert all(got[r[0]]["lang_pred"] == r[2] for r in rows if r[2] and len(words(r[1])) > 50 and r[0] < 60)
    assert got[77]["lang_pred"] == got[78]["lang_pred"] == got[79]["lang_pred"] == "und" and all(0 <= x["score"] <= 1 for x in got.values())
    assert langid.predict(docs, *langid.learn(train.limit(0))).filter("lang_pred <> 'und'").count() == 0


def test_class_lm(docs, rows):
    from pyspark.sql import functions as F

    got = class_lm.score(docs, F.col("doc_id") % 5 != 0).collect()
    assert len(got) == len(rows)
    tokens = lambda r: [w.encode() for w in words(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))] + [None]
    counts = Counter(t for r in rows if r[0] % 5 for t in tokens(r))
    n, v = sum(counts.values()), len(counts)
    text = {r[0]: r for r in rows}
    for r in got:
        ts = tokens(text[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(ts), sum(counts[t] > 0 for t in ts), n, r["doc_id"] % 5 == 0)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts))
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_exchange_raises_the_likelihood():
    import numpy as np

    rng = np.random.default_rng(0)
    pairs = np.zeros((22, 22), np.int64)
    for i in range(20):
        for j in range(20):
            if i % 2 != j % 2:
                pairs[i, j] = rng.integers(20, 30)
    own = class_lm.exchange(pairs, classes=2)
    assert len(set(own[0:20:2])) == 1 and len(set(own[1:20:2])) == 1 and own[0] != own[1]


def test_packing(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    ids = {r[0]: [*t.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in rows}
    got = packing.pack(docs, path, window=256).collect()
    check_pieces(got, ids, 256, {76: 2})
    # many shards: few documents, or few ids, each
    check_pieces(packing.pack(docs, path, window=256, shard_docs=3).collect(), ids, 256, {76: 2})


def check_pieces(got, ids, window, copies):
    """Every id of every document in one piece, sequences without gaps, padding only at the ends of shards."""
    import zlib

    import numpy as np

    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        part = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert len(part) == r["length"] > 0 and zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for i, p in pieces.items():
        held = Counter(x for a, n in p for x in range(a, a + n))
        assert held == {x: copies.get(i, 1) for x in range(len(ids[i]))}
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at == window or at & (at - 1) == 0 and at < window


def test_shards_by_ids(spark, monkeypatch):
    """Shards are cut by ids as well as by documents; a longer document is one of its own."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(packing, "SHARD_IDS", 300)
    rng = random.Random(8)
    rows = [(i, prose(rng, "en", rng.choice([1, 40, 90, 700]))) for i in range(40)]
    t = Tokenizer.from_file(path)
    ids = {i: [*t.encode(x, add_special_tokens=False).ids, 1] for i, x in rows}
    check_pieces(packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), path, window=64).collect(), ids, 64, {})


def test_encoder_matches_the_library():
    import numpy as np
    import public_tokenizers

    from readloom.llm.tokens import SLICE, encoder

    e = encoder(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(3)
    texts = ["It's we'll DON'T a b x\u0085y Σίσυφος 日本語 4.5 <|endoftext|> <|x|> ﬁ é é İstanbul ß \x00 \x1c z '''s", "aaaaaaaaaaaa " * 3 + "a" * 99, "", "ciónque ered*** ***x%%% A_B-c__d"]
    texts += ["A" * 23 + " " + "B" * 24 + " " + "c" * 25 + " é" * 13, "ÀÞ×÷ß <|EndOfText|>", "  ", "😀👍🏽 ¿qué?"]
    texts += ["".join(rng.choice("abcdeXYZ 019.,'<|>éÉßñ¿日\u0301 \n\t-") for _ in range(rng.randrange(60))) for _ in range(500)]
    texts.append(" ".join(rng.choice(texts) for _ in range(60000)))  # cut into parts
    assert len(texts[-1]) > 1.4 * SLICE
    ids, sizes = (np.concatenate(x) for x in zip(*e.encode([t.encode() for t in texts], 1), strict=True))
    ends = np.cumsum(sizes)
    for t, a, b in zip(texts, (ends - sizes).tolist(), ends.tolist(), strict=True):
        assert ids[a:b].tolist() == [*e.tokenizer.encode(t, add_special_tokens=False).ids, 1]


def test_encoder_forgets(monkeypatch):
    """Emptying the tables changes no ids."""
    import numpy as np
    import public_tokenizers

    from readloom.llm import tokens

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [" ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}w{chr(97 + j)}" for j in range(26)).encode() for i in range(600)]
    want = np.concatenate([x for x, _ in tokens.Encoder(path).encode(texts, 1)])
    monkeypatch.setattr(tokens, "SLICE", 1 << 12)
    monkeypatch.setattr(tokens, "BITS", 12)
    small = tokens.Encoder(path)
    assert (np.concatenate([x for x, _ in small.encode(texts, 1)]) == want).all() and small.pieces.taken < 1 << 12


def test_empty_tables(docs, spark):
    import public_tokenizers
    from pyspark.sql import functions as F

    none = docs.limit(0)
    assert mixing.mix(none).count() == 0 and quality.judge(none).count() == 0 and line_dedup.dedup_lines(none).count() == 0
    assert near_dedup.near_duplicates(none).count() == 0 and class_lm.score(none, F.lit(True)).count() == 0
    assert packing.pack(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0
