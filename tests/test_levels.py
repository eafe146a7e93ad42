"""Growing indexes: breaks after any step, appended batches, what is merged and what is left alone."""

import os
import random

import pytest

from readloom.operators import bins, doubling, index
from readloom.plans import levels
from readloom.plans.engine import Index
from readloom.plans.levels import Levels


def batch(spark, seed, n=6):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, "".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 7)))) for i in range(n)], "seq_id long, seq string")


def symbols(i):
    return "".join(r["sym"] for r in i.rows.orderBy("row").collect())


def times(root):
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(root) for f in names if f.endswith(".parquet") and "parts-" not in d}


def test_batches_merge_by_levels(spark, tmp_path):
    at = Levels(spark, str(tmp_path / "x"))
    with pytest.raises(ValueError):
        at.merged()
    seen, before = [], {}
    for k in range(5):
        seen.append([(p["level"], p["batches"]) for p in at.append(batch(spark, k), f"b{k}")])
        now = times(tmp_path)
        assert all(now[f] == t for f, t in before.items())  # what is there is never written again
        before = now
    assert seen == [[(0, 1)], [(1, 2)], [(1, 2), (0, 1)], [(2, 4)], [(2, 4), (0, 1)]]
    every = [r["seq"] for k in range(5) for r in batch(spark, k).collect()]
    whole = at.merged()
    assert symbols(whole) == symbols(Index.from_strings(spark, every))
    # reads keep the number of their batch and their id in it
    assert {(r["file_id"], r["seq_id"]): r["seq"] for r in whole.reads.collect()} == {(k, r["seq_id"]): r["seq"] for k in range(5) for r in batch(spark, k).collect()}
    # the same batches again: nothing is made
    assert [(p["level"], p["batches"]) for p in at.append(batch(spark, 4), "b4")] == seen[-1] and [(p["level"], p["batches"]) for p in at.append(batch(spark, 1), "b1")] == seen[-1]


@pytest.mark.parametrize("broken", ["prepare_reads", "build", "text_bins", "merge_rows", "note", "merged_bins"])
def test_a_stopped_build_goes_on(spark, tmp_path, monkeypatch, broken):
    at = Levels(spark, str(tmp_path / "x"))
    at.append(batch(spark, 0), "b0")
    made = []

    def count(module, name, fail):
        real = getattr(module, name)

        def call(*a, **b):
            made.append(name)
            if fail(made.count(name)):
                raise RuntimeError("stopped")
            return real(*a, **b)

        monkeypatch.setattr(module, name, call)

    with monkeypatch.context():
        for module, name in ((index, "prepare_reads"), (index, "build"), (bins, "text_bins"), (doubling, "merge_rows")):
            count(module, name, lambda n, name=name: name == broken or (broken == "merged_bins" and name == "text_bins" and n == 2))
        if broken == "note":
            monkeypatch.setattr(Levels, "_note", lambda *_: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError, match="stopped"):
            at.append(batch(spark, 1), "b1")
    monkeypatch.undo()
    done = list(made)
    again = []
    for module, name in ((index, "prepare_reads"), (index, "build"), (bins, "text_bins"), (doubling, "merge_rows")):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, real=real, name=name, **b: (again.append(name), real(*a, **b))[1])
    assert [(p["level"], p["batches"]) for p in at.append(batch(spark, 1), "b1")] == [(1, 2)]
    # steps before the break are not made again
    finished = {"prepare_reads": [], "build": ["prepare_reads"], "text_bins": ["prepare_reads", "build"]}.get(broken, ["prepare_reads", "build", "batch bins"])
    assert ("build" in again) == ("build" not in finished) and again.count("text_bins") == (1 if "batch bins" in finished else 2), (done, again)
    if broken == "merged_bins":
        assert "merge_rows" not in again
    monkeypatch.undo()
    assert symbols(at.merged()) == symbols(Index.from_strings(spark, [r["seq"] for k in range(2) for r in batch(spark, k).collect()]))


def test_fingerprints_follow_the_files(spark, tmp_path):
    a = tmp_path / "a.txt"
    a.write_text("ACGT")
    one = levels.fingerprint(spark, str(a))
    assert one == levels.fingerprint(spark, [str(tmp_path / "*.txt")])
    a.write_text("ACGTA")
    assert one != levels.fingerprint(spark, str(a))
