"""Every tokenizer file gives the library's ids, whatever its settings."""

import copy
import glob
import json
import os
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from readloom.llm import packing, tokens

WORDS = ["It's", "we'll", "DON'T", "x4.5", "日本語", "<|endoftext|>", "a<b", "Éa", "ÀB", "\n", "  ", "***", "A_B-c", "naïve", "hello", "World", "é", "12345"]


def texts(n=120):
    rng = random.Random(4)
    return ["", " ", *[" ".join(rng.choice(WORDS) for _ in range(rng.randrange(30))) for _ in range(n)]]


def same(path):
    library = Tokenizer.from_file(path)
    library.no_truncation()
    e = tokens.Encoder(path)
    ids, sizes = (np.concatenate(x) for x in zip(*e.encode([t.encode() for t in texts()], 1), strict=True))
    ends = np.cumsum(sizes)
    for t, a, b in zip(texts(), (ends - sizes).tolist(), ends.tolist(), strict=True):
        assert ids[a:b].tolist() == [*library.encode(t, add_special_tokens=False).ids, 1]
    return e


def without_lower(x):
    x["normalizer"]["normalizers"].pop()


def other_pattern(x):
    x["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"


def more_tokens(x):
    x["added_tokens"].append({"id": 40000, "content": "hello", "single_word": False, "lstrip": False, "rstrip": False, "normalized": True, "special": False})


def cut(x):
    x["truncation"] = {"direction": "Right", "max_length": 5, "strategy": "LongestFirst", "stride": 0}


def whole_words(x):
    x["model"]["ignore_merges"] = True


@pytest.mark.parametrize("change", [without_lower, other_pattern, more_tokens, cut, whole_words])
def test_other_settings_go_to_the_library(change, tmp_path):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    changed = copy.deepcopy(spec)
    change(changed)
    path = str(tmp_path / "tokenizer.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(changed, f)
    assert tokens.in_bytes(spec) and not tokens.in_bytes(changed)
    assert same(path).pieces is None


def test_the_query_file_is_merged_in_bytes():
    assert same(public_tokenizers.path("word_bpe_49k.json")).pieces is not None


def test_all_tokenizer_files():
    base = os.path.dirname(public_tokenizers.path("word_bpe_49k.json"))
    read = 0
    for path in sorted(glob.glob(os.path.join(base, "*.json"))):
        try:
            Tokenizer.from_file(path)
        except Exception:
            continue  # not a file of this library
        same(path)
        read += 1
    assert read


def test_pack_with_another_file(spark, tmp_path):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    without_lower(spec)
    path = str(tmp_path / "tokenizer.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    rows = [(i, t) for i, t in enumerate(texts(30))] + [(1000, None), (None, "hello World"), (None, None)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), path, window=64).collect()
    library = Tokenizer.from_file(path)
    total = sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert sum(r["length"] for r in got) == total
    assert sum(r["length"] for r in got if r["doc_id"] is None) == len(library.encode("hello World", add_special_tokens=False).ids) + 2
