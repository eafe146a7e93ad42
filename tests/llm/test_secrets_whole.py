"""Candidates of any length, each occurrence with its own place and context."""

from readloom.llm import secrets


def test_whole_candidates_and_all_places(spark):
    long, late, own = "a1B2" * 75, "x" * 250 + "7", "k9Qz71Lm2Xw8Rt5V"
    texts = [(1, f"see {long} there"), (2, f"token={long}"), (3, f"key ghp_{long}."), (4, f"see {late} there"), (5, f"ß example {own}x, example password={own} and\nlater password={own} "), (6, None)]
    got = {}
    for r in secrets.candidates(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        assert dict(texts)[r["ident"]][r["start"] :].startswith(r["secret"])
        assert dict(texts)[r["ident"]][: r["start"]][-40:] == r["before"]
        got.setdefault((r["ident"], r["kind"]), []).append(r)
    assert got[1, "long_token"][0]["secret"] == long and got[4, "long_token"][0]["secret"] == late
    assert got[2, "assigned"][0]["secret"] == long and got[3, "prefixed"][0]["secret"] == f"ghp_{long}"
    text = texts[4][1]
    places = [i for i in range(len(text)) if text.startswith(f"password={own}", i)]
    assert sorted(r["start"] for r in got[5, "assigned"]) == [i + len("password=") for i in places] and all(r["n"] == 2 for r in got[5, "assigned"])
