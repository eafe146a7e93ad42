"""Raw index text becomes runs line by line; no symbol becomes a row of a sort."""

import itertools

import pytest

from readloom.operators import bins, codecs


@pytest.mark.parametrize("size", [1, 5, 8, 37])
def test_runs_of_lines(spark, monkeypatch, size):
    """Lines shorter and longer than a bin, empty ones, numbers with gaps, and lines in any order."""
    monkeypatch.setattr(bins, "BIN_BITS", 3)
    monkeypatch.setattr(codecs, "TOGETHER", 2)
    monkeypatch.setattr(codecs, "convert_text", lambda *_: pytest.fail("symbols become rows"))
    text = "A" * 3 + "C" * 30 + "GTG" + "A" * 5 + "$" * 9 + "N" * 7 + "TTA"
    lines = [text[a : a + size] for a in range(0, len(text), size)]
    lines = [(3 * i, x) for i, x in enumerate([*lines[:2], "", *lines[2:], ""])]
    d = spark.createDataFrame(lines[::-1], "line_no long, value string").repartition(3)
    got = sorted(tuple(r) for r in codecs.text_runs(d).select("run_id", "row_start", "sym", "run_len").collect())
    want, row = [], 0
    for i, (c, run) in enumerate(itertools.groupby(text)):
        want.append((i, row, c, n := len(list(run))))
        row += n
    assert got == want


def test_text_is_rejected(spark):
    d = spark.createDataFrame([(0, "ACX")], "line_no long, value string")
    with pytest.raises(Exception, match="symbol outside"):
        codecs.text_runs(d).collect()


def test_no_lines(spark):
    d = spark.createDataFrame([], "line_no long, value string")
    assert codecs.text_runs(d).collect() == [] == codecs.convert_text(d).collect()
