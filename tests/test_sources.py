"""Split sources: blocks of text, parts of compressed alignment files, standard input; command line checks."""

import gzip
import io
import random
import struct
import sys
import zlib

import numpy as np
import pytest

from readloom import cli
from readloom.functions import align
from readloom.operators import codecs
from readloom.sources import files


def record(name, flag, seq):
    code = "=ACMGRSVTWYHKDBN"
    padded = seq + "=" * (len(seq) % 2)
    packed = bytes(code.index(padded[i]) << 4 | code.index(padded[i + 1]) for i in range(0, len(padded), 2))
    body = struct.pack("<iiBBHHHiiii", -1, -1, len(name) + 1, 0, 0, 0, flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + packed + b"\xff" * len(seq)
    return struct.pack("<i", len(body)) + body


def bgzf(data, size):
    """Blocks of ``size`` bytes each, wherever records end, and the empty block that ends a file."""
    out = b""
    for a in [*range(0, len(data), size), len(data)]:
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        part = data[a : a + size]
        body = c.compress(part) + c.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def alignments(seed, n=300):
    rng = random.Random(seed)
    return [(f"q{i}", rng.choice([64, 128, 80]), "".join(rng.choice("ACGTN") for _ in range(rng.randrange(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("block", [97, 1000])
def test_bam_by_parts(spark, tmp_path, monkeypatch, block):
    """Records over the edges of parts, also cut in their first bytes; two files, one of them without blocks."""
    # patched functions go to the workers as they are, with the bound
    real = files._bgzf_parts
    monkeypatch.setattr(files, "PART", 700)
    monkeypatch.setattr(files, "_bgzf_parts", lambda batches: real(batches))
    rows = {"a.bam": alignments(1), "b.bam": alignments(2, 50), "c.bam": alignments(3, 400)}
    for name, rs in rows.items():
        data = b"BAM\1" + struct.pack("<i", 3) + b"@HD" + struct.pack("<i", 1) + struct.pack("<i", 2) + b"c\0" + struct.pack("<i", 9) + b"".join(record(*r) for r in rs)
        (tmp_path / name).write_bytes(gzip.compress(data) if name == "b.bam" else bgzf(data, block))
    d = files.read_bam(spark, str(tmp_path))
    got = sorted((r["file_id"], r["qname"], r["flag"], r["seq"]) for r in d.collect())
    assert got == sorted((k, *r) for k, name in enumerate(sorted(rows)) for r in rows[name])


def test_bam_parts_that_find_nothing(spark, tmp_path, monkeypatch):
    """A record longer than a part: no place to begin there, so the file is read in one task."""
    real = files._bgzf_parts
    monkeypatch.setattr(files, "PART", 300)
    monkeypatch.setattr(files, "_bgzf_parts", lambda batches: real(batches))
    rng = random.Random(4)
    rows = [*alignments(5, 20), ("long", 64, "".join(rng.choice("ACGT") for _ in range(9000))), *alignments(6, 20)]
    (tmp_path / "x.bam").write_bytes(bgzf(b"BAM\1" + struct.pack("<ii", 0, 0) + b"".join(record(*r) for r in rows), 200))
    assert sorted((r["qname"], r["flag"], r["seq"]) for r in files.read_bam(spark, str(tmp_path / "x.bam")).collect()) == sorted(rows)
    (tmp_path / "y.bam").write_bytes(gzip.compress(b"BAM\1" + struct.pack("<ii", 0, 0) + record("q", 0, "ACGT")[:-3]))
    with pytest.raises(Exception, match="cut or damaged"):
        files.read_bam(spark, str(tmp_path / "y.bam")).count()


def test_fastq_over_blocks(spark, tmp_path):
    """Small blocks cut records anywhere; no line of a whole record is shuffled."""
    rng = random.Random(7)
    want = []
    for f in range(2):
        rows = [(f"r{f}.{i}", "".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 40)))) for i in range(150 + f)]
        text = "".join(f"@{n}\n{s}\n+\n{'I' * len(s)}\n" for n, s in rows) + ("@last" if f else "")
        (tmp_path / f"{f}.fq").write_text(text)
        want += [(f, i, n, s, "+", "I" * len(s)) for i, (n, s) in enumerate(rows)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        d = files.read_fastq(spark, str(tmp_path / "*.fq"))
        assert d.rdd.getNumPartitions() > 5
        assert sorted(map(tuple, d.collect())) == sorted(want)
        lines = files.numbered_lines(spark, str(tmp_path / "0.fq"))
        plan = lines._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan.split("BroadcastExchange")[0]
        assert [r["line_no"] for r in lines.orderBy("line_no").collect()] == list(range(600))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_standard_input(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "STDIN_LINES", 3)
    got = files.read_stream(spark, io.StringIO("AC\n$\r\n\nGG\nT")).orderBy("line_no").collect()
    assert [(r["line_no"], r["value"]) for r in got] == [(0, "AC"), (1, "$"), (2, ""), (3, "GG"), (4, "T")]
    assert files.read_stream(spark, []).count() == 0
    monkeypatch.setattr(sys, "stdin", io.StringIO("C$\nCA\n"))
    cli.main(["convert", "-", str(tmp_path / "runs")], spark)
    runs = spark.read.parquet(str(tmp_path / "runs"))
    assert "".join(r["sym"] for r in codecs.decode(runs).orderBy("row").collect()) == "C$CA"
    monkeypatch.setattr(sys, "stdin", io.StringIO("CX\n"))
    with pytest.raises(Exception, match="outside"):
        cli.main(["convert", "-", str(tmp_path / "bad")], spark)


def test_paths_are_checked_first(spark, tmp_path):
    fq = tmp_path / "a.fq"
    fq.write_text("@r\nACGT\n+\nIIII\n")
    with pytest.raises(FileNotFoundError):
        cli.main(["cffq", str(tmp_path / "x"), str(tmp_path / "none.fq")], spark)
    cli.main(["cffq", str(tmp_path / "x"), str(fq)], spark)
    with pytest.raises(FileExistsError):
        cli.main(["cffq", str(tmp_path / "x"), str(fq)], spark)
    for bad in (["cffq", str(tmp_path / "y"), str(tmp_path / "a.doc")], ["query", str(tmp_path / "x"), "AXG"]):
        with pytest.raises(SystemExit):
            cli.main(bad, spark)


def test_command_line_reads_alignments(spark, tmp_path):
    bam = tmp_path / "x.bam"
    bam.write_bytes(bgzf(b"BAM\1" + struct.pack("<ii", 0, 0) + record("q1", 64, "ACC") + record("q1", 128 | 16, "AAC") + record("q2", 64, "G"), 50))
    cli.main(["cfbam", str(tmp_path / "i"), str(bam)], spark)
    cli.main(["pp", str(tmp_path / "p"), str(bam)], spark)
    cli.main(["cfpp", str(tmp_path / "j"), str(tmp_path / "p")], spark)
    syms = ["".join(r["sym"] for r in spark.read.parquet(str(tmp_path / x / "rows")).orderBy("row").collect()) for x in "ij"]
    assert syms[0] == syms[1] and sorted(syms[0]) == sorted("ACC$GTT$G$")
    with pytest.raises(ValueError, match="one kind"):
        (tmp_path / "b.fq").write_text("@r\nA\n+\nI\n")
        cli.main(["pp", str(tmp_path / "q"), str(bam), str(tmp_path / "b.fq")], spark)


def test_lzw_bins(spark):
    """Bins of an LZW form are decoded apart: streams of one-symbol codes, of three bits while the dictionary has up to 8 words."""
    parts = [(0, [1, 2, 0]), (1, [5]), (2, [3, 3])]
    pack = lambda codes: (sum(c << 3 * i for i, c in enumerate(codes))).to_bytes(4, "little")
    d = spark.createDataFrame([(k, pack(c), len(c)) for k, c in parts], "bin_id long, data binary, size int")
    got = {r["row"]: r["sym"] for r in codecs.lzw_rows(d, 10).collect()}
    assert got == {0: "A", 1: "C", 2: "$", 10: "T", 20: "G", 21: "G"}


# ---- alignment


def _distances(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row


def _affine(a, b):
    """The least cost of an alignment whose gaps open at 5 and cost 3 a letter; substitutions cost 6."""
    far = 10**9
    m = [0] + [far] * len(b)
    d = [0] + [far] * len(b)
    i_ = [0] + [5 + 3 * j for j in range(1, len(b) + 1)]
    for i in range(1, len(a) + 1):
        nm, nd, ni = [far], [5 + 3 * i], [far]
        for j in range(1, len(b) + 1):
            nm.append(min(m[j - 1], d[j - 1], i_[j - 1]) + (0 if a[i - 1] == b[j - 1] else 6))
            nd.append(min(m[j] + 8, d[j] + 3, i_[j] + 8))
            ni.append(min(nm[j - 1] + 8, nd[j - 1] + 8, ni[j - 1] + 3))
        m, d, i_ = nm, nd, ni
    return min(m[-1], d[-1], i_[-1])


@pytest.mark.parametrize("cells", [1 << 24, 200])
def test_alignments_are_brute_force(monkeypatch, cells):
    monkeypatch.setattr(align, "CELLS", cells)
    rng = random.Random(9)
    pairs = [tuple("".join(rng.choice("ACG") for _ in range(rng.randrange(0, 13))) for _ in "ab") for _ in range(250)]
    raw = [(a.encode(), b.encode()) for a, b in pairs]

    def follows(a, b, runs):
        i = j = 0
        for n, op in runs:
            for _ in range(n):
                assert op not in "=X" or (a[i] == b[j]) == (op == "=")
                i, j = i + (op != "I"), j + (op != "D")
        assert (i, j) == (len(a), len(b)) and all(x[1] != y[1] for x, y in zip(runs, runs[1:], strict=False))

    for (a, b), affine, unit, best in zip(pairs, align.affine_cigars(raw), align.unit_cigars(raw), align.best_prefixes(raw), strict=True):
        follows(a, b, affine)
        follows(a, b, unit)
        assert sum(6 * n if op == "X" else 0 if op == "=" else 5 + 3 * n for n, op in affine) == _affine(a, b)
        row = _distances(a, b)
        assert sum(n for n, op in unit if op != "=") == row[-1]
        assert best == (min(row), max(k for k, v in enumerate(row) if v == min(row)))


def test_alignment_columns(spark):
    d = spark.createDataFrame([("ACGT", "AGT"), (None, "A"), ("", ""), ("", "CC"), ("AC", None)], "a string, b string")
    rows = d.select(align.cigar("a", "b").alias("c"), align.unit_cigar("a", "b").alias("u"), align.best_prefix("a", "b").alias("p")).collect()
    plain = [([tuple(x) for x in r["u"]] if r["u"] is not None else None, tuple(r["p"]) if r["p"] else None) for r in rows]
    assert plain == [([(1, "="), (1, "D"), (2, "=")], (1, 3)), (None, None), ([], (0, 0)), ([(2, "I")], (0, 0)), (None, None)]
    costs = [r[0] for r in d.filter("a is not null and b is not null").select(align.cigar_cost(align.cigar("a", "b"))).collect()]
    assert costs == [8, 0, 11] and np.isfinite(costs).all()
