"""Golden fixtures and properties of the index against brute force from its definition."""

import gzip
import random
import re
import struct

import pytest
from pyspark.sql import functions as F

from readloom.functions import align
from readloom.functions.dna import reverse_complement
from readloom.operators import approx, codecs, graph, index, search
from readloom.plans.engine import Index
from readloom.sources import files

GOLDEN = ["ACGT", "CCA", "ACGT", "GATTN"]


def brute(seqs):
    """(suffix, rank, pos, sym, rotation) in row order."""
    rows = []
    for rank, s in enumerate(sorted(x + "$" for x in seqs)):
        rows += [(s[j:], rank, j, s[j - 1], s[j:] + s[:j]) for j in range(len(s))]
    return sorted(rows)


def symbols(i):
    return "".join(r["sym"] for r in i.rows.orderBy("row").collect())


@pytest.fixture(scope="module")
def golden(spark):
    i = Index.from_strings(spark, GOLDEN)
    i.rows = i.rows.cache()
    return i


def test_golden_symbols(spark, golden):
    assert symbols(Index.from_strings(spark, ["ACC"])) == "C$CA"
    assert symbols(golden) == "TTANC$$GC$AA$CCTGGTA"
    assert {r["sym"]: r["cnt"] for r in index.symbol_counts(golden.rows).collect()} == {"$": 4, "A": 4, "C": 4, "G": 3, "N": 1, "T": 4}


def test_golden_lcp_and_bytes(golden):
    lcp = [r["lcp"] for r in index.lcp(golden.rows, golden.reads, 6).orderBy("row").collect()]
    assert lcp == [6, 1, 1, 0, 1, 6, 1, 0, 1, 1, 6, 0, 1, 6, 0, 0, 6, 1, 1, 0]
    got = [r["byte"] for r in codecs.encode(golden.runs()).orderBy("run_id", "part").collect()]
    assert got == [21, 9, 12, 10, 16, 11, 10, 8, 17, 8, 18, 13, 19, 13, 9]


def test_long_run_bytes_and_back(spark):
    rows = spark.createDataFrame([(i, "A") for i in range(34)] + [(34, "C")], "row long, sym string")
    runs = codecs.run_lengths(rows)
    got = [r["byte"] for r in codecs.encode(runs).orderBy("run_id", "part").collect()]
    assert got[:2] == [17, 9]
    back = codecs.decode_bytes(spark.createDataFrame(list(enumerate(got)), "byte_pos long, byte int")).orderBy("run_id").collect()
    assert [(r["sym"], r["run_len"]) for r in back] == [("A", 34), ("C", 1)]
    assert codecs.decode(runs).count() == 35 and codecs.compressed_size(runs).first()["bytes"] == 3


def test_golden_ranges(spark, golden):
    want = {"": (0, 20), "A": (4, 8), "CA": (8, 9), "ACG": (5, 7), "$ACG": (0, 2), "T$A": (16, 18), "TT": (19, 20), "CG": (10, 12), "N$": (15, 16), "GG": (13, 13)}
    p = spark.createDataFrame([(x,) for x in want], "pattern string")
    assert {r["pattern"]: (r["l"], r["h"]) for r in search.find_ranges(golden.rows, golden.reads, p, 4).collect()} == want


def test_golden_profile(spark, golden):
    got = {r["kmer"]: r["cnt"] for r in search.profile(golden.reads, 2).collect()}
    assert got["AC"] == got["CG"] == got["GT"] == got["$A"] == got["T$"] == 2 and sum(got.values()) == 20
    assert search.norm(search.profile(golden.reads, 2)).first()["l2"] == pytest.approx(30**0.5)


@pytest.mark.parametrize("seed", range(2))
def test_index_properties(spark, seed):
    rng = random.Random(seed)
    seqs = ["".join(rng.choice("ACGNT") for _ in range(rng.randrange(0, 9))) for _ in range(25)] + ["", "ACG", "ACGT", "ACGT"]
    i = Index.from_strings(spark, seqs)
    rows = [(r["suffix"], r["read_rank"], r["pos"], r["sym"]) for r in i.rows.orderBy("row").collect()]
    want = brute(seqs)
    assert rows == [x[:4] for x in want]
    lf = {r["row"]: r["lf"] for r in index.lf_mapping(i.rows).collect()}
    place = {(x[1], x[2]): n for n, x in enumerate(want)}
    for n, x in enumerate(want):
        size = len(x[4])
        assert lf[n] == place[x[1], (x[2] - 1) % size]
    fm = {r["row"]: r for r in index.fm_vectors(i.rows).collect()}
    text = "".join(x[3] for x in want)
    for n in range(len(text)):
        assert fm[n]["fm_a"] == text.count("$") + text[:n].count("A")
    patterns = ["".join(rng.choice("$ACGNT") for _ in range(rng.randrange(1, 5))) for _ in range(12)]
    got = search.find_ranges(i.rows, i.reads, spark.createDataFrame([(p,) for p in set(patterns)], "pattern string"), 5).collect()
    for r in got:
        rots = [(x[4] * 8)[:6] for x in want]
        low = sum(x < r["pattern"] for x in rots)
        assert (r["l"], r["h"]) == (low, low + sum(x.startswith(r["pattern"]) for x in rots))
    again = codecs.decode(i.runs()).orderBy("row").collect()
    assert "".join(r["sym"] for r in again) == text


def test_merge_and_remove(spark):
    a, b = ["ACG", "TT", ""], ["ACG", "GATT"]
    merged = Index.merge(Index.from_strings(spark, a), Index.from_strings(spark, b))
    assert symbols(merged) == symbols(Index.from_strings(spark, a + b))
    left = merged.remove(merged.reads.filter("seq = 'ACG'").select("read_rank"))
    assert symbols(left) == symbols(Index.from_strings(spark, ["TT", "", "GATT"]))
    with pytest.raises(ValueError):
        merged.remove(spark.createDataFrame([(99,)], "read_rank long"))
    assert symbols(merged.remove(merged.reads.select("read_rank"))) == ""


def test_wildcards(spark, golden):
    for pattern in ("A?G", "A*T", "?T", "G*N$", "*A", "C?"):
        rx = re.compile("^" + pattern.replace("$", r"\$").replace("?", "[ACGNT]").replace("*", "[ACGNT]*"))
        rows = [n for n, x in enumerate(brute(GOLDEN)) if rx.match((x[4] * 3)[:6])]
        got = sorted((r["l"], r["h"]) for r in golden.wildcard(pattern).collect())
        assert [n for low, high in got for n in range(low, high)] == rows
        assert all(x[1] < y[0] for x, y in zip(got, got[1:], strict=False))


def test_query_lists_each_hit(golden):
    assert [r["read"] for r in golden.query("T").collect()] == ["ACGT$", "ACGT$", "GATTN$", "GATTN$"]
    assert golden.count("T") == 4 and golden.size() == 20


def test_rejects_other_symbols(spark):
    with pytest.raises(Exception, match="outside ACGNT"):
        Index.from_strings(spark, ["ACGU"]).reads.count()
    with pytest.raises(Exception, match="differ in length"):
        Index.from_strings(spark, ["ACG", "A"], uniform=True).reads.count()


def test_reverse_complement(spark):
    got = spark.createDataFrame([("ACGTN",), ("$A?*",)], "s string").select(reverse_complement(F.col("s"))).collect()
    assert [r[0] for r in got] == ["NACGT", "*?T$"]


def test_pileup_and_other_choices(spark):
    i = Index.from_strings(spark, ["ACGT", "CCGT", "TCGA"])
    refs = spark.createDataFrame([(1, "ACGTA"), (2, "AC")], "ref_id long, seq string")
    rows = search.pileup(refs, i.reads, 3, stranded=True).orderBy("pos").collect()
    assert [(r["ref_id"], r["pos"], r["cnt"]) for r in rows] == [(1, 0, 1), (1, 1, 2), (1, 2, 0)]
    other = search.other_choices(refs, i.reads, 3).orderBy("pos").collect()
    assert [r["other"] for r in other] == [2, 0, 0]
    stats = search.matching_statistics(refs.filter("ref_id = 1"), i.reads, 2, 5).orderBy("pos").collect()
    assert [r["len"] for r in stats] == [1, 3, 2, 1, 1]


def test_error_search(spark):
    i = Index.from_strings(spark, ["ACGT", "AGGT", "ACG", "AACGT"])
    k = spark.createDataFrame([("ACG",)], "kmer string")
    got = {(r["kind"], r["variant"], r["cnt"]) for r in approx.kmers_within_one(k, i.reads).collect()}
    assert ("exact", "ACG", 3) in got and ("snp", "AGG", 1) in got and ("del", "AC", 3) in got
    assert not any(kind == "ins" and v.startswith("ACG") for kind, v, _ in got)
    q = spark.createDataFrame([("ACGT", "A")], "query string, bonus string")
    ranks = {r["read_rank"]: r["seq"] for r in i.reads.collect()}
    assert {ranks[r["read_rank"]] for r in approx.reads_with_error(q, i.reads).collect()} == {"ACGT", "AGGT"}
    two = {(r["variant"], r["ops"]) for r in approx.kmers_within(spark.createDataFrame([("ACGT",)], "kmer string"), i.reads, 2).collect()}
    assert ("AGGT", "0000") in two and ("ACGT", "0000") in two
    refs = spark.createDataFrame([(1, "TTACTTT")], "ref_id long, seq string")
    assert {ranks[r["read_rank"]] for r in search.reads_matching_one_change(refs, i.reads, 4).collect()} == {"ACGT"}


def test_alignment(spark):
    assert align.affine_cigar("ACGT", "ACGT") == [(4, "=")]
    assert align.affine_cigar("ACGT", "AGGT") == [(1, "="), (1, "X"), (2, "=")]
    assert align.affine_cigar("ACGTACGTAC", "ACGTACAC") in ([(6, "="), (2, "D"), (2, "=")], [(4, "="), (2, "D"), (4, "=")], [(5, "="), (2, "D"), (3, "=")])
    assert align.affine_cigar("", "AC") == [(2, "I")]
    d = spark.createDataFrame([("ACG", "ACGTT"), ("AC", "")], "a string, b string")
    got = d.select(align.best_prefix(F.col("a"), F.col("b")).alias("x"), align.cigar(F.col("a"), F.col("b")).alias("c")).collect()
    assert [(r["x"]["ed"], r["x"]["length"]) for r in got] == [(0, 3), (2, 0)]
    assert [(x["n"], x["op"]) for x in got[1]["c"]] == [(2, "D")]


def test_lzw():
    def pack(codes, symbols=6):
        width, size, held, bits, out = 3, symbols, 0, 0, bytearray()
        for n, c in enumerate(codes):
            held |= c << bits
            bits += width
            size += n > 0
            width += size >> width > 0
            while bits >= 8:
                out.append(held & 255)
                held, bits = held >> 8, bits - 8
        out.append(held & 255)
        return bytes(out) + b"\0"

    rng = random.Random(1)
    for _ in range(20):
        data = [rng.choice([0, 1, 1, 1, 2, 5]) for _ in range(300)]
        words, codes, at = {(s,): s for s in range(6)}, [], 0
        while at < len(data):
            n = 1
            while at + n < len(data) and tuple(data[at : at + n + 1]) in words:
                n += 1
            codes.append(words[tuple(data[at : at + n])])
            words[tuple(data[at : at + n + 1])] = len(words)
            at += n
        assert codecs.lzw_decode(pack(codes), len(data)).tolist() == data


def test_files(spark, tmp_path):
    fq = tmp_path / "a.fastq.gz"
    fq.write_bytes(gzip.compress(b"@r1 x\nACGT\n+\nIIII\n@r2\nCCA\r\n+\nIII\n"))
    rows = files.read_fastq(spark, str(fq)).orderBy("seq_id").collect()
    assert [(r["name"], r["seq"], r["qual"]) for r in rows] == [("r1 x", "ACGT", "IIII"), ("r2", "CCA", "III")]
    for n, body in (("a.fa", ">s1 more\nAC\nGT\n>s2\nTT\n"), ("b.fa", ">s3\nG\n")):
        (tmp_path / n).write_text(body)
    rows = files.read_fasta(spark, [str(tmp_path / "a.fa"), str(tmp_path / "b.fa")]).orderBy("file_id", "seq_id").collect()
    assert [(r["file_id"], r["label"], r["seq"]) for r in rows] == [(0, "s1", "ACGT"), (0, "s2", "TT"), (1, "s3", "G")]
    raw = tmp_path / "raw.txt"
    raw.write_text("C$\nCA\n")
    got = codecs.convert_text(files.read_raw_index(spark, str(raw))).orderBy("row").collect()
    assert "".join(r["sym"] for r in got) == "C$CA"

    def record(name, flag, seq):
        code = "=ACMGRSVTWYHKDBN"
        padded = seq + "=" * (len(seq) % 2)
        packed = bytes(code.index(padded[i]) << 4 | code.index(padded[i + 1]) for i in range(0, len(padded), 2))
        body = struct.pack("<iiBBHHHiiii", -1, -1, len(name) + 1, 0, 0, 0, flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + packed + b"\xff" * len(seq)
        return struct.pack("<i", len(body)) + body

    bam = tmp_path / "x.bam"
    bam.write_bytes(gzip.compress(b"BAM\1" + struct.pack("<ii", 0, 0) + record("q1", 64, "ACC") + record("q1", 128 | 16, "AAC") + record("q2", 64, "G")))
    reads = files.reads_of_alignments(files.read_bam(spark, str(bam))).orderBy("file_id", "seq_id").collect()
    assert [(r["file_id"], r["seq_id"], r["seq"], r["mate_file_id"]) for r in reads] == [(0, 0, "ACC", 1), (0, 1, "G", None), (1, 0, "GTT", 0)]
    prof = search.profile(Index.from_strings(spark, ["ACC"]).reads, 2)
    files.write_profile(prof, str(tmp_path / "p"))
    assert files.read_profile(spark, str(tmp_path / "p")).count() == prof.count()
    i = Index.from_strings(spark, ["ACC"]).save(str(tmp_path / "i"))
    assert symbols(i) == "C$CA"


def test_stream(spark, tmp_path):
    from readloom.streaming.ingest import kmer_stream

    spark.createDataFrame([("ACAC",), ("AC",)], "seq string").write.parquet(str(tmp_path / "in"))
    q = kmer_stream(spark.readStream.schema("seq string").parquet(str(tmp_path / "in")), 2).writeStream.outputMode("complete").format("memory").queryName("kmers").start()
    q.processAllAvailable()
    q.stop()
    assert {r["kmer"]: r["cnt"] for r in spark.table("kmers").collect()} == {"AC": 3, "CA": 1}
