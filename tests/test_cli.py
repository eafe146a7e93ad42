"""The command line, end to end on small files."""

from readloom import cli


def reads_of(seqs):
    return "".join(f"@r{i}\n{s}\n+\n{'I' * len(s)}\n" for i, s in enumerate(seqs))


def naive(seqs):
    """The symbols before the sorted suffixes of the sorted reads."""
    qs = sorted(s + "$" for s in seqs)
    rows = sorted((q[p:], i, q[p - 1]) for i, q in enumerate(qs) for p in range(len(q)))
    return "".join(r[2] for r in rows)


def symbols(df):
    return "".join(r["sym"] for r in df.orderBy("row").collect())


def test_build_query_merge_and_codecs(spark, tmp_path, capsys):
    one, two = ["ACGT", "CCA", "ACA"], ["TTAC", "ACGA"]
    for name, seqs in (("a.fq", one), ("b.fq", two)):
        (tmp_path / name).write_text(reads_of(seqs))
    at = lambda x: str(tmp_path / x)
    for x in "ab":
        assert cli.main(["cffq", "-c", at(x), at(f"{x}.fq")], spark) == 0
    assert symbols(spark.read.parquet(at("a/rows"))) == naive(one)
    cli.main(["merge", at("m"), at("a"), at("b")], spark)
    assert symbols(spark.read.parquet(at("m/rows"))) == naive(one + two)
    cli.main(["query", "-d", at("m"), "AC"], spark)
    out = capsys.readouterr().out.split()
    assert out[0] == "4" and sorted(x.split(",")[0] for x in out[1:]) == ["ACA$", "ACGA$", "ACGT$", "TTAC$"]
    (tmp_path / "k.txt").write_text("AC\nGG\nCA\n")
    cli.main(["massquery", "-r", at("m"), at("k.txt"), at("counts")], spark)
    got = {r[0]: (r[1], r[2]) for r in spark.read.csv(at("counts"), header=True).collect()}
    assert got == {"AC": ("4", "1"), "GG": ("0", "1"), "CA": ("2", "0")}
    cli.main(["compress", at("a"), at("runs")], spark)
    assert sorted(map(tuple, spark.read.parquet(at("runs")).collect())) == sorted(map(tuple, spark.read.parquet(at("a/runs")).collect()))
    cli.main(["decompress", at("runs"), at("plain")], spark)
    assert symbols(spark.read.parquet(at("plain"))) == naive(one)
    (tmp_path / "raw.txt").write_text(naive(one))
    cli.main(["convert", at("raw.txt"), at("raw")], spark)
    assert sorted(map(tuple, spark.read.parquet(at("raw")).collect())) == sorted(map(tuple, spark.read.parquet(at("runs")).collect()))


def test_prepare_and_delete(spark, tmp_path):
    from readloom.plans.engine import Index

    (tmp_path / "a.fa").write_text(">x\nACGT\n>y\nCCA\n>z\nACA\n")
    cli.main(["pp", str(tmp_path / "p"), str(tmp_path / "a.fa")], spark)
    cli.main(["cfpp", str(tmp_path / "i"), str(tmp_path / "p")], spark)
    i = Index.load(spark, str(tmp_path / "i"))
    left = i.remove(i.reads.filter("seq = 'CCA'"))
    assert symbols(left.rows) == naive(["ACGT", "ACA"]) and left.count("AC") == 2 and left.count("A$AC") == 1
    assert [(r["read_rank"], r["seq"]) for r in left.reads.orderBy("read_rank").collect()] == [(0, "ACA"), (1, "ACGT")]
