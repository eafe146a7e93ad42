"""``python -m readloom.cli``: build, merge, query and convert indexes."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from readloom import __version__
from readloom.functions.dna import ALPHABET
from readloom.operators import codecs, index
from readloom.plans.engine import Index
from readloom.plans.store import clean
from readloom.sources import files


def reads_file(path: str) -> str:
    """A file of reads, by its name's end."""
    if not path.removesuffix(".gz").endswith((".txt", ".fastq", ".fq", ".fa", ".fasta", ".fna", ".bam")) and not path.endswith(".gz"):
        raise argparse.ArgumentTypeError(f"not a file of reads (.fastq, .fq, .txt, .fa, .fasta, .fna, .bam, .gz): {path}")
    return path


def pattern(kmer: str) -> str:
    if set(kmer) - set(ALPHABET):
        raise argparse.ArgumentTypeError(f"symbol outside {ALPHABET}: {kmer}")
    return kmer


def _there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.globStatus(at))


def checked_paths(a: argparse.Namespace, spark: SparkSession) -> None:
    """Inputs have to exist, outputs must not: said before any work begins."""
    inputs = [getattr(a, name, None) for name in ("prepared", "index", "kmers", "input")] + list(getattr(a, "inputs", []))
    for path in inputs:
        if path not in (None, "-") and not _there(spark, path):
            raise FileNotFoundError(f"no such input: {path}")
    if getattr(a, "out", None) and _there(spark, a.out) and _there(spark, f"{a.out}/*"):
        raise FileExistsError(f"output is there already: {a.out}")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="readloom")
    p.add_argument("-V", "--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, what in (("cffq", "build an index from FASTQ"), ("cffa", "build an index from FASTA"), ("cfbam", "build an index from BAM"), ("pp", "prepare reads only")):
        c = sub.add_parser(name, help=what)
        c.add_argument("-u", "--uniform", action="store_true", help="all reads have one length")
        c.add_argument("-c", "--compressed", action="store_true", help="write the runs of the index as well")
        c.add_argument("out")
        c.add_argument("inputs", nargs="+", type=reads_file)
    c = sub.add_parser("cfpp", help="build an index from prepared reads")
    c.add_argument("out")
    c.add_argument("prepared")
    c = sub.add_parser("merge", help="merge any number of indexes")
    c.add_argument("out")
    c.add_argument("inputs", nargs="+")
    c = sub.add_parser("query", help="count a pattern")
    c.add_argument("-d", "--dump", action="store_true", help="list the reads")
    c.add_argument("index")
    c.add_argument("kmer", type=pattern)
    c = sub.add_parser("massquery", help="count every k-mer of a file")
    c.add_argument("-r", "--reverse", action="store_true")
    c.add_argument("index")
    c.add_argument("kmers")
    c.add_argument("out")
    for name, what in (("compress", "runs of an index"), ("decompress", "symbols of runs"), ("convert", "runs of raw index text (- is standard input)")):
        c = sub.add_parser(name, help=what)
        c.add_argument("input")
        c.add_argument("out")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    own = spark is None
    spark = spark or SparkSession.builder.appName("readloom").getOrCreate()
    try:
        run(a, spark)
    finally:
        if own:
            clean(spark)
    return 0


def run(a: argparse.Namespace, spark: SparkSession) -> None:
    checked_paths(a, spark)
    if a.command in ("cffq", "cffa", "cfbam"):
        if a.command == "cfbam":
            i = Index.from_bam(spark, a.inputs, a.uniform).save(a.out)
        else:
            i = (Index.from_fastq if a.command == "cffq" else Index.from_fasta)(spark, a.inputs, a.uniform).save(a.out)
        if a.compressed:
            i.runs().write.parquet(f"{a.out}/runs")
    elif a.command == "pp":
        kinds = {"bam" if x.endswith(".bam") else "fasta" if x.removesuffix(".gz").endswith((".fa", ".fasta", ".fna")) else "fastq" for x in a.inputs}
        if len(kinds) > 1:
            raise ValueError(f"inputs of one kind only: {sorted(kinds)}")
        read = {"bam": lambda s, x: files.reads_of_alignments(files.read_bam(s, x)), "fasta": files.read_fasta, "fastq": files.read_fastq}[kinds.pop()]
        prepared = index.prepare_reads(read(spark, a.inputs), a.uniform)
        prepared.write.parquet(f"{a.out}/reads")
        if a.compressed:
            codecs.run_lengths(index.build(prepared)).write.parquet(f"{a.out}/runs")
    elif a.command == "cfpp":
        Index(spark.read.parquet(f"{a.prepared}/reads")).save(a.out)
    elif a.command == "merge":
        Index.merge(*[Index.load(spark, x) for x in a.inputs]).save(a.out)
    elif a.command == "query":
        i = Index.load(spark, a.index)
        print(i.count(a.kmer))
        if a.dump:
            for r in i.query(a.kmer).toLocalIterator():
                print(f"{r['read']},{r['read_rank']}")
    elif a.command == "massquery":
        files.write_massquery(Index.load(spark, a.index).massquery(files.read_kmers(spark, a.kmers), a.reverse), a.out)
    elif a.command == "compress":
        Index.load(spark, a.input).runs().write.parquet(a.out)
    elif a.command == "decompress":
        codecs.decode(spark.read.parquet(a.input)).write.parquet(a.out)
    else:
        lines = files.read_stream(spark, sys.stdin) if a.input == "-" else files.read_raw_index(spark, a.input)
        codecs.text_runs(lines).write.parquet(a.out)


if __name__ == "__main__":
    sys.exit(main())
