"""One object for an index on disk: its reads and its suffix-ordered rows as Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions.dna import ALPHABET, checked
from readloom.operators import bins, codecs, doubling, index, search
from readloom.sources import files


class Index:
    """A read collection with its index. Tables are lazily evaluated until saved."""

    def __init__(self, reads: DataFrame, rows: DataFrame | None = None, held: DataFrame | None = None) -> None:
        self.reads = reads
        self.rows = index.build(reads) if rows is None else rows
        self._bins = held

    def bins(self) -> DataFrame:
        """The bins that searches step through; made at first use, unless they were saved."""
        if self._bins is None:
            self._bins = bins.text_bins(self.rows)
        return self._bins

    def suffixed(self) -> DataFrame:
        return index.suffixed(self.rows, self.reads)

    @classmethod
    def from_strings(cls, spark: SparkSession, seqs: list[str], uniform: bool = False) -> Index:
        """From strings with or without their ``$``."""
        rows = [(i, s.removesuffix("$")) for i, s in enumerate(seqs)]
        return cls(index.prepare_reads(spark.createDataFrame(rows, "seq_id long, seq string"), uniform))

    @classmethod
    def from_fastq(cls, spark: SparkSession, paths, uniform: bool = False) -> Index:
        return cls(index.prepare_reads(files.read_fastq(spark, paths), uniform))

    @classmethod
    def from_fasta(cls, spark: SparkSession, paths, uniform: bool = False) -> Index:
        return cls(index.prepare_reads(files.read_fasta(spark, paths), uniform))

    @classmethod
    def from_bam(cls, spark: SparkSession, paths, uniform: bool = False) -> Index:
        return cls(index.prepare_reads(files.reads_of_alignments(files.read_bam(spark, paths)), uniform))

    @classmethod
    def load(cls, spark: SparkSession, path: str, in_memory: bool = False) -> Index:
        parts = [spark.read.parquet(f"{path}/{name}") for name in ("reads", "rows", "bins")]
        return cls(*[p.cache() for p in parts]) if in_memory else cls(*parts)

    def save(self, path: str, mode: str = "errorifexists") -> Index:
        """Write reads, rows and bins; the latter two are laid out by number, so a range of them prunes files and row groups."""
        self.reads.write.mode(mode).parquet(f"{path}/reads")
        self.rows.repartitionByRange("row").sortWithinPartitions("row").write.mode(mode).parquet(f"{path}/rows")
        bins.text_bins(self.reads.sparkSession.read.parquet(f"{path}/rows")).write.mode(mode).parquet(f"{path}/bins")
        return Index.load(self.reads.sparkSession, path)

    @staticmethod
    def merge(*parts: Index) -> Index:
        """The index of all reads; ties go to the earlier part. Stored rows are interleaved, not sorted by suffix again."""
        reads, rows = doubling.merge_rows(*[(p.reads, p.rows) for p in parts])
        return Index(reads, rows.select("row", "read_rank", "pos", "sym"))

    def remove(self, ranks: DataFrame) -> Index:
        top = self.reads.agg(F.max("read_rank")).first()[0]
        if ranks.filter((F.col("read_rank") < 0) | (F.col("read_rank") > F.lit(-1 if top is None else top))).limit(1).count():
            raise ValueError("read_rank out of range")
        return Index(index.remove_reads(self.reads, ranks), index.remove_rows(self.rows, ranks))

    def size(self) -> int:
        return self.rows.count()

    def symbol_count(self, sym: str) -> int:
        return self.rows.filter(F.col("sym") == sym).count()

    def bin_bits(self) -> int:
        return index.BIN_BITS

    def count(self, pattern: str, given: tuple[int, int] | None = None) -> int:
        low, high = self.range(pattern, given)
        return high - low

    def range(self, pattern: str, given: tuple[int, int] | None = None) -> tuple[int, int]:
        """The rows whose rotation starts with ``pattern``; ``given`` is the range of what follows it, if that is known."""
        if set(pattern) - set(ALPHABET):
            raise ValueError(f"pattern outside {ALPHABET}: {pattern}")
        row, kind = ((pattern,), "pattern string") if given is None else ((pattern, *given), "pattern string, given_l long, given_h long")
        r = bins.find(self.bins(), self.reads.sparkSession.createDataFrame([row], kind)).first()
        return r["l"], r["h"]

    def wildcard(self, pattern: str) -> DataFrame:
        longest = self.reads.agg(F.coalesce(F.max(F.length("seq")), F.lit(0))).first()[0] + 1
        return search.wildcard_ranges(self.suffixed(), self.reads, pattern, longest)

    def query(self, pattern: str) -> DataFrame:
        """(row, read_rank, read) of each hit: the pattern's range, and the reads of its rows."""
        low, high = self.range(pattern)
        hits = self.rows.filter((F.col("row") >= low) & (F.col("row") < high)).select("row", "read_rank")
        q = self.reads.select("read_rank", F.concat("seq", F.lit("$")).alias("read"))
        return hits.join(q, "read_rank").select("row", "read_rank", "read").orderBy("row")

    def massquery(self, kmers: DataFrame, reverse: bool = False) -> DataFrame:
        return search.mass_query(kmers.withColumn("kmer", checked(F.col("kmer"))), self.reads, reverse)

    def runs(self) -> DataFrame:
        return codecs.run_lengths(self.rows)
