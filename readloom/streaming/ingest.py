"""Streaming ingest: k-mer counts of reads as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions.dna import windows


def kmer_stream(reads: DataFrame, k: int) -> DataFrame:
    """Running (kmer, cnt) of a stream of (seq): a stateful count, for update or complete output."""
    return reads.select(F.explode(windows(F.col("seq"), k)).alias("kmer")).groupBy("kmer").agg(F.count(F.lit(1)).alias("cnt"))


def windowed_kmer_stream(reads: DataFrame, k: int, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """(window, kmer, cnt) of a stream of (ts, seq); windows close when the watermark passes them."""
    d = reads.withWatermark("ts", late).select("ts", F.explode(windows(F.col("seq"), k)).alias("kmer"))
    return d.groupBy(F.window("ts", width), "kmer").agg(F.count(F.lit(1)).alias("cnt"))
