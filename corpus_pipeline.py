"""Cleaning a corpus: the stages, each of which reads what its predecessor wrote.

Quality rules, line deduplication, near-duplicate removal, mixing to target weights, packing. All stages but the last
keep the columns of ``documents``, whatever their names; the mix repeats a row as often as it has copies.

Null and blank texts fail the quality rules. Rows that are alike in id, text and language have one verdict; rows of one
id are one document to the near duplicates. Null sources are one source. An empty table gives no rows in any stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import line_dedup, mixing, near_dedup, packing, quality
from readloom.llm.common import scratch_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. A document's verdict is found by its id and a hash of its text."""
    # 128 bits: two hashes of unrelated seeds
    keyed = docs.withColumn("__k", F.struct(F.xxhash64("doc_id", "text", "lang"), F.xxhash64(F.lit("k"), "doc_id", "text", "lang")))
    out = quality.judge(keyed.select("__k", "text", "lang")).filter(~F.col("kept")).select("__k").distinct()
    return keyed.join(out, "__k", "left_anti").drop("__k")


def _aside(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its own columns of these names (or of this prefix) called otherwise, and how to call them back."""
    held = {c: f"__own_{c}" for c in docs.columns if c.lower().startswith(names)}
    return docs.withColumnsRenamed(held), {v: k for k, v in held.items()}


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines; those of which nothing is left go."""
    docs, back = _aside(docs, ("n_lines", "n_removed"))
    d = line_dedup.dedup_lines(docs)
    d = d.filter((F.col("n_removed") == 0) | F.rlike(F.col("text"), F.lit(r"[^\x20\x09-\x0D]")))
    return d.drop("n_lines", "n_removed").withColumnsRenamed(back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    return near_dedup.deduplicate(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    docs, back = _aside(docs, ("mix_",))
    return mixing.repeated(mixing.mix(docs)).withColumnsRenamed(back)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("line dedup", dedup_lines), ("near duplicates", near_duplicates), ("mixing", mix_sources), ("packing", pack)]

#: The hashes that round the mix and lay out the packing have no SQL; tests hold the first three stages against brute force,
#: and the others against what they promise.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = f"{scratch_dir(spark)}/stage-{i}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
