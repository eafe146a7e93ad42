"""Indexes that grow by batches and go on after a break: steps are kept by what went into them.

A part is an index of some batches, in a folder named after a hash of what it was made from, with its tables (reads, rows, bins)
as steps. A step whose table was committed (Spark's ``_SUCCESS``) is read and not made again, so a build that was stopped goes
on behind its last step. Parts have levels: a batch is a part of level 0, and two neighbours of one level are merged into one
of the next, so that a batch is merged as often as the number of batches has binary digits, and appending one leaves the parts
of higher levels alone. The list of parts is a small table written anew beside the old one.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.operators import bins, doubling, index
from readloom.plans.engine import Index


def _fs(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def step(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, made and written unless it was committed before."""
    if not _exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def fingerprint(spark: SparkSession, paths: str | list[str]) -> str:
    """A hash of the names, sizes and times of files."""
    found = []
    for p in [paths] if isinstance(paths, str) else paths:
        fs, at = _fs(spark, p)
        found += [(str(s.getPath()), s.getLen(), s.getModificationTime()) for s in fs.globStatus(at) or []]
    return hashlib.sha256(json.dumps(sorted(found)).encode()).hexdigest()


class Levels:
    """The parts of a growing index below ``root``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def parts(self) -> list[dict]:
        """[{name, level, batches}] in the order of their batches; a row a part, some log2 of the batches."""
        version = self._version()
        return [] if version < 0 else [r.asDict() for r in self.spark.read.parquet(f"{self.root}/parts-{version}").orderBy("at").select("name", "level", "batches").collect()]

    def _version(self) -> int:
        fs, at = _fs(self.spark, f"{self.root}/parts-*")
        done = [s.getPath() for s in fs.globStatus(at) or [] if fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return max((int(p.getName().split("-")[1]) for p in done), default=-1)

    def _note(self, parts: list[dict]) -> None:
        rows = [(i, p["name"], p["level"], p["batches"]) for i, p in enumerate(parts)]
        self.spark.createDataFrame(rows, "at int, name string, level int, batches int").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/parts-{self._version() + 1}")

    def load(self, name: str) -> Index:
        return Index.load(self.spark, f"{self.root}/{name}")

    def _made(self, name: str, reads: Callable[[], DataFrame], rows: Callable[[DataFrame], DataFrame]) -> Index:
        at = f"{self.root}/{name}"
        r = step(self.spark, f"{at}/reads", reads)
        i = step(self.spark, f"{at}/rows", lambda: rows(r).repartitionByRange("row").sortWithinPartitions("row"))
        step(self.spark, f"{at}/bins", lambda: bins.text_bins(i))
        return self.load(name)

    def append(self, batch: DataFrame, key: str) -> list[dict]:
        """Add the reads ``batch`` (seq_id, seq); ``key`` says what it is, such as the ``fingerprint`` of its files.

        A batch of a key that is there already (the last one appended) is not added again. file_id becomes the number of the
        batch. Returns the parts.
        """
        parts = self.parts()
        name = f"batch-{hashlib.sha256(key.encode()).hexdigest()[:32]}"
        if not any(name == p["name"] or name in self._held(p["name"]) for p in parts):
            number = sum(p["batches"] for p in parts)
            self._made(name, lambda: index.prepare_reads(batch.withColumn("file_id", F.lit(number))), index.build)
            parts.append({"name": name, "level": 0, "batches": 1})
            self._note(parts)
        # whatever a stopped call has left to merge is merged now
        while len(parts) > 1 and parts[-1]["level"] == parts[-2]["level"]:
            a, b = parts[-2:]
            merged = {"name": f"merge-{hashlib.sha256((a['name'] + b['name']).encode()).hexdigest()[:32]}", "level": a["level"] + 1, "batches": a["batches"] + b["batches"]}
            self._merge(merged["name"], a["name"], b["name"])
            parts = [*parts[:-2], merged]
            self._note(parts)
        return parts

    def _held(self, name: str) -> list[str]:
        """The names of the batches in a merged part."""
        at = f"{self.root}/{name}/of"
        return [r["name"] for r in self.spark.read.parquet(at).collect()] if _exists(self.spark, f"{at}/_SUCCESS") else []

    def _merge(self, name: str, *of: str) -> Index:
        sources = [self.load(x) for x in of]
        held = [x for n in of for x in (self._held(n) or [n])]
        step(self.spark, f"{self.root}/{name}/of", lambda: self.spark.createDataFrame([(x,) for x in held], "name string").coalesce(1))
        both: dict[str, DataFrame] = {}

        def merged(what: str) -> DataFrame:
            if not both:
                both["reads"], both["rows"] = doubling.merge_rows(*[(s.reads, s.rows) for s in sources])
            return both[what]

        def reads() -> DataFrame:
            own = None
            for i, s in enumerate(sources):
                d = s.reads.select(F.lit(i).alias("source_id"), F.col("read_rank").alias("old"), F.col("file_id").alias("f"), F.col("seq_id").alias("s"))
                own = d if own is None else own.unionByName(d)
            # reads keep the ids of their batch
            return merged("reads").withColumnRenamed("seq_id", "old").join(own, ["source_id", "old"]).select("read_rank", F.col("f").alias("file_id"), F.col("s").alias("seq_id"), "seq")

        return self._made(name, reads, lambda _: merged("rows").select("row", "read_rank", "pos", "sym"))

    def merged(self) -> Index:
        """One index of all batches; it is kept as well, but not among the parts."""
        parts = self.parts()
        if not parts:
            raise ValueError("no batch was appended")
        if len(parts) == 1:
            return self.load(parts[0]["name"])
        names = [p["name"] for p in parts]
        return self._merge(f"all-{hashlib.sha256(''.join(names).encode()).hexdigest()[:32]}", *names)
