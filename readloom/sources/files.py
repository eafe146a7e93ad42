"""Readers of sequence files. Text formats are read as lines, in blocks, with a line number that no single task counts."""

from __future__ import annotations

import gzip
import struct
import uuid
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readloom.plans.store import scratch_dir, stored


#: Blocks of files whose offsets a broadcast may hold; more are joined.
BLOCKS = 200_000


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, file_id, line_no, value) of text files (``.gz`` too). No line is shuffled.

    A task numbers its lines as it reads them, block after block of a file, so a line's place in its block is its number less
    the first of the block; the lines of the blocks before it are added. File ids follow the file names.
    """
    raw = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"))
    sizes = stored(raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("first")))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("file", "block", (before - F.col("first")).alias("o"), (F.dense_rank().over(W.orderBy("file")) - 1).cast("int").alias("file_id"))
    few = sizes.limit(BLOCKS + 1).count() <= BLOCKS
    d = raw.join(F.broadcast(offsets) if few else offsets, ["file", "block"])
    return d.select("file", "file_id", (F.col("o") + F.col("m")).alias("line_no"), F.regexp_replace("value", r"\r$", "").alias("value"))


_FASTQ = "file_id int, seq_id long, whole boolean, name string, seq string, plus string, qual string"


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of four neighbouring lines, and, for those cut by a task's edges, a row for each line they have here."""
    names = ["name", "seq", "plus", "qual"]
    held: pa.Table | None = None

    def out(t: pa.Table, last: bool) -> tuple[pa.Table | None, pa.RecordBatch]:
        file_id, line, value = (t.column(c).combine_chunks() for c in ("file_id", "line_no", "value"))
        f, n = file_id.to_numpy(zero_copy_only=False), line.to_numpy(zero_copy_only=False)
        head = np.flatnonzero(n[: max(len(n) - 3, 0)] % 4 == 0)
        head = head[(n[head + 3] == n[head] + 3) & (f[head + 3] == f[head])]
        used = np.zeros(len(n), bool)
        used[(head[:, None] + np.arange(4)).ravel()] = True
        # the last lines may go on in the next batch
        keep = 0 if last else min(3, int(np.argmax(used[::-1])) if used.any() else len(n))
        rest = np.flatnonzero(~used[: len(n) - keep])
        columns = [pa.concat_arrays([file_id.take(pa.array(x)) for x in (head, rest)]), pa.array(np.concatenate([n[head], n[rest]]) // 4), pa.array(np.arange(len(head) + len(rest)) < len(head))]
        for k in range(4):
            own = value.take(pa.array(rest))
            part = pc.if_else(pa.array(n[rest] % 4 == k), own, pa.scalar(None, own.type))
            columns.append(pa.concat_arrays([value.take(pa.array(head + k)), part]))
        batch = pa.RecordBatch.from_arrays(columns, ["file_id", "seq_id", "whole", *names])
        return (t.slice(len(n) - keep) if keep else None), batch

    for b in batches:
        t = pa.Table.from_batches([b])
        held, batch = out(t if held is None else pa.concat_tables([held, t]), False)
        yield batch
    if held is not None:
        yield out(held, True)[1]


def read_fastq(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file_id, seq_id, name, seq, plus, qual): four lines a record; a record without its second line is none.

    Records are put together where they are read; only the lines of those that a task's edge cuts are shuffled. Lines are read
    once for each of the two kinds.
    """
    d = numbered_lines(spark, paths).select("file_id", "line_no", "value").mapInArrow(_records, _FASTQ)
    names = ["name", "seq", "plus", "qual"]
    cut = d.filter("not whole").groupBy("file_id", "seq_id").agg(*[F.max(c).alias(c) for c in names])
    every = d.filter("whole").drop("whole").unionByName(cut)
    return every.filter(F.col("seq").isNotNull()).withColumn("name", F.regexp_replace("name", "^@", ""))


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file_id, seq_id, label, seq): records of a ``>`` line and any number of sequence lines; label is its first word.

    Every record of every file is kept, the last ones too.
    """
    lines = numbered_lines(spark, paths).withColumn("head", F.startswith("value", F.lit(">")))
    # running count of headers by blocks of lines
    d = lines.withColumn("b", F.floor(F.col("line_no") / 65536))
    sizes = d.groupBy("file_id", "b").agg(F.count_if("head").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file_id").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("file_id", "b", before.alias("o"))
    upto = F.sum(F.col("head").cast("long")).over(W.partitionBy("file_id", "b").orderBy("line_no"))
    d = d.withColumn("u", upto).join(offsets, ["file_id", "b"]).withColumn("seq_id", F.col("o") + F.col("u") - 1).filter("seq_id >= 0")
    label = F.max(F.when(F.col("head"), F.split(F.substring("value", 2, 1 << 30), " ")[0])).alias("label")
    body = F.sort_array(F.collect_list(F.when(~F.col("head"), F.struct("line_no", "value"))))
    return d.groupBy("file_id", "seq_id").agg(label, F.array_join(F.transform(body, lambda x: F.trim(x["value"])), "").alias("seq"))


def read_kmers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(line, kmer) of a file with one k-mer a line."""
    return numbered_lines(spark, paths).select(F.col("line_no").alias("line"), F.col("value").alias("kmer")).filter("kmer <> ''")


def read_raw_index(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(line_no, value) of raw index text, for ``codecs.convert_text``."""
    return numbered_lines(spark, paths).select("line_no", "value")


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """(kmer, cnt) of a profile CSV; its ``total`` line is the length of the counts and follows from them."""
    return spark.read.schema("kmer string, cnt string").csv(path).filter("kmer <> 'total'").select("kmer", F.col("cnt").cast("long").alias("cnt"))


def write_profile(profile: DataFrame, path: str) -> None:
    """CSV lines ``kmer,count`` sorted by k-mer, after a line ``total,<length>``."""
    from readloom.operators.search import norm

    total = norm(profile).select(F.lit(" ").alias("o"), F.lit("total").alias("kmer"), F.round("l2", 6).cast("string").alias("cnt"))
    rows = profile.select(F.col("kmer").alias("o"), "kmer", F.col("cnt").cast("string").alias("cnt"))
    total.unionByName(rows).orderBy("o").select("kmer", "cnt").write.csv(path)


def write_massquery(counts: DataFrame, path: str) -> None:
    """CSV with a header, in the order of the query file."""
    names = {"kmer": "k-mer", "rev_comp_counts": "revCompCounts"}
    d = counts.orderBy("line").drop("line") if "line" in counts.columns else counts
    d.select([F.col(c).alias(names.get(c, c)) for c in d.columns]).write.option("header", True).csv(path)


#: Lines of standard input held at once.
STDIN_LINES = 200_000


def read_stream(spark: SparkSession, lines: Iterable[str]) -> DataFrame:
    """(line_no, value) of lines that only the driver can read, such as standard input, stored some at a time."""
    path, first, at = f"{scratch_dir(spark)}/stdin-{uuid.uuid4().hex}", True, 0
    it = iter(lines)
    while (part := list(islice(it, STDIN_LINES))) or first:
        rows = [(at + i, x.rstrip("\r\n")) for i, x in enumerate(part)]
        spark.createDataFrame(rows, "line_no long, value string").write.mode("append").parquet(path)
        first, at = False, at + len(part)
    return spark.read.parquet(path)


#: Fixed value: the symbols of the 4-bit codes in alignment files.
_BASES = "=ACMGRSVTWYHKDBN"
#: Compressed bytes of a part of an alignment file, which a task decompresses.
PART = 1 << 22
_PARTS = "path string, part int, last boolean, split boolean, data binary"
_RECORD = "path string, qname string, flag int, seq string"
_PARSED = f"{_RECORD}, part int, last boolean, found boolean, head binary, tail binary"


def _bam_record(data: bytes, at: int) -> tuple[str, int, str]:
    """(qname, flag, seq) of the record at ``at``."""
    _, _, _, l_name, _, _, n_cigar, flag, l_seq = struct.unpack_from("<iiiBBHHHi", data, at)
    p = at + 36
    name = data[p : p + l_name - 1].decode()
    p += l_name + 4 * n_cigar
    packed = data[p : p + (l_seq + 1) // 2]
    return name, flag, "".join(_BASES[x >> 4] + _BASES[x & 15] for x in packed)[:l_seq]


def _after_header(data: bytes) -> int:
    if data[:4] != b"BAM\1":
        raise ValueError("not an alignment file")
    at = 8 + struct.unpack_from("<i", data, 4)[0]
    n, at = struct.unpack_from("<i", data, at)[0], at + 4
    for _ in range(n):
        at += 8 + struct.unpack_from("<i", data, at)[0]
    return at


def _plausible(data: bytes, at: int) -> bool:
    """Whether the bytes at ``at`` can begin a record; where they are too few to tell, they can."""
    if at + 36 > len(data):
        return at + 4 > len(data) or struct.unpack_from("<i", data, at)[0] >= 32
    size, ref, pos, l_name, _, _, n_cigar, _, l_seq = struct.unpack_from("<iiiBBHHHi", data, at)
    if size < 32 or ref < -1 or pos < -1 or l_name < 1 or l_seq < 0 or 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq > size:
        return False
    return at + 36 + l_name > len(data) or data[at + 36 + l_name - 1] == 0


def _walk(data: bytes, at: int) -> tuple[list[int], int]:
    """Where whole records begin from ``at`` on, and where what is left begins; -1 if a record cannot be."""
    starts = []
    while at + 4 <= len(data):
        if not _plausible(data, at):
            return starts, -1
        if (after := at + 4 + struct.unpack_from("<i", data, at)[0]) > len(data):
            break
        starts.append(at)
        at = after
    return starts, at


def _bgzf_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files cut into parts of whole compressed blocks, by the sizes in the blocks' headers; other files are one part."""
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            cuts, at = [0], 0
            while at + 18 <= len(content) and content[at : at + 4] == b"\x1f\x8b\x08\x04" and content[at + 12 : at + 14] == b"BC":
                at += struct.unpack_from("<H", content, at + 16)[0] + 1
                if at - cuts[-1] >= PART and at < len(content):
                    cuts.append(at)
            split = at == len(content) and len(cuts) > 1
            cuts = [*cuts, len(content)] if split else [0, len(content)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                yield pa.RecordBatch.from_pylist([{"path": path, "part": k, "last": k == len(cuts) - 2, "split": split, "data": content[a:b]}], schema=pa.schema([("path", pa.string()), ("part", pa.int32()), ("last", pa.bool_()), ("split", pa.bool_()), ("data", pa.binary())]))


_ARROW = pa.schema([("path", pa.string()), ("qname", pa.string()), ("flag", pa.int32()), ("seq", pa.string()), ("part", pa.int32()), ("last", pa.bool_()), ("found", pa.bool_()), ("head", pa.binary()), ("tail", pa.binary())])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records that lie in a part, and a row for its edges: what is before its first record, and behind its last one.

    In parts behind the first, the first record is at the first place from which records follow each other to the end; a part
    without such a place is taken for the end of a record.
    """
    for batch in batches:
        for path, k, last, data in zip(*(batch.column(c).to_pylist() for c in ("path", "part", "last", "data")), strict=True):
            data = gzip.decompress(data)
            begin = [_after_header(data)] if k == 0 else range(len(data))
            start, starts, end = next(((at, *w) for at in begin if _plausible(data, at) and (w := _walk(data, at))[1] >= 0 and (k == 0 or w[0])), (len(data), [], len(data) if k else -1))
            for a in range(0, len(starts), 50_000):
                rows = [dict(zip(("qname", "flag", "seq"), _bam_record(data, at), strict=True)) for at in starts[a : a + 50_000]]
                yield pa.RecordBatch.from_pylist([{"path": path, "part": k, "last": last, **r} for r in rows], schema=_ARROW)
            edge = {"path": path, "part": k, "last": last, "found": end >= 0, "head": data[:start] if k else b"", "tail": data[max(end, 0) :]}
            yield pa.RecordBatch.from_pylist([edge], schema=_ARROW)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For (path, found, tail, head): whether the end of a part and the beginning of the next are one record, or nothing, and that record."""
    for batch in batches:
        rows = []
        for path, found, tail, head in zip(*(batch.column(c).to_pylist() for c in ("path", "found", "tail", "head")), strict=True):
            data = tail + (head or b"")
            one = len(data) >= 36 and struct.unpack_from("<i", data, 0)[0] + 4 == len(data) and _plausible(data, 0)
            q, f, s = _bam_record(data, 0) if found and one else (None, None, None)
            rows.append({"path": path, "good": found and (one or not data), "qname": q, "flag": f, "seq": s})
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([*list(_ARROW)[:4], ("good", pa.bool_())]))


def _sequential(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All records of whole files."""
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            data = gzip.decompress(content)
            starts, end = _walk(data, _after_header(data))
            if end != len(data):
                raise ValueError(f"{path}: a record is cut or damaged")
            for a in range(0, len(starts), 50_000):
                rows = [dict(zip(("path", "qname", "flag", "seq"), (path, *_bam_record(data, at)), strict=True)) for at in starts[a : a + 50_000]]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(_ARROW)[:4]))


def read_bam(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file_id, qname, flag, seq) of alignment files.

    A file's compressed blocks are dealt over many tasks in parts. A part finds its first record by itself, and whether all parts
    of a file found the right place is checked then: the first part's is known, and what is left at a part's end has to be one
    record with what the next part has before its first one. Files of which that is not true, or that have no such
    blocks, are read by one task each. A file as a whole has to fit in a row, as Spark reads it.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    ids = files.select("path").distinct().withColumn("file_id", (F.row_number().over(W.orderBy("path")) - 1).cast("int"))
    parts = stored(files.mapInArrow(_bgzf_parts, _PARTS))
    n = max(1, parts.filter("split").count())
    d = stored(parts.filter("split").repartition(n, "path", "part").mapInArrow(_parsed, _PARSED))
    edges = d.filter("found is not null").withColumn("head", F.lead("head").over(W.partitionBy("path").orderBy("part")))
    edges = stored(edges.select("path", "found", "tail", "head").mapInArrow(_edges, f"{_RECORD}, good boolean"))
    odd = edges.filter("not good").select("path").distinct()
    shared = edges.filter("qname is not null").drop("good")
    whole = d.filter("found is null").select("path", "qname", "flag", "seq").unionByName(shared).join(odd, "path", "left_anti")
    alone = parts.filter("not split").select("path").unionByName(odd).distinct()
    rest = files.join(alone, "path", "left_semi").mapInArrow(_sequential, _RECORD)
    return whole.unionByName(rest).join(F.broadcast(ids), "path").drop("path")  # a row a file


def read_sam(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file_id, qname, flag, seq) of alignment text."""
    cols = F.split("value", "\t")
    d = numbered_lines(spark, paths).filter(~F.startswith("value", F.lit("@")))
    return d.select("file_id", cols[0].alias("qname"), cols[1].cast("int").alias("flag"), cols[9].alias("seq"))


def reads_of_alignments(alignments: DataFrame) -> DataFrame:
    """(file_id, seq_id, mate_file_id, mate_seq_id, seq) for ``prepare_reads``.

    One read for each name and segment (flag 0x40: the first); reversed ones (0x10) are turned back. First segments are
    file 2 * file_id, others 2 * file_id + 1; a read without a mate has nulls.
    """
    from readloom.functions.dna import reverse_complement
    from readloom.plans.ranking import ranked

    seq = F.when(F.col("flag").bitwiseAND(F.lit(16)) != 0, reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    d = alignments.select("file_id", "qname", F.when(F.col("flag").bitwiseAND(F.lit(64)) != 0, 0).otherwise(1).alias("segment"), seq.alias("seq"))
    d = d.groupBy("file_id", "qname", "segment").agg(F.min("seq").alias("seq"))
    names = ranked(d.select("file_id", "qname").distinct(), [F.col("file_id").asc(), F.col("qname").asc()], "seq_id")
    d = d.join(names, ["file_id", "qname"]).select("qname", (F.col("file_id") * 2 + F.col("segment")).cast("int").alias("file_id"), "seq_id", "seq")
    mate = d.select("qname", "seq_id", F.col("file_id").alias("mate_file_id"), F.col("seq_id").alias("mate_seq_id"))
    paired = d.join(mate, ["qname", "seq_id"], "left").filter("mate_file_id <> file_id")
    alone = d.join(paired.select("file_id", "seq_id"), ["file_id", "seq_id"], "left_anti").withColumn("mate_file_id", F.lit(None).cast("int")).withColumn("mate_seq_id", F.lit(None).cast("long"))
    return paired.unionByName(alone).drop("qname")
