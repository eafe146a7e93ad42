"""The suffix-ordered index of a read collection as a DataFrame.

One row for every position of every ``$``-ended read, ordered by suffix and read rank. ``sym`` is the symbol before the
suffix (cyclic within the read): read down the rows it is the Burrows-Wheeler transform of the collection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readloom.functions.dna import SYMBOLS, common_prefix, is_valid
from readloom.plans.prefix import before
from readloom.plans.ranking import ranked
from readloom.plans.store import stored

#: Rows of a bin of the sampled index.
BIN_BITS = 11
#: Bins that make a block of the two-level running sums.
BLOCK_BITS = 12


def prepare_reads(df: DataFrame, uniform: bool = False) -> DataFrame:
    """(read_rank, file_id, seq_id, seq) sorted by (seq + ``$``, file_id, seq_id); rejects symbols outside ACGNT.

    ``part`` (long), where there is one, tells reads of one seq_id apart and is the last in the order. Null sequences are empty
    reads. ``uniform`` demands one common length.
    """
    keep = [c for c in ("part", "mate_file_id", "mate_seq_id", "source_id") if c in df.columns]
    file_id = F.col("file_id").cast("int") if "file_id" in df.columns else F.lit(0)
    d = df.select(file_id.alias("file_id"), F.col("seq_id").cast("long").alias("seq_id"), F.coalesce("seq", F.lit("")).alias("seq"), *keep)
    good = is_valid(F.col("seq")) & ~F.contains("seq", F.lit("$"))
    d = d.withColumn("seq", F.when(F.assert_true(good, F.lit("read with a symbol outside ACGNT")).isNull(), F.col("seq")))
    if uniform:
        span = d.agg((F.min(F.length("seq")) == F.max(F.length("seq"))).alias("__same"))
        d = d.crossJoin(F.broadcast(span))  # one row
        d = d.withColumn("seq", F.when(F.assert_true("__same", F.lit("reads differ in length")).isNull(), F.col("seq"))).drop("__same")
    order = [F.concat("seq", F.lit("$")).asc(), *[F.col(c).asc() for c in ("file_id", "seq_id", "part") if c in d.columns]]
    return ranked(d, order, "read_rank").select("read_rank", "file_id", "seq_id", "seq", *keep)


def build(reads: DataFrame, keep: tuple[str, ...] = ("read_rank", "pos", "suffix", "sym")) -> DataFrame:
    """(row, read_rank, pos, suffix, sym) of prepared reads (any lengths), or row and the columns ``keep`` of them: others aren't stored.

    Short reads are sorted as packed keys (:mod:`readloom.operators.packed`), longer ones as strings.
    """
    from readloom.operators import packed  # which needs only plans

    known = packed.measured(reads)
    if packed.fits(known):
        return packed.Sorted(reads, keep, known=known).rows(*keep)
    q = F.concat("seq", F.lit("$"))
    d = reads.select("read_rank", q.alias("q")).select("read_rank", "q", F.explode(F.sequence(F.lit(0), F.length("q") - 1)).alias("pos"))
    d = d.select(
        "read_rank",
        F.col("pos").cast("int").alias("pos"),
        F.substr("q", F.col("pos") + 1).alias("suffix"),
        F.when(F.col("pos") == 0, F.lit("$")).otherwise(F.substr("q", F.col("pos"), F.lit(1))).alias("sym"),
    )
    d = d.select(*[c for c in d.columns if c in (*keep, "suffix", "read_rank")])
    return ranked(d, [F.col("suffix").asc(), F.col("read_rank").asc()], "row", list(keep)).select("row", *keep)


def sorted_rows(reads: DataFrame, keep: tuple[str, ...]):
    """The index of short reads as ``packed.Sorted``, which answers from its stored columns; of longer reads its rows, stored."""
    from readloom.operators import packed

    known = packed.measured(reads)
    return packed.Sorted(reads, keep, known=known) if packed.fits(known) else stored(build(reads, keep))


def suffixed(index: DataFrame, reads: DataFrame) -> DataFrame:
    """``index`` with its suffixes, which rows of a merge or of long reads lack: cut from the reads where they are asked for."""
    if "suffix" in index.columns:
        return index
    q = reads.select("read_rank", F.concat("seq", F.lit("$")).alias("__q"))
    return index.join(q, "read_rank").select("row", "read_rank", "pos", F.substr("__q", F.col("pos") + 1).alias("suffix"), "sym")


def rotation(index: DataFrame, reads: DataFrame, length: int) -> DataFrame:
    """``index`` with rot: the first ``length`` symbols of each row's cyclic rotation.

    Only rows whose suffix is shorter than that need their read.
    """
    short = F.length("suffix") < length
    q = reads.select("read_rank", F.concat("seq", F.lit("$")).alias("__q"))
    whole = F.concat("suffix", F.substr("__q", F.lit(1), F.col("pos")))
    turns = (F.lit(length) / F.length("__q")).cast("int") + 1
    turned = index.filter(short).join(q, "read_rank").withColumn("rot", F.substring(F.repeat(whole, turns), 1, length)).select(*index.columns, "rot")
    return index.filter(~short).withColumn("rot", F.substring("suffix", 1, length)).unionByName(turned)


def starting(index: DataFrame, prefix: str) -> DataFrame:
    """Rows whose rotation may start with ``prefix``: by the suffix, which prunes stored rows, or over the read's end."""
    over = [prefix[: i + 1] for i, c in enumerate(prefix[:-1]) if c == "$"]
    return index.filter(F.col("suffix").startswith(prefix) | F.col("suffix").isin(over) if over else F.col("suffix").startswith(prefix))


def symbol_counts(index: DataFrame) -> DataFrame:
    """(sym, cnt) for all six symbols."""
    every = index.sparkSession.createDataFrame([(s,) for s in SYMBOLS], "sym string")
    got = index.groupBy("sym").agg(F.count(F.lit(1)).alias("cnt"))
    return every.join(F.broadcast(got), "sym", "left").select("sym", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))


def c_array(counts: DataFrame) -> DataFrame:
    """(sym, cnt, start_row, end_row): where each symbol's block begins and ends. Six rows."""
    upto = F.sum("cnt").over(W.orderBy("sym"))
    return counts.select("sym", "cnt", (upto - F.col("cnt")).cast("long").alias("start_row"), upto.cast("long").alias("end_row"))


def fm_bins(index: DataFrame, bin_bits: int = BIN_BITS) -> DataFrame:
    """The sampled index: for every bin of 2^bin_bits rows (bin_id), base_<symbol> = C + occurrences before the bin.

    ``$`` is written as ``end``. Running sums are kept inside blocks of 2^BLOCK_BITS bins, and over the sums of blocks.
    """
    names = {s: "end" if s == "$" else s.lower() for s in SYMBOLS}
    bins = index.groupBy(F.shiftright("row", bin_bits).alias("bin_id")).agg(*[F.count_if(F.col("sym") == s).alias(n) for s, n in names.items()])
    start = c_array(symbol_counts(index))
    c = start.agg(*[F.max(F.when(F.col("sym") == s, F.col("start_row"))).alias(f"start_{n}") for s, n in names.items()])
    d = stored(bins.withColumn("block", F.shiftright("bin_id", BLOCK_BITS)))
    blocks = d.groupBy("block").agg(*[F.sum(n).alias(n) for n in names.values()])
    upto = lambda n, over: F.coalesce(F.sum(n).over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("block", *[upto(n, W.orderBy("block")).alias(f"block_{n}") for n in names.values()])  # a row for 2^23 rows
    inside = d.select("block", "bin_id", *[upto(n, W.partitionBy("block").orderBy("bin_id")).alias(n) for n in names.values()])
    out = inside.join(blocks, "block").crossJoin(F.broadcast(c))  # one row
    return out.select("bin_id", *[(F.col(f"start_{n}") + F.col(f"block_{n}") + F.col(n)).cast("long").alias(f"base_{n}") for n in names.values()])


def lf_mapping(index: DataFrame) -> DataFrame:
    """(row, sym, lf): the row of the rotation that starts one symbol earlier.

    Rows are gathered into bins, whose bases say how many rows of each symbol lie before; a bin's rows are counted inside it.
    """
    from readloom.operators import bins  # which stands on this module

    return bins.every_lf(bins.text_bins(index))


def occurrences(index: DataFrame, points: DataFrame) -> DataFrame:
    """``points`` (sym, row) with occ = C[sym] + occurrences of sym above row: bins first, then the rows of one bin."""
    bins = fm_bins(index)
    pick = F.lit(None).cast("long")
    for s in SYMBOLS:
        pick = F.when(F.col("sym") == s, F.col(f"base_{'end' if s == '$' else s.lower()}")).otherwise(pick)
    p = points.withColumn("bin_id", F.shiftright("row", BIN_BITS))
    rows = index.select(F.shiftright("row", BIN_BITS).alias("bin_id"), F.col("row").alias("r"), F.col("sym").alias("s"))
    inside = p.join(rows, "bin_id").filter("r < row and s = sym").groupBy("sym", "row").agg(F.count(F.lit(1)).alias("more"))
    last = bins.agg(F.max("bin_id").alias("__last"))
    d = p.crossJoin(F.broadcast(last)).withColumn("bin_id", F.least("bin_id", "__last")).drop("__last").join(bins, "bin_id")
    return d.join(inside, ["sym", "row"], "left").select("sym", "row", (pick + F.coalesce("more", F.lit(0))).alias("occ"))


def fm_vectors(index: DataFrame) -> DataFrame:
    """(row, fm_end, fm_a, fm_c, fm_g, fm_n, fm_t): C + occurrences above the row, for every row and symbol.

    The bases of bins give what lies before a bin; its rows are counted inside it.
    """
    from readloom.operators import bins  # which stands on this module

    return bins.every_fm(bins.text_bins(index))


def lcp(index: DataFrame, reads: DataFrame, cap: int = 255) -> DataFrame:
    """(row, lcp): the common prefix of each row's rotation and the next, at most ``cap``; equal rotations give ``cap``, the last row 0.

    Rows are dealt by blocks; the first row of each block is also handed to the block before. Suffixes that differ settle
    their rows, as ``$`` ends them; only rows with the suffix of the next go on with their reads from the start.
    """
    d = index.select("row", "suffix", "read_rank", F.shiftright("row", 12).alias("block"), F.lit(True).alias("own"))
    edge = d.filter(F.col("row") % (1 << 12) == 0).filter("row > 0").withColumn("block", F.col("block") - 1).withColumn("own", F.lit(False))
    over = W.partitionBy("block").orderBy("row")
    both = d.unionByName(edge).withColumn("after", F.lead("suffix").over(over)).withColumn("next_rank", F.lead("read_rank").over(over)).filter("own")
    tied = (F.col("suffix") == F.col("after")) & (F.length("suffix") < cap)
    n = F.when(F.col("after").isNull(), F.lit(0)).otherwise(common_prefix(F.col("suffix"), F.col("after"), cap))
    both = stored(both.select("row", n.alias("n"), F.coalesce(tied, F.lit(False)).alias("tied"), "read_rank", "next_rank"))
    q = lambda of, name: reads.select(F.col("read_rank").alias(of), F.concat("seq", F.lit("$")).alias(name))
    more = both.filter("tied").join(q("read_rank", "a"), "read_rank").join(q("next_rank", "b"), "next_rank")
    more = more.select("row", F.when(F.col("a") == F.col("b"), F.lit(cap)).otherwise(F.least(F.lit(cap), F.col("n") + common_prefix(F.col("a"), F.col("b"), cap))).alias("lcp"))
    return both.filter("not tied").select("row", F.col("n").alias("lcp")).unionByName(more).select("row", F.col("lcp").cast("int").alias("lcp"))


def lcp_of(reads: DataFrame, cap: int = 255, gone: str | None = None) -> DataFrame:
    """(row, lcp) as :func:`lcp` of the index of ``reads``; without the reads whose column ``gone`` is true, folded as :func:`lcp_without` does.

    Short reads are compared where they are sorted, so no suffix is stored.
    """
    from readloom.operators import packed

    known = packed.measured(reads)
    if packed.fits(known):
        return packed.Sorted(reads, (), lcp=cap, gone=gone, known=known).rows("lcp")
    i = stored(build(reads))
    out = lcp(i, reads, cap)
    return out if gone is None else lcp_without(out, i.join(reads.filter(gone).select("read_rank"), "read_rank", "left_semi").select("row"))


def rows_left(reads: DataFrame, gone: str, keep: tuple[str, ...]) -> DataFrame:
    """(row, keep) of the index without the reads whose column ``gone`` is true, numbered anew; ``keep``: pos, sym and columns of reads.

    The rows of all reads are sorted; those that go are left out where they are counted.
    """
    from readloom.operators import packed

    known = packed.measured(reads)
    if packed.fits(known):
        return packed.Sorted(reads, keep, gone=gone, known=known).rows(*keep)
    out = reads.filter(gone)
    own = [c for c in keep if c in reads.columns and c != "read_rank"]
    left = remove_reads(reads, out).select("read_rank", *own)
    return remove_rows(build(reads, ("read_rank", "pos", "sym")), out).join(left, "read_rank").select("row", *keep)


def lcp_without(lcps: DataFrame, gone: DataFrame) -> DataFrame:
    """(row, lcp) after the rows ``gone`` (row) were deleted: the least value between neighbours that are left, numbered anew.

    Each row counts the rows left up to it, by blocks; rows of one count lie between the same two, so their least value is one
    aggregation. A row's value is that of its gap, whatever stood in it; the last row's is 0.
    """
    marked = lcps.join(gone.select("row", F.lit(1).alias("__gone")), "row", "left").select("row", "lcp", F.col("__gone").isNull().cast("long").alias("__left"))
    marked = stored(marked)
    seen = before(marked.withColumn("__own", F.col("__left")), "row", ["__left"])
    d = seen.select("lcp", (F.col("__left") + F.col("__own") - 1).alias("row")).filter("row >= 0")
    least = d.groupBy("row").agg(F.min("lcp").alias("lcp"))
    last = marked.agg(F.coalesce(F.sum("__left"), F.lit(0)).alias("__n"))
    return least.crossJoin(F.broadcast(last)).select("row", F.when(F.col("row") == F.col("__n") - 1, 0).otherwise(F.col("lcp")).cast("int").alias("lcp"))  # one row


def symbol_at(index: DataFrame, rows: DataFrame) -> DataFrame:
    """(row, sym) for the rows asked for."""
    return rows.select("row").join(index.select("row", "sym"), "row")


def symbols_between(index: DataFrame, low: int, high: int) -> DataFrame:
    """(row, sym) of rows low to high - 1."""
    return index.filter((F.col("row") >= low) & (F.col("row") < high)).select("row", "sym")


def recover(index: DataFrame, reads: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(row, read_rank, pos, rotation): the whole cyclic string that starts at each row asked for, or at every row."""
    q = reads.select("read_rank", F.concat("seq", F.lit("$")).alias("q"))
    d = index.select("row", "read_rank", "pos")
    d = (d if rows is None else rows.select("row").join(d, "row")).join(q, "read_rank")
    return d.select("row", "read_rank", "pos", F.concat(F.substr("q", F.col("pos") + 1), F.substr("q", F.lit(1), F.col("pos"))).alias("rotation"))


def rotations(reads: DataFrame) -> DataFrame:
    """:func:`recover` of every row of the index of ``reads``. Short reads' strings are their sorted keys, so rows don't meet their reads again."""
    from readloom.operators import packed

    known = packed.measured(reads)
    if packed.fits(known):
        return packed.Rotations(reads, known).rows()
    return recover(build(reads, ("read_rank", "pos")), reads)


def provenance(reads: DataFrame, ranks: DataFrame) -> DataFrame:
    """(read_rank, file_id, seq_id and mates, if known) of the ranks asked for."""
    return ranks.select("read_rank").join(reads.drop("seq"), "read_rank")


def remove_reads(reads: DataFrame, ranks: DataFrame) -> DataFrame:
    """The prepared reads without the ranks given, numbered anew in their old order."""
    left = reads.join(ranks.select("read_rank"), "read_rank", "left_anti").withColumnRenamed("read_rank", "__old")
    return ranked(left, [F.col("__old").asc()], "read_rank").select("read_rank", *[c for c in reads.columns if c != "read_rank"])


def remove_rows(index: DataFrame, ranks: DataFrame) -> DataFrame:
    """The index without the rows of the reads given: what is left keeps its order, so only numbers change."""
    left = index.join(ranks.select("read_rank").distinct(), "read_rank", "left_anti").withColumnRenamed("row", "__old")
    left = ranked(left, [F.col("__old").asc()], "row")
    # the rows of whole reads, in their order, give the new numbers of reads
    reads = ranked(left.filter("pos = 0").select(F.col("read_rank").alias("__rank")), [F.col("__rank").asc()], "__new")
    return left.join(reads, F.col("read_rank") == F.col("__rank")).withColumn("read_rank", F.col("__new")).select(*[c for c in ("row", "read_rank", "pos", "suffix", "sym") if c in index.columns])


def merge_reads(*collections: DataFrame) -> DataFrame:
    """The reads of several collections with source_id 0, 1, ...; ties go to the earlier collection, then to its rank."""
    parts = [c.select(F.lit(i).alias("file_id"), F.col("read_rank").alias("seq_id"), "seq", F.lit(i).alias("source_id")) for i, c in enumerate(collections)]
    d = parts[0]
    for p in parts[1:]:
        d = d.unionByName(p)
    return prepare_reads(d)


def iterate(index: DataFrame):
    """The symbols in row order, one partition at a time."""
    for r in index.select("row", "sym").orderBy("row").toLocalIterator(prefetchPartitions=False):
        yield r["sym"]
