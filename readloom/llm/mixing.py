"""Mixing sources to target weights by entropy balancing.

Per source s the rates w of its documents minimise the relative entropy to one copy each, subject to
``sum(w * size) = target`` and ``w <= most``. The dual is convex in one multiplier a source; its solution is the capped
exponential tilt ``w = min(most, exp(lam * size / mean))``. Newton steps, safeguarded by a bracket, run for all
sources at once over the (source, size) histogram; rates are then rounded to whole copies by a hash of the key, and
what rounding misses is repaired with small documents chosen by hash bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readloom.llm.common import let, lookup, materialize, n_words

MOST = 2.0
TOLERANCE = 1e-4
MAX_STEPS = 60
#: Steps between two looks whether any source is still open.
EVERY = 4
BINS = 1024
#: Rounds of repair; in each, only documents of at most (missing words / divisor) words change.
REPAIRS = (8.0, 8.0, 4.0, 1.0)
WEIGHTS = (3.0, 1.0, 2.0)


def targets(totals: DataFrame, key: str = "source", share: float = 1.5, weights: tuple = WEIGHTS, most: float = MOST) -> DataFrame:
    """Adds ``target`` to one row a source (key, source_size).

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` of all sizes; no target
    passes ``most`` times its source's size: the excess goes to the others by weight (water filling).
    """
    whole = W.partitionBy()
    d = totals.withColumn("__i", F.row_number().over(W.orderBy(F.col(key).asc_nulls_last())) - 1)
    d = d.withColumn("__w", F.get(F.array(*[F.lit(float(x)) for x in weights]), F.col("__i") % len(weights)))
    d = d.withColumn("__cap", F.col("source_size") * F.lit(most)).withColumn("__r", F.col("__cap") / F.col("__w"))
    before = W.orderBy("__r", "__i").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("__level", (F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / (F.sum("__w").over(whole) - F.coalesce(F.sum("__w").over(before), F.lit(0.0))))
    d = d.withColumn("__t", F.min_by(F.when(F.col("__level") <= F.col("__r"), F.col("__level")), F.when(F.col("__level") <= F.col("__r"), F.col("__r"))).over(whole))
    return d.withColumn("target", F.least(F.col("__cap"), F.coalesce(F.col("__t"), F.lit(float("inf"))) * F.col("__w"))).drop("__i", "__w", "__cap", "__r", "__level", "__t")


def _rate(size: Column, most: float, p: str = "") -> Column:
    """The capped tilt; lam is +infinity for a source that must be repeated ``most`` times, -infinity for one with no target."""
    lam, top = F.col(p + "lam"), F.lit(most)
    x = lam * size / F.col(p + "mean")
    return F.when((size <= 0) | lam.isNull(), F.lit(1.0)).when(lam == float("inf"), top).when(lam == float("-inf"), F.lit(0.0)).otherwise(F.least(top, F.exp(F.least(x, F.lit(50.0)))))


def _uniform(key: Column, salt: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(salt)), 11).cast("double") / float(1 << 53)


def _newton(hist: DataFrame, goal: DataFrame, key: str, most: float, n_sources: int) -> DataFrame:
    """``goal`` (key, source_size, target, mean, least, largest) with the multiplier lam of every source."""
    full = F.col("target") >= F.col("source_size") * F.lit(most) * (1 - 1e-12)
    state = goal.withColumn("lam", F.when(F.col("source_size") <= 0, F.lit(0.0)).when(F.col("target") <= 0, F.lit(float("-inf"))).when(full, F.lit(float("inf"))).otherwise(F.lit(0.0)))
    tilt = F.col("mean") / F.col("least")
    state = (
        state.withColumn("lo", F.least(F.lit(0.0), F.log(F.col("target") / F.col("source_size")) * tilt))
        .withColumn("hi", F.log(F.lit(most)) * tilt * 1.000001)
        .withColumn("open", (F.col("source_size") > 0) & (F.col("target") > 0) & ~full)
    )
    state = materialize(state)
    for i in range(MAX_STEPS):
        if i % EVERY == 0 and state.filter("open").isEmpty():
            break
        now = state.filter("open").select(key, "lam", "mean")
        at = lookup(hist, now, key, "inner", n_sources)
        w = _rate(F.col("size"), most)
        words = F.col("n") * F.col("size") * w
        sums = at.groupBy(F.col(key).alias("__k")).agg(F.sum(words).alias("__f"), F.sum(F.when(w < most, words * F.col("size") / F.col("mean")).otherwise(0.0)).alias("__h"))
        d = state.join(sums, F.col(key).eqNullSafe(F.col("__k")), "left").drop("__k")
        live = F.col("open") & F.col("__f").isNotNull()
        low = F.col("__f") < F.col("target")
        d = d.withColumn("lo", F.when(live & low, F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(live & ~low, F.col("lam")).otherwise(F.col("hi")))
        near = F.abs(F.col("__f") - F.col("target")) <= TOLERANCE * F.col("target")
        step = F.col("lam") + (F.col("target") - F.col("__f")) / F.col("__h")
        inside = (F.col("__h") > 0) & (step > F.col("lo")) & (step < F.col("hi"))
        to = F.when(inside, F.when(F.col("__h") > 0, step)).otherwise((F.col("lo") + F.col("hi")) / 2)
        d = d.withColumn("open", live & ~near & (F.col("hi") - F.col("lo") > 1e-12)).withColumn("lam", F.when(F.col("open"), to).otherwise(F.col("lam")))
        state = materialize(d.drop("__f", "__h"))
    else:
        if not state.filter("open").isEmpty():
            raise RuntimeError(f"the mix is not settled after {MAX_STEPS} steps")
    return state.drop("lo", "hi", "open")


def _copies(size: Column, ident: Column, most: float, p: str = "") -> Column:
    """Whole copies of a row from its source's lam and repairs."""

    def repaired(row: Column) -> Column:
        rate, whole = row["rate"], F.floor(row["rate"])

        def one(up: Column, fix: Column) -> Column:
            fits = (size > 0) & (size <= fix["fits"]) & (row["at"] < fix["bins"])
            more = fits & (fix["sign"] > 0) & (up == whole) & (up + 1 <= most)
            less = fits & (fix["sign"] < 0) & (up > whole)
            return up + F.when(more, 1).when(less, -1).otherwise(0).cast("long")

        first = (whole + (row["u"] < rate - whole).cast("long")).cast("long")
        return F.aggregate(p + "repairs", first, one)

    at = F.floor(_uniform(ident, 2) * BINS).cast("int")
    return let(F.struct(_rate(size, most, p).alias("rate"), _uniform(ident, 1).alias("u"), at.alias("at")), repaired)


def solve(docs: DataFrame, text: str = "text", key: str = "source", ident: str = "doc_id", share: float = 1.5, weights: tuple = WEIGHTS, most: float = MOST) -> DataFrame:
    """One row a source: source_size, target, lam, mean and repairs, all that :func:`apply` needs."""
    sized = materialize(docs.select(F.col(key), F.col(ident).alias("ident"), n_words(F.col(text)).alias("size")))
    hist = materialize(sized.groupBy(key, "size").agg(F.count(F.lit(1)).alias("n")))
    totals = hist.groupBy(key).agg(
        F.sum(F.col("n") * F.col("size")).cast("long").alias("source_size"),
        (F.sum(F.col("n") * F.col("size")) / F.greatest(F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)), F.lit(1))).alias("mean"),
        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"),
    )
    goal = materialize(targets(totals, key, share, weights, most))
    n_sources = goal.count()
    state = _newton(hist.filter("size > 0"), goal, key, most, n_sources).withColumn("repairs", F.array().cast("array<struct<sign:int,fits:double,bins:int>>"))
    for part in REPAIRS:
        state = materialize(state)
        base = lookup(sized, state.select(key, "source_size", "target", "lam", "mean", "repairs"), key, "inner", n_sources)
        base = base.withColumn("copies", _copies(F.col("size"), F.col("ident"), most)).withColumn("rate", _rate(F.col("size"), most))
        taken = base.groupBy(F.col(key).alias("__k")).agg(F.sum(F.col("copies") * F.col("size")).alias("taken"))
        gap = state.select(key, "target").join(taken, F.col(key).eqNullSafe(F.col("__k")), "left").select(key, (F.col("target") - F.coalesce("taken", F.lit(0))).alias("gap"))
        gap = materialize(gap)
        near = lookup(base, gap, key, "inner", n_sources)
        more = (F.col("gap") > 0) & (F.col("copies") == F.floor("rate")) & (F.col("copies") + 1 <= most)
        less = (F.col("gap") < 0) & (F.col("copies") > F.floor("rate"))
        near = near.filter((F.col("size") > 0) & (F.col("size") <= F.abs("gap") / part) & (more | less))
        bins = near.groupBy(key, "gap", F.floor(_uniform(F.col("ident"), 2) * BINS).cast("int").alias("bin")).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(W.partitionBy(key).orderBy("bin"))
        cut = bins.withColumn("upto", upto).filter(F.col("upto") <= F.abs("gap") + F.col("words") / 2).groupBy(F.col(key).alias("__k")).agg((F.max("bin") + 1).alias("bins"), F.first("gap").alias("gap"))
        fix = F.struct(
            F.when(F.col("gap") > 0, 1).when(F.col("gap") < 0, -1).otherwise(0).cast("int").alias("sign"),
            F.coalesce(F.abs("gap") / part, F.lit(0.0)).alias("fits"),
            F.coalesce("bins", F.lit(0)).cast("int").alias("bins"),
        )
        state = state.join(cut, F.col(key).eqNullSafe(F.col("__k")), "left").withColumn("repairs", F.concat("repairs", F.array(fix))).drop("__k", "gap", "bins")
    return materialize(state.select(key, "source_size", "target", "lam", "mean", "repairs"))


def apply(docs: DataFrame, state: DataFrame, text: str = "text", key: str = "source", ident: str = "doc_id", most: float = MOST) -> DataFrame:
    """Every row of ``docs`` with mix_size, mix_source_size, mix_target, mix_rate and mix_copies."""
    renamed = state.select(F.col(key).alias("__source"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), *[F.col(c).alias(f"__{c}") for c in ("lam", "mean", "repairs")])
    d = docs.withColumn("__source", F.col(key)).withColumn("mix_size", n_words(F.col(text)))
    d = lookup(d, renamed, "__source").withColumn("mix_rate", _rate(F.col("mix_size"), most, "__"))
    return d.withColumn("mix_copies", _copies(F.col("mix_size"), F.col(ident), most, "__")).drop("__source", "__lam", "__mean", "__repairs")


def mix(docs: DataFrame, text: str = "text", key: str = "source", ident: str = "doc_id", share: float = 1.5, weights: tuple = WEIGHTS, most: float = MOST) -> DataFrame:
    """Every row of ``docs`` with its copies in the mix (see :func:`apply`).

    A null text has size 0 and takes no words; null sources are one source, the last; repeated rows (one ``ident``)
    are taken alike; a column of ``docs`` named mix_* is replaced. An empty table gives an empty table.
    """
    docs = docs.drop("mix_size", "mix_source_size", "mix_target", "mix_rate", "mix_copies")
    slim = docs.select(F.col(text), F.col(key), F.col(ident))
    return apply(docs, solve(slim, text, key, ident, share, weights, most), text, key, ident, most)


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as it has copies."""
    return mixed.filter("mix_copies > 0").withColumn("__c", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies")))).drop("__c", "mix_size", "mix_source_size", "mix_target", "mix_rate", "mix_copies")
