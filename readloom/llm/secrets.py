"""Secret scanning with a random forest against false positives.

Patterns find candidates; the forest, trained from labelled findings, judges each by its length, character transitions,
dictionary coverage, path and neighbouring words. Patterns, features, training and scoring are DataFrame operations.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What a candidate looks like. The first group is the candidate and ends the match. Runs are possessive and have no upper bound.
PATTERNS = {
    "access_key": r"(?<![A-Za-z0-9])((?:AKIA|ASIA)[0-9A-Z]{16})(?![A-Za-z0-9])",
    "private_key": r"(-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----)",
    "prefixed": r"(?<![A-Za-z0-9_])((?:ghp_|gho_|sk-|xox[bp]-|glpat-)[A-Za-z0-9_\-]{16,}+)",
    "assigned": r"(?i:password|passwd|pwd|secret|token|api_?key|access_?key|credential)[\"']?[ \t]{0,3}[=:][ \t]{0,3}[\"']?([A-Za-z0-9+/_\-.$@!]{8,}+)",
    "long_token": r"(?<![A-Za-z0-9+/_\-])((?=[A-Za-z+/_\-]*+[0-9])[A-Za-z0-9+/_\-]{32,}+)",
}
#: Words whose presence speaks for or against a secret.
FOR_WORDS = ("password", "passwd", "pwd", "secret", "token", "key", "credential", "auth", "bearer")
AGAINST_WORDS = ("example", "sample", "test", "dummy", "placeholder", "changeme", "your", "fake", "xxxx", "sha256", "commit", "checksum", "uuid")
DICTIONARY = ("about", "access", "admin", "after", "again", "always", "change", "client", "config", "data", "default", "demo", "description", "dummy", "enter", "example", "fake", "file", "from", "generated", "hello", "here", "home", "insert", "local", "login", "long", "master", "name", "null", "number", "password", "path", "placeholder", "private", "public", "random", "replace", "sample", "secret", "server", "service", "some", "string", "system", "temp", "test", "this", "token", "user", "value", "version", "with", "word", "your")
CONTEXT = 40
#: Labelled findings that a forest is fitted on, at most; trees and their depth.
MAX_LABELLED = 20_000
TREES, DEPTH = 24, 7
FEATURES = ("length", "digits", "uppers", "transitions", "distinct", "hexadecimal", "coverage", "path", "for_words", "against_words", "formatted")


def candidates(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(ident, kind, secret, start, n, before, after): each occurrence of a candidate with its place, its count in the text, and
    the CONTEXT characters on both sides of it.

    A text is cut at the ends of its matches. Each cut is a row with its length and its first and last characters, so places
    and contexts are running values over a text's rows, and the work is linear in text and candidates.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    cut = lambda part, secret: F.struct(secret.alias("secret"), F.length(part).alias("size"), F.substring(part, 1, CONTEXT).alias("head"), F.substring(part, -CONTEXT, CONTEXT).alias("tail"), F.substring(F.substr(part, F.lit(1), F.length(part) - F.length(secret)), -CONTEXT, CONTEXT).alias("gap"))

    def of(kind: str, pattern: str) -> Column:
        found = F.regexp_extract_all(t, F.lit(pattern), F.lit(1))
        # the text up to the end of each match, from the end of the match before; and what is behind the last one
        parts = F.regexp_extract_all(t, F.lit(rf"\G(?s:.*?)(?:{pattern})"), F.lit(0))
        rest = F.substr(t, F.aggregate(parts, F.lit(1), lambda n, p: n + F.length(p)), F.lit(CONTEXT))
        rows = F.concat(F.transform(F.arrays_zip(parts.alias("part"), found.alias("secret")), lambda x: cut(x["part"], x["secret"])), F.array(cut(rest, F.lit(None).cast("string"))))
        return F.struct(F.lit(kind).alias("kind"), F.when(F.size(found) > 0, rows).alias("rows"))

    d = docs.select(F.col(ident).alias("ident"), F.monotonically_increasing_id().alias("__row"), F.explode(F.array(*[of(k, p) for k, p in PATTERNS.items()])).alias("of"))
    d = d.select("ident", "__row", "of.kind", F.posexplode("of.rows").alias("i", "x")).select("ident", "__row", "kind", "i", "x.*")
    over = W.partitionBy("__row", "kind").orderBy("i")
    # a match has 8 characters and more, so the contexts lie in so many neighbours
    near = range(1, -(-CONTEXT // 8) + 1)
    before = F.concat(*[F.coalesce(F.lag("tail", k).over(over), F.lit("")) for k in reversed(near)], F.coalesce("gap", F.lit("")))
    after = F.concat(*[F.coalesce(F.lead("head", k).over(over), F.lit("")) for k in near])
    ends = F.sum("size").over(over.rowsBetween(W.unboundedPreceding, 0))
    d = d.withColumn("before", F.substring(before, -CONTEXT, CONTEXT)).withColumn("after", F.substring(after, 1, CONTEXT)).withColumn("start", ends - F.length("secret")).filter("secret is not null")
    n = F.count(F.lit(1)).over(W.partitionBy("__row", "kind", "secret"))
    return d.select("ident", "kind", "secret", F.col("start").cast("long").alias("start"), n.alias("n"), "before", "after")


def _share(value: Column, kept: str) -> Column:
    return F.length(F.regexp_replace(value, f"[^{kept}]", "")) / F.greatest(F.length(value), F.lit(1))


def with_features(found: DataFrame) -> DataFrame:
    """Adds the columns FEATURES to (kind, secret, before, after); the words counted are on both sides of the candidate."""
    s, near = F.col("secret"), F.lower(F.concat_ws(" ", F.col("before"), F.col("secret"), F.col("after")))
    turns = F.lit(0)
    for kind in ("a-z", "A-Z", "0-9"):
        inside, outside = f"[{kind}]", f"[^{kind}]"
        turns = turns + F.size(F.regexp_extract_all(s, F.lit(f"{outside}(?={inside})"), F.lit(0)))
    words = "|".join(sorted(DICTIONARY, key=len, reverse=True))
    listed = lambda xs: sum((F.contains(near, F.lit(x)).cast("double") for x in xs), F.lit(0.0))
    return (
        found.withColumn("length", F.length(s).cast("double"))
        .withColumn("digits", _share(s, "0-9"))
        .withColumn("uppers", _share(s, "A-Z"))
        .withColumn("transitions", turns / F.greatest(F.length(s), F.lit(1)))
        .withColumn("distinct", F.size(F.array_distinct(F.split(s, ""))) / F.greatest(F.length(s), F.lit(1)))
        .withColumn("hexadecimal", F.rlike(s, F.lit("^[0-9a-f]+$")).cast("double"))
        .withColumn("coverage", 1 - F.length(F.regexp_replace(F.lower(s), words, "")) / F.greatest(F.length(s), F.lit(1)))
        .withColumn("path", F.rlike(F.concat(F.col("before"), s), F.lit(r"https?://\S*$|[/\\][\w.\-]+[/\\]")).cast("double"))
        .withColumn("for_words", listed(FOR_WORDS))
        .withColumn("against_words", listed(AGAINST_WORDS))
        .withColumn("formatted", F.col("kind").isin("access_key", "private_key", "prefixed").cast("double"))
    )


def labelled_findings(spark: SparkSession, n: int = 4000) -> DataFrame:
    """A labelled set made by rule: (kind, secret, before, after, label). Random strings in credential positions are secrets;
    words, placeholders, repetitions, paths, checksums and identifiers are not."""
    random = lambda salt: F.sha2(F.concat_ws("-", F.lit(salt), F.col("id").cast("string")), 512)
    base64ish = F.translate(F.base64(F.unhex(random("b"))), "=", "")
    word = lambda salt: F.get(F.array(*[F.lit(w) for w in DICTIONARY]), F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(DICTIONARY))).cast("int"))
    size = lambda low, high: (F.pmod(F.xxhash64("id", F.lit("size")), F.lit(high - low + 1)) + low).cast("int")
    cut = lambda c, low, high: F.substring(c, F.lit(1), size(low, high))
    said = lambda *xs: F.concat_ws(" ", word("p"), word("q"), F.get(F.array(*[F.lit(x) for x in xs]), F.pmod(F.xxhash64("id", F.lit("k")), F.lit(len(xs))).cast("int")))
    rows = [
        ("assigned", cut(random("h"), 16, 64), said('token = "', "password=", "secret: ", "api_key="), 1),
        ("assigned", cut(base64ish, 16, 64), said('token = "', "password=", "secret: ", "access_key: "), 1),
        ("assigned", F.concat(cut(F.translate(base64ish, "+/", "$@"), 9, 14), F.lit("!7")), said("password=", "pwd: ", "passwd="), 1),
        ("access_key", F.concat(F.lit("AKIA"), F.substring(F.upper(F.translate(base64ish, "+/", "ZQ")), 1, 16)), said("", "key ", "found "), 1),
        ("prefixed", F.concat(F.lit("ghp_"), F.substring(F.translate(base64ish, "+/", "aZ"), 1, 36)), said("", "auth ", "export "), 1),
        ("long_token", cut(F.translate(base64ish, "+/", "aZ"), 32, 80), said("bearer ", "auth: ", "credential "), 1),
        ("private_key", F.lit("-----BEGIN RSA PRIVATE KEY-----"), said("", "key "), 1),
        ("assigned", F.concat_ws("_", word("a"), word("b"), word("c")), said("password=", 'token = "', "secret: "), 0),
        ("assigned", F.concat(F.lit("your_"), word("a"), F.lit("_here")), said("password=", "api_key=", "token: "), 0),
        ("assigned", F.concat(word("a"), F.lit("123456")), said("example password=", "test token=", "dummy secret="), 0),
        ("assigned", F.repeat(F.substring(random("r"), 1, 1), 16), said("password=", "token: "), 0),
        ("long_token", F.concat_ws("/", word("a"), word("b"), word("c"), F.concat(word("d"), F.lit("2")), word("e"), word("f")), said("file /home/user/", "https://host/a/"), 0),
        ("long_token", F.substring(random("s"), 1, 64), said("sha256 checksum ", "commit ", "sha256: "), 0),
        ("long_token", F.concat_ws("-", word("a"), word("b"), word("c"), word("d"), word("e"), F.lit("2024")), said("see ", "page "), 0),
        ("long_token", F.concat_ws("-", F.substring(random("u"), 1, 8), F.substring(random("u"), 9, 4), F.substring(random("u"), 13, 4), F.substring(random("u"), 17, 4), F.substring(random("u"), 21, 12)), said("uuid ", "id "), 0),
        ("prefixed", F.concat(F.lit("sk-"), F.repeat(F.lit("xxxx"), 6)), said("example ", "placeholder "), 0),
    ]
    # what follows: the end of the line or other words; behind false findings also words that say so
    behind = {1: ("\n", "\" ", "; ", ", "), 0: ("\n", "\" ", " # example", " (sample value)", " placeholder")}
    after = lambda y: F.concat(F.get(F.array(*[F.lit(x) for x in behind[y]]), F.pmod(F.xxhash64("id", F.lit("a")), F.lit(len(behind[y]))).cast("int")), F.lit(" "), word("n"), F.lit(" "), word("m"))
    made = F.array(*[F.struct(F.lit(k).alias("kind"), s.alias("secret"), b.alias("before"), after(y).alias("after"), F.lit(float(y)).alias("label")) for k, s, b, y in rows])
    return spark.range(n // len(rows)).select(F.explode(made).alias("x")).select("x.*")


def train(labelled: DataFrame, limit: int = MAX_LABELLED) -> RandomForestClassificationModel:
    """A forest fitted on (kind, secret, before, after, label); of more than ``limit`` rows, a hash of the finding keeps about so many."""
    n = labelled.count()
    if n > limit:
        labelled = labelled.filter(F.pmod(F.xxhash64("secret", "before"), F.lit(1_000_003)) < int(1_000_003 * limit / n))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_features(labelled))
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=3, featuresCol="features", labelCol="label").fit(rows.select("features", "label").coalesce(1))


def scan(docs: DataFrame, model: RandomForestClassificationModel, text: str = "text", ident: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """(ident, kind, secret, start, n, probability, is_secret), one row for each occurrence of a candidate of a pattern.

    Each occurrence has the probability of its own context. A string is a secret in all its places in the texts of an id
    if it is one in any. Null and empty texts have no findings; repeated rows repeat theirs. ``start`` counts code points from 0.
    """
    rows = with_features(candidates(docs, text, ident))
    judged = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows))
    p = vector_to_array(F.col("probability"))[1]
    out = judged.select(F.col("ident").alias(ident), "kind", "secret", "start", "n", p.alias("probability"))
    return out.withColumn("is_secret", F.max("probability").over(W.partitionBy(ident, "secret")) >= threshold)
