"""Quality rules: base counts, and the Jensen-Shannon distance of a document's histograms to its language's reference.

All DataFrame expressions; one pass over the texts, then a few numbers a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import let, lookup, materialize, words_of

#: Frequent words of each language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on", "with", "as", "be", "at"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "au"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una"],
}
SLOTS = 16
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Documents with fewer words than this are not judged by their histograms.
GUARD_WORDS = 50
#: A histogram is too far from its reference beyond LIMIT + SLACK / sqrt(number of words).
CLASS_LIMIT, CLASS_SLACK = 0.16, 1.2
WORD_LIMIT, WORD_SLACK = 0.06, 2.6


def _repeat_words(hashes: Column) -> Column:
    """Words that lie in a 3-word window found twice or more; ``hashes``: one 64-bit hash a word."""

    def windows(h: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(h) - 3),
            lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)),
        )

    def covered(at: Column) -> Column:
        """Size of the union of [p, p + 2] over sorted positions."""
        step = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))).cast("long"))
        return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

    def packed(w: Column) -> Column:
        """44 bits of hash above 20 bits of position sort as plain longs; the whole hash is compared afterwards."""
        keys = F.sort_array(F.transform(w, lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 20), 20).bitwiseOR(i.cast("long"))))
        place = lambda s: s.bitwiseAND(F.lit((1 << 20) - 1)).cast("int")
        same = lambda s, t: (F.shiftrightunsigned(s, 20) == F.shiftrightunsigned(t, 20)) & (F.get(w, place(s)) == F.get(w, place(t)))
        return let(
            keys,
            lambda k: F.sort_array(
                F.transform(
                    F.filter(k, lambda s, i: F.coalesce(same(s, F.get(k, i - 1)), F.lit(False)) | F.coalesce(same(s, F.get(k, i + 1)), F.lit(False))),
                    place,
                )
            ),
        )

    def paired(w: Column) -> Column:
        """The same for texts of more than a million words."""
        keys = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(
            keys,
            lambda k: F.sort_array(
                F.transform(
                    F.filter(k, lambda s, i: F.coalesce(s["h"] == F.get(k, i - 1)["h"], F.lit(False)) | F.coalesce(s["h"] == F.get(k, i + 1)["h"], F.lit(False))),
                    lambda s: s["i"],
                )
            ),
        )

    def counted(w: Column) -> Column:
        several = F.when(F.size(w) < (1 << 20), packed(w)).otherwise(paired(w))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(let(several, covered))

    return let(hashes, lambda h: F.when(F.size(h) < 3, F.lit(0).cast("long")).otherwise(let(windows(h), counted)))


def _histogram(words: Column, listed: list[str]) -> Column:
    """How often each listed word is among ``words``."""

    def times(found: Column, word: str) -> Column:
        return F.size(F.filter(found, lambda x: x == word)).cast("long")

    return let(F.filter(words, lambda x: x.isin(listed)), lambda found: F.array(*[times(found, y) for y in listed]))


def _left(text: Column, kept: str) -> Column:
    """Code points of ``text`` that match the character class ``kept``."""
    return F.length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("long")


def features(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Base counts, character-class counts and common-word counts of every document.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, classes (array of 6 counts: upper
    case, digits, blanks, marks, symbols, all else) and common (array of 17 counts: the language's words, all other
    words; null for a language without a list) and drops the text.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn("__t", t).withColumn("__w", words_of(t))
    lines = F.filter(F.split(F.col("__t"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    hits = F.lit(None).cast("array<long>")
    for name, listed in COMMON_WORDS.items():
        hits = F.when(F.col(lang) == name, _histogram(F.col("__w"), listed)).otherwise(hits)
    d = (
        d.withColumn("n_words", F.size("__w").cast("long"))
        .withColumn("__n", F.length("__t").cast("long"))
        .withColumn("__r", F.regexp_replace("__t", r"[^\p{Lu}0-9\x20\x09-\x0D.,;:!?\"'()#*$%&|<>]+", ""))
        .withColumn("__blank", _left(F.col("__r"), r"\x20\x09-\x0D"))
        .withColumn("n_symbols", _left(F.col("__r"), r"#*$%&|<>"))
        .withColumn("n_dup_lines", let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")))
        .withColumn("n_repeat_words", _repeat_words(F.transform("__w", lambda x: F.xxhash64(x))))
        .withColumn("__upper", _left(F.col("__r"), r"\p{Lu}"))
        .withColumn("__digit", _left(F.col("__r"), r"0-9"))
        .withColumn("__mark", _left(F.col("__r"), r".,;:!?\"'()"))
        .withColumn("__hits", hits)
    )
    some = [F.col(c) for c in ("__upper", "__digit", "__blank", "__mark", "n_symbols")]
    rest = F.col("__n")
    for c in some:
        rest = rest - c
    seen = F.aggregate("__hits", F.lit(0).cast("long"), lambda a, x: a + x)
    return (
        d.withColumn("word_chars", F.col("__n") - F.col("__blank"))
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
        .withColumn("classes", F.array(*some, rest))
        .withColumn("common", F.when(F.col("__hits").isNotNull(), F.concat("__hits", F.array(F.greatest(F.lit(0).cast("long"), F.col("n_words") - seen)))))
        .drop(text, "__t", "__w", "__n", "__r", "__blank", "__upper", "__digit", "__mark", "__hits")
    )


def references(feats: DataFrame, lang: str = "lang") -> DataFrame:
    """One row a language: summed histograms of all its documents that pass the base rules; null for empty sums."""
    good = feats.filter(~F.col("base_failed"))
    total = lambda c, i: F.coalesce(F.sum(F.get(F.col(c), F.lit(i))), F.lit(0)).cast("long")
    return good.groupBy(F.col(lang).alias(lang)).agg(
        F.array(*[total("classes", i) for i in range(6)]).alias("ref_classes"),
        F.array(*[total("common", i) for i in range(SLOTS + 1)]).alias("ref_common"),
    )


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two count histograms; null if either is null or empty."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x).cast("double")

    def term(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    def body(n: Column, m: Column) -> Column:
        parts = F.zip_with(p, q, lambda a, b: let(F.struct((a / n).alias("a"), (b / m).alias("b")), lambda s: (term(s["a"], (s["a"] + s["b"]) / 2) + term(s["b"], (s["a"] + s["b"]) / 2)) / 2))
        return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)))

    return F.when((total(p) > 0) & (total(q) > 0), let(F.struct(total(p).alias("n"), total(q).alias("m")), lambda s: body(s["n"], s["m"])))


_OWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "classes", "common", "ref_classes", "ref_common", "class_distance", "word_distance", "kept")


def judge(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Every row of ``docs`` without its text, with base counts, class_distance, word_distance and kept.

    Null texts are empty and fail the base rules. A document of a null or unlisted language is compared by character
    classes only, with the reference of the rows of that same language value. Documents under GUARD_WORDS words, and
    those whose reference is empty, are not judged by distance. Repeated rows are judged each by itself. Columns of ``docs`` named like the results
    are replaced.
    """
    feats = materialize(features(docs.drop(*_OWN), text, lang))
    refs = materialize(references(feats, lang))
    d = lookup(feats, refs, lang)
    d = d.withColumn("class_distance", js_distance(F.col("classes"), F.col("ref_classes")))
    d = d.withColumn("word_distance", js_distance(F.col("common"), F.col("ref_common")))
    root = F.sqrt(F.greatest(F.col("n_words"), F.lit(1)).cast("double"))
    far = lambda c, limit, slack: F.coalesce(F.col(c) > limit + slack / root, F.lit(False))
    off = (F.col("n_words") >= GUARD_WORDS) & (far("class_distance", CLASS_LIMIT, CLASS_SLACK) | far("word_distance", WORD_LIMIT, WORD_SLACK))
    return d.withColumn("kept", ~F.col("base_failed") & ~off).drop("classes", "common", "ref_classes", "ref_common")
