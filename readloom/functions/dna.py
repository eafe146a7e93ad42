"""Column functions over strings of the alphabet ``$ACGNT`` (which is its byte order)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the alphabet, in order; ``$`` ends a read.
ALPHABET = "$ACGNT"
SYMBOLS = tuple(ALPHABET)


def clean(text: Column) -> Column:
    """The letters ACGNT of a text, lower case counted as upper."""
    return F.regexp_replace(F.translate(text, "acgnt", "ACGNT"), "[^ACGNT]", "")


def reverse_complement(seq: Column) -> Column:
    """Reverse complement; N, ``$`` and wildcards map to themselves."""
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def is_valid(kmer: Column) -> Column:
    return F.coalesce(F.rlike(kmer, F.lit(r"^[$ACGNT]*$")), F.lit(False))


def checked(kmer: Column, what: str = "k-mer") -> Column:
    """``kmer``, without a carriage return at its end; an error if a symbol is outside the alphabet."""
    bare = F.regexp_replace(kmer, r"\r$", "")
    return F.when(F.assert_true(is_valid(bare), F.concat(F.lit(f"{what} outside $ACGNT: "), F.coalesce(bare, F.lit("null")))).isNull(), bare)


def code(symbol: Column) -> Column:
    """0 to 5."""
    return (F.instr(F.lit(ALPHABET), symbol) - 1).cast("int")


def windows(seq: Column, k) -> Column:
    """Array of all length-``k`` substrings; empty if the string is shorter."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.when(F.length(seq) >= k, F.transform(F.sequence(F.lit(1), F.length(seq) - k + 1), lambda i: F.substr(seq, i, k))).otherwise(F.array().cast("array<string>"))


def common_prefix(a: Column, b: Column, cap: int) -> Column:
    """Length of the common prefix, at most ``cap``, found by comparing parts of 2^i letters, the longest first."""
    n = F.least(F.length(a), F.length(b), F.lit(cap))
    parts = F.array(*[F.lit(1 << i) for i in reversed(range(max(cap, 1).bit_length()))])
    same = lambda at, part: (at + part <= n) & (F.substr(a, at + 1, part) == F.substr(b, at + 1, part))
    return F.aggregate(parts, F.lit(0), lambda at, part: at + F.when(same(at, part), part).otherwise(0)).cast("int")


def wildcard_regex(pattern: str) -> str:
    """``?`` is one letter, ``*`` any number of letters; anchored at the start."""
    return "^" + "".join({"?": "[ACGNT]", "*": "[ACGNT]*", "$": r"\$"}.get(c, c) for c in pattern)
