"""Scalar functions on tokens, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of numbers and of punctuation by language prefix
NUMBER = r"\A(?:[0-9]+|[0-9]+\.[0-9]+|[0-9]+[0-9,]+)\z"
PUNCTUATION = {"german": r"\A\$.*\z", "swedish": r"\AI[^DM]\z", "": r"\A[.,!?:;]+\z"}
#: The universal tags
UNIVERSAL_TAGS = ("NOUN", "VERB", "ADJ", "ADV", "PRON", "DET", "ADP", "NUM", "CONJ", "PRT", ".", "X")


def trim_all(c: Column) -> Column:
    """Without leading and trailing characters up to U+0020."""
    return F.regexp_replace(F.regexp_replace(c, r"\A[\x00-\x20]+", ""), r"[\x00-\x20]+\z", "")


def fields(c: Column, separator: str = "\t") -> Column:
    """Fields of the trimmed line; trailing empty ones are dropped."""
    return F.split(F.regexp_replace(trim_all(c), f"{separator}+\\z", ""), separator)


def is_numerical(c: Column) -> Column:
    return trim_all(c).rlike(NUMBER)


def is_punctuation(c: Column, language: str = "english") -> Column:
    kind = next(k for k in PUNCTUATION if language.lower().startswith(k))
    return c.rlike(PUNCTUATION[kind])


def normalize(c: Column) -> Column:
    return F.when(is_numerical(c), "<num>").otherwise(c)


def is_capitalised(c: Column) -> Column:
    """The first character is its own upper case (digits and marks too)."""
    return F.upper(F.left(c, F.lit(1))) == F.left(c, F.lit(1))


def contains(c: Column, what: str) -> Column:
    return F.contains(c, F.lit(what))


def suffix_of(c: Column, n: int) -> Column:
    """The last ``n`` characters of a longer token, else null."""
    return F.when(F.length(c) > n, F.right(c, F.lit(n)))


def longest_suffix(c: Column, suffixes: list[str]) -> Column:
    """The longest listed proper suffix of two or more characters, else empty; case matters."""
    known = sorted(set(suffixes))
    probes = F.transform(F.sequence(F.length(c) - 1, F.lit(2), F.lit(-1)), lambda n: F.right(c, n))
    return F.when(F.length(c) > 2, F.coalesce(F.get(F.filter(probes, lambda s: s.isin(known)), F.lit(0)), F.lit(""))).otherwise("")


def all_suffixes(c: Column, suffixes: list[str]) -> Column:
    """Every listed suffix, the whole token included, the short ones first."""
    known = sorted(set(suffixes))
    probes = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda n: F.right(c, n))
    return F.filter(probes, lambda s: s.isin(known))


def logsum(a: Column, b: Column) -> Column:
    """log(exp a + exp b); infinities and nulls count as missing."""
    ok = lambda x: x.isNotNull() & (F.abs(x) != float("inf"))
    return F.when(~ok(a), b).when(~ok(b), a).otherwise(F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b))))


def logsum_all(a: Column) -> Column:
    """log of the sum of exp over an array; infinities and nulls count as missing, null where nothing is left."""
    some = F.filter(a, lambda x: x.isNotNull() & (F.abs(x) != float("inf")))
    top = F.array_max(some)
    return top + F.log(F.aggregate(some, F.lit(0.0), lambda t, x: t + F.exp(x - top)))


def entropy_bits(p: Column) -> Column:
    """Of an array of probabilities; what is not positive counts nothing."""
    return -F.aggregate(F.filter(p, lambda x: x > 0), F.lit(0.0), lambda a, x: a + x * F.log2(x))


def clip_normalize(p: Column) -> Column:
    """Negative entries to 0, then divided by the sum; null where nothing is left."""
    clipped = F.transform(p, lambda x: F.greatest(x, F.lit(0.0)))
    total = F.aggregate(clipped, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.transform(clipped, lambda x: F.try_divide(x, total)))


def letter(tag: Column) -> Column:
    """0 is a."""
    return F.char(tag + 97)


def letter_index(c: Column) -> Column:
    return F.ascii(c) - 97


def argmax(p: Column) -> Column:
    """Index of the largest entry; the first one wins ties."""
    return F.array_position(p, F.array_max(p)).cast("int") - 1
