"""Tolerant answer matching as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, trim, words

NUMBER = r"(?i)-?\d[\d,]*(?:\.\d+)?\s*(?:[kmb])?"


def normalize(c: Column) -> Column:
    """Lower case, no currency or percent signs, single spaces."""
    return F.array_join(words(F.regexp_replace(F.lower(c), "[$€£%]", "")), " ")


def parse_number(c: Column) -> Column:
    """The number that a gold answer is, thousands ``k`` expanded; else null."""
    text = F.lower(trim(c))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[$€£%]", ""), ",", ""), r"k\z", "")
    plain = trim(bare)
    number = plain.rlike(r"^[+-]?(\d+(_\d+)*\.?\d*|\.\d+)(e[+-]?\d+)?$")
    other = plain.rlike(r"^[+-]?(nan|inf|infinity)$")
    value = F.when(number | other, F.regexp_replace(plain, "_", "").try_cast("double"))
    return F.when(text.endswith("k"), value * 1000).otherwise(value)


def numbers_in(c: Column) -> Column:
    """All numbers of a text, with k, m and b expanded."""

    def value(found: Column) -> Column:
        low = F.lower(found)
        scale = F.when(low.endswith("k"), 1e3).when(low.endswith("m"), 1e6).when(low.endswith("b"), 1e9).otherwise(1.0)
        return F.regexp_replace(low, r"[kmb\s,]", "").try_cast("double") * scale

    return F.transform(F.regexp_extract_all(c, F.lit(NUMBER), 0), value)


def numbers_close(a: Column, b: Column, rel_tol: float = 0.01) -> Column:
    """Within the tolerance of the larger, also as percent against fraction."""

    def near(x: Column, y: Column, least: float) -> Column:
        within = F.abs(x - y) <= F.greatest(rel_tol * F.greatest(F.abs(x), F.abs(y)), F.lit(least))
        finite = F.greatest(F.abs(x), F.abs(y)) < float("inf")  # NaN is the greatest double
        return (finite & within) | ((x == y) & ~F.isnan(x))

    return near(a, b, 1e-9) | near(a, b * 100, 0.0) | near(a * 100, b, 0.0)


def answer_match(prediction: Column, golds: Column, require_all: Column | bool = False, rel_tol: float = 0.01) -> Column:
    """Whether a prediction matches any (or all) of an array of gold answers; no golds match nothing."""

    def matches(plain: Column, numbers: Column) -> Column:
        def one(gold: Column) -> Column:
            text = normalize(gold)
            number = parse_number(gold)
            hit = F.exists(numbers, lambda n: numbers_close(n, number, rel_tol))
            return ((text != "") & F.contains(plain, text)) | (number.isNotNull() & F.coalesce(hit, F.lit(False)))

        every = F.lit(require_all) if isinstance(require_all, bool) else require_all
        return F.when(every, F.forall(golds, one)).otherwise(F.exists(golds, one))

    both = F.struct(normalize(prediction).alias("plain"), numbers_in(prediction).alias("numbers"))
    return F.when(F.coalesce(F.size(golds), F.lit(0)) > 0, F.coalesce(let(both, lambda b: matches(b["plain"], b["numbers"])), F.lit(False))).otherwise(F.lit(False))
