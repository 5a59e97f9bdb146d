"""Routing questions to computation or lookup."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that ask for a computation.
PATTERNS = (
    r"\btotal\b", r"\bsum\b", r"\baverage\b", r"\bavg\b", r"\bmean of\b", r"\bmedian\b", r"\bcount\b", r"\bhow many\b", r"\bnumber of\b", r"\brate\b",
    r"\bpercentage\b", r"\bpercent\b", r"\bratio\b", r"\bper\s", r"\bacross all\b", r"\bcombined\b", r"\bstandard deviation\b", r"\bvariance\b", r"\bhighest\b", r"\blowest\b",
    r"\bmaximum\b", r"\bminimum\b", r"\bmax\b", r"\bmin\b", r"\bmost\b", r"\bleast\b", r"\bbelow\b", r"\babove\b", r"\bmore than\b", r"\bless than\b",
)


def compute_pattern(extra: Iterable[str] = (), disable: Iterable[str] = ()) -> str:
    """One alternation of the patterns; extras are taken as they are, against lower-cased questions."""
    off = set(disable)
    kept = [p for p in PATTERNS if p not in off] + list(extra or ())
    return "|".join(f"(?:{p})" for p in kept) or r"(?!)"


def route(question: Column, extra: Iterable[str] = (), disable: Iterable[str] = ()) -> Column:
    """``compute`` or ``lookup`` for a column of questions."""
    return F.when(F.lower(question).rlike(compute_pattern(extra or (), disable or ())), "compute").otherwise("lookup")


def classify(question: str, extra: Iterable[str] = (), disable: Iterable[str] = ()) -> str:
    """``route`` for one question at the driver."""
    import re

    return "compute" if re.search(compute_pattern(extra or (), disable or ()), question.lower()) else "lookup"


def choose_route(question: str, n_tables: int, forced: str | None = None, classifier: Callable[[str], str] = classify) -> str:
    """The route to try: forced, else classified; lookup wherever there is no table."""
    if forced not in (None, "compute", "lookup"):
        raise ValueError(f"route must be 'compute', 'lookup' or None; got {forced!r}")
    if not n_tables:
        return "lookup"
    return forced or classifier(question)
