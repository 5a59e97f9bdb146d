"""Similarity metrics over arrays of doubles; the longer vector is cut to the shorter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def _cut(a: Column, b: Column) -> tuple[Column, Column]:
    n = F.least(F.size(a), F.size(b))
    return F.slice(a, 1, n), F.slice(b, 1, n)


def dot(a: Column, b: Column) -> Column:
    a, b = _cut(a, b)
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """0 where either norm is 0."""
    return F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    a, b = _cut(a, b)
    return 1 / (1 + F.sqrt(_total(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))))))


METRICS: dict[str, Callable[[Column, Column], Column]] = {"cosine": cosine, "dot": dot, "euclidean": euclidean}


def metric(name: str) -> Callable[[Column, Column], Column]:
    if name not in METRICS:
        raise ValueError(f"similarity must be one of {sorted(METRICS)}; got {name!r}")
    return METRICS[name]
