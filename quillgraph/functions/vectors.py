"""Vector functions over array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quillgraph.functions.text import col


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str, norm_a: Column | str | None = None, norm_b: Column | str | None = None) -> Column:
    """Cosine similarity; null where a vector is null or zero. Norms may be given, so that they are computed once a row."""
    na = norm(a) if norm_a is None else col(norm_a)
    nb = norm(b) if norm_b is None else col(norm_b)
    return dot(a, b) / F.nullif(na * nb, F.lit(0.0))


def relu(c: Column) -> Column:
    """c where positive, 0 where it is not, null or NaN."""
    return F.when(~F.isnan(c) & (c > 0), c).otherwise(0.0)


def index_score(c: Column) -> Column:
    """Cosine as vector indexes report it, from 0 to 1."""
    return (1 + c) / 2
