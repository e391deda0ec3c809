"""Ranks, folds and casts on short arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def argmax(scores: Column) -> Column:
    """Index of the first largest score, 0 if there is none. NaN counts as missing."""
    clean = F.transform(scores, lambda x: F.when(F.isnan(x), F.lit(None)).otherwise(x))
    return F.coalesce(F.array_position(clean, F.array_max(clean)) - 1, F.lit(0)).cast("long")


def ranking(scores: Column) -> Column:
    """Indices by descending score, ties by index."""
    order = F.array_sort(F.transform(scores, lambda x, i: F.struct((-x).alias("x"), i.alias("i"))))
    return F.transform(order, lambda s: s["i"].cast("long"))


def dcg(relevance: Column) -> Column:
    parts = F.transform(relevance, lambda r, i: r / F.log2(i + F.lit(2.0)))
    return F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)


def average_precision(flags: Column) -> Column:
    """Mean precision at the hits, 0 without any."""
    start = F.struct(F.lit(0.0).alias("hits"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("at"))
    step = lambda s, f: F.struct((s["hits"] + f).alias("hits"), (s["sum"] + F.when(f > 0, (s["hits"] + f) / (s["at"] + 1)).otherwise(0.0)).alias("sum"), (s["at"] + 1).alias("at"))
    done = F.aggregate(F.transform(flags, lambda f: f.cast("double")), start, step)
    return F.when(done["hits"] > 0, done["sum"] / done["hits"]).otherwise(F.lit(0.0))


def first_truthy(*values: Column) -> Column:
    """The first string that isn't empty, as a chain of ``or`` takes it."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def safe_double(v: Column, default: float = 0.0) -> Column:
    return F.coalesce(v.try_cast("double"), F.lit(default))


def safe_int(v: Column, default: int = 0) -> Column:
    return F.coalesce(v.try_cast("long"), F.lit(default).cast("long"))


def with_rest(first: Column, n: Column) -> Column:
    """``first``, then the other indices below ``n`` in order."""
    return F.array_union(F.array(first.cast("long")), F.when(n > 0, F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"))).otherwise(F.array().cast("array<long>")))


def position(a: Column, x: Column) -> Column:
    """One-based, null where it isn't there."""
    return F.nullif(F.array_position(a, x), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda u, v: u + v)
