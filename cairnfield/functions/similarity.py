"""Similarity of functions by name and shape (F5-F10), on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_tokens(name: Column) -> Column:
    """camelCase, snake_case and kebab-case in lower-case words, distinct."""
    spaced = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"([a-z0-9])([A-Z])", "$1 $2"), "[_-]+", " ")
    return F.array_distinct(F.filter(F.split(F.lower(spaced), r"\s+"), lambda t: t != ""))


def dice(a: Column, b: Column) -> Column:
    """0 where one is empty."""
    n = F.size(a) + F.size(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / n)


def jaccard(a: Column, b: Column) -> Column:
    """1 where both are empty, 0 where one is."""
    none = (F.size(a) == 0) & (F.size(b) == 0)
    return F.when(none, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def number(a: Column, b: Column) -> Column:
    """F8: the smaller by the larger, at least 1; two zeros are alike, an unknown number is like none."""
    both = F.when((a == 0) & (b == 0), 1.0).otherwise(F.least(F.abs(a), F.abs(b)) / F.greatest(F.abs(a), F.abs(b), F.lit(1)))
    return F.coalesce(F.when(a.isNotNull() & b.isNotNull(), both), F.lit(0.0))


def structural(a: Column, b: Column) -> Column:
    """parameters 0.25, callees 0.4, body 0.35; null if one fingerprint is missing."""

    def flag(name: str) -> Column:
        return (F.coalesce(a[name], F.lit(False)) == F.coalesce(b[name], F.lit(False))).cast("double")

    body = 0.3 * flag("isAsync") + 0.1 * flag("isGenerator") + 0.2 * flag("hasTryCatch") + 0.2 * number(a["branchCount"], b["branchCount"]) + 0.2 * number(a["returnCount"], b["returnCount"])
    none = F.array().cast("array<string>")
    callees = jaccard(F.coalesce(a["callCallees"], none), F.coalesce(b["callCallees"], none))
    return F.when(a.isNotNull() & b.isNotNull(), 0.25 * number(a["paramCount"], b["paramCount"]) + 0.4 * callees + 0.35 * body)


def similarity(name_a: Column, name_b: Column, print_a: Column | None = None, print_b: Column | None = None) -> Column:
    """three quarters structure, one quarter name; the name alone where a fingerprint is missing."""
    by_name = dice(name_tokens(name_a), name_tokens(name_b))
    if print_a is None or print_b is None:
        return by_name
    shape = structural(print_a, print_b)
    return F.when(shape.isNull(), by_name).otherwise(0.75 * shape + 0.25 * by_name)
