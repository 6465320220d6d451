"""Aggregates that give the same figure whatever order tasks finish in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def cents(c: Column) -> Column:
    """Money in cents as a decimal, parts of a cent included: sums are exact and order-independent.

    Nothing is rounded before it is summed; ``units`` rounds the result.
    """
    return c.cast("decimal(30, 8)") * 100


def units(total: Column, places: int = 2) -> Column:
    """A total of cents as money, rounded once."""
    return F.round((total / 100).cast("decimal(38, 10)"), places).cast("double")


def money_sum(c: Column) -> Column:
    return units(F.sum(cents(c)))


def money_sum_or_zero(c: Column) -> Column:
    return F.coalesce(money_sum(c), F.lit(0.0))


def money_avg(c: Column, places: int = 4) -> Column:
    return F.round(F.sum(cents(c)).cast("double") / (100.0 * F.nullif(F.count(c), F.lit(0))), places)


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality on every key."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on keys where null meets null; the keys come out once, from the left."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    if not keys:
        return left.join(renamed, F.lit(True), how)
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys])
    joined = left.join(renamed, on, how)
    return joined.drop(*[f"__r_{k}" for k in keys])
