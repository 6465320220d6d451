"""Exact quantiles without gathering a group in one task.

Spark's ``median``/``percentile`` keep every distinct value of a group in one aggregation buffer. Here
equal values fold into counted ones first, in one pass over the data, whatever the number of columns asked for.
Where a group has more than ``KINDS`` distinct values, the window of a wanted rank is narrowed by radix
selection: the 64 bits of a double, turned so that they sort as the values do, are read ``BITS`` at a time from the
front. A round counts per digit inside each open window (partial aggregation does the work before the shuffle) and keeps the
digit that holds the rank. Six rounds pin down every bit, so no spread of values takes more; a window that
holds few values is read off at once. Infinite values sort at the ends, NaN after all others.

The folded values and each round's windows (a few rows per group) are written to the checkpoint folder, so Spark knows
their size when it picks between broadcasting them and shuffling both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reckonry.plans.staging import stage
from reckonry.plans.sums import join_null_safe

#: Bits that a round reads.
BITS = 12
#: Distinct values that a window may hold to be read off.
KINDS = 4096


def _position(n: Column, q: float, exclusive: bool) -> Column:
    raw = (n + 1) * q - 1 if exclusive else (n - 1) * F.lit(float(q))
    return F.greatest(F.lit(0.0), F.least(raw, (n - 1).cast("double")))


def _sortable(v: Column) -> Column:
    """The bits of a double as a whole number that sorts as the value does."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), v).cast("long")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit((1 << 63) - 1)))


def _narrow(data: DataFrame, windows: DataFrame, keys: list[str], known: int) -> DataFrame:
    """One round: windows(keys, target, rank, low), whose first ``known`` bits are the same in all their values -> the next digit's window."""
    whole, left = 64 - known, max(64 - known - BITS, 0)

    def front(c: str) -> Column:
        return F.shiftright(c, whole) if known else F.lit(0).cast("long")

    open_ = windows.select(*keys, front("low").alias("front")).distinct()
    inside = join_null_safe(data.withColumn("front", front("bits")), open_, [*keys, "front"], "inner")
    counted = inside.groupBy(*keys, "front", F.shiftright("bits", left).alias("digit")).agg(
        F.sum("w").alias("cnt"), F.count(F.lit(1)).alias("kinds"))
    order = Window.partitionBy(*keys, "front").orderBy("digit")  # a line a digit
    counted = counted.withColumn("start", F.sum("cnt").over(order) - F.col("cnt"))
    found = join_null_safe(windows.drop("kinds", "high").withColumn("front", front("low")), counted, [*keys, "front"], "inner").where(
        (F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("start") + F.col("cnt")))
    low = F.shiftleft("digit", left)
    return found.select(*keys, "target", (F.col("rank") - F.col("start")).alias("rank"), low.alias("low"),
                        (low + F.lit((1 << left) - 1)).alias("high"), "kinds")


def _selected(folded: DataFrame, keys: list[str], wanted: dict[str, float], exclusive: bool) -> DataFrame:
    """One row per group of the folded (keys, v, w): the keys, n, and a column a wanted name."""
    data = stage(folded.withColumn("bits", _sortable(F.col("v"))), "values")
    groups = stage(data.groupBy(*keys).agg(
        F.sum("w").alias("n"), F.min("bits").alias("low"), F.max("bits").alias("high"), F.count(F.lit(1)).alias("kinds")), "groups")
    targets = []
    for name, q in wanted.items():
        at = _position(F.col("n"), q, exclusive)
        targets += [F.struct(F.lit(f"{name}/{end}").alias("target"), rank.alias("rank")) for end, rank in (("low", F.floor(at)), ("high", F.ceil(at)))]
    windows = groups.select(*keys, F.inline(F.array(*targets)), "low", "high", "kinds")
    known = 0
    while known < 64 and (windows.agg(F.max("kinds")).first()[0] or 0) > KINDS:
        small = windows.where(F.col("kinds") <= KINDS)
        windows = stage(_narrow(data, windows.where(F.col("kinds") > KINDS), keys, known).select(*windows.columns).unionByName(small), "windows")
        known += BITS

    ranges = windows.select(*keys, "low", "high").distinct()
    left = join_null_safe(data, ranges, keys, "inner").where(F.col("bits").between(F.col("low"), F.col("high")))
    order = Window.partitionBy(*keys, "low", "high").orderBy("bits")
    left = left.withColumn("start", F.sum("w").over(order) - F.col("w"))
    picked = join_null_safe(windows, left, [*keys, "low", "high"], "inner").where(
        (F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("start") + F.col("w")))
    wide = picked.groupBy(*keys).agg(*[
        F.max(F.when(F.col("target") == f"{name}/{end}", F.col("v"))).alias(f"{name}/{end}") for name in wanted for end in ("low", "high")])
    out, result = join_null_safe(groups.select(*keys, "n"), wide, keys, "left"), []
    for name, q in wanted.items():
        at = _position(F.col("n"), q, exclusive)
        low, high = F.col(f"`{name}/low`"), F.col(f"`{name}/high`")
        result.append(F.when(low == high, low).otherwise(low + (high - low) * (at - F.floor(at))).alias(name))
    return out.select(*keys, "n", *result)


def _folded(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*keys, (F.col(value).cast("double") + 0.0).alias("v")).agg(F.count(F.lit(1)).alias("w"))


def exact_quantiles(
    df: DataFrame, groups: list[str], value: str, wanted: dict[str, float], exclusive: bool = False
) -> DataFrame:
    """One row per group: the groups, ``n`` and one interpolated quantile per wanted name. Nulls don't count."""
    keys = groups or ["__all"]
    base = df if groups else df.withColumn("__all", F.lit(0))
    return _selected(_folded(base, keys, value), keys, wanted, exclusive).select(*groups, "n", *wanted)


def exact_medians(df: DataFrame, groups: list[str], wanted: dict[str, str]) -> DataFrame:
    """One row per group: the groups and the median of a column per wanted name, all of them in the same rounds."""
    names = list(wanted)
    values = F.array(*[F.col(wanted[n]).cast("double") for n in names])
    long = df.select(*groups, F.posexplode(values).alias("__which", "__value"))
    found = _selected(_folded(long, [*groups, "__which"], "__value"), [*groups, "__which"], {"median": 0.5}, False)
    return found.groupBy(*groups).agg(*[F.max(F.when(F.col("__which") == i, F.col("median"))).alias(n) for i, n in enumerate(names)])
