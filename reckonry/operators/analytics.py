"""Period comparison, headline figures and two-sided reconciliation."""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame, Window, functions as F

from reckonry.operators.query import checked
from reckonry.plans.staging import stage
from reckonry.plans.sums import cents, money_avg, money_sum, money_sum_or_zero, units


def _in_period(date: str, period: tuple[str, str]) -> Column:
    return F.col(date).cast("date").between(F.lit(period[0]).cast("date"), F.lit(period[1]).cast("date"))


def _two_sums(date: str, metric: str, a, b) -> list[Column]:
    return [
        F.coalesce(F.sum(F.when(_in_period(date, p), cents(F.col(metric))).otherwise(0)), F.lit(0)).alias(n)
        for n, p in (("cents_a", a), ("cents_b", b))
    ]


def _change(before: Column, after: Column) -> Column:
    """Percent change to two places; null on a zero base."""
    return F.round((after - before) / F.nullif(before.cast("double"), F.lit(0.0)) * 100, 2)


def _compared(df: DataFrame, *keep: str) -> DataFrame:
    a, b = F.col("cents_a"), F.col("cents_b")
    return df.select(
        *keep,
        units(a).alias("total_a"),
        units(b).alias("total_b"),
        units(b - a).alias("difference"),
        _change(a, b).alias("percent_change"),
    )


def compare_totals(df: DataFrame, date: str, metric: str, period_a, period_b) -> DataFrame:
    """Both period totals in one pass over the data."""
    for name in (date, metric):
        checked(name, df.columns)
    return _compared(df.agg(*_two_sums(date, metric, period_a, period_b)))


def compare_drivers(
    df: DataFrame, date: str, metric: str, period_a, period_b, breakdown: str, top_n: int = 5
) -> DataFrame:
    """What moved most between the periods."""
    for name in (date, metric, breakdown):
        checked(name, df.columns)
    sums = df.groupBy(F.col(breakdown).alias("label")).agg(*_two_sums(date, metric, period_a, period_b))
    moved = F.abs(F.col("cents_b") - F.col("cents_a"))
    return _compared(sums.orderBy(moved.desc(), F.col("label").asc_nulls_last()).limit(top_n), "label")


# ---------------------------------------------------------------- headline figures


def money_kpis(df: DataFrame, money: list[str]) -> DataFrame:
    """One row per money column from a single aggregate."""
    known = [c for c in money if c in df.columns]
    parts = []
    for i, name in enumerate(known):
        c = F.col(name)
        parts += [
            money_sum_or_zero(c).alias(f"total{i}"),
            F.coalesce(money_avg(c, 2), F.lit(0.0)).alias(f"average{i}"),
            F.coalesce(F.min(c), F.lit(0.0)).alias(f"minimum{i}"),
            F.coalesce(F.max(c), F.lit(0.0)).alias(f"maximum{i}"),
            F.count_if(c < 0).alias(f"negative_rows{i}"),
        ]
    fields = ("total", "average", "minimum", "maximum", "negative_rows")
    rows = F.array(*[
        F.struct(F.lit(name).alias("column"), *[F.col(f"{f}{i}").alias(f) for f in fields])
        for i, name in enumerate(known)
    ])
    return df.agg(F.count(F.lit(1)).alias("row_count"), *parts).select("row_count", F.inline(rows))


def month_of(date: str) -> Column:
    return F.date_format(F.col(date).cast("date"), "yyyy-MM")


def date_span(df: DataFrame, date: str) -> DataFrame:
    day = F.col(date).cast("date")
    return df.agg(
        F.min(day).cast("string").alias("earliest"),
        F.max(day).cast("string").alias("latest"),
        F.count_distinct(month_of(date)).alias("distinct_months"),
    )


def top_breakdown(df: DataFrame, breakdown: str, metric: str, n: int = 10) -> DataFrame:
    sums = df.groupBy(F.col(breakdown).alias("label")).agg(
        money_sum_or_zero(F.col(metric)).alias("total"), F.count(F.lit(1)).alias("row_count")
    )
    return sums.orderBy(F.abs("total").desc(), F.col("label").asc_nulls_last()).limit(n)


def monthly_series(df: DataFrame, date: str, metric: str) -> DataFrame:
    return (
        df.where(F.col(date).isNotNull())
        .groupBy(month_of(date).alias("month"))
        .agg(money_sum_or_zero(F.col(metric)).alias("total"), F.count(F.lit(1)).alias("row_count"))
    )


def latest_months(df: DataFrame, date: str, metric: str) -> DataFrame:
    """The newest month with rows against the one before it that has rows.

    A single-month version is first joined to its sibling with
    :func:`union_shared`; one month alone gives null for the earlier side.
    """
    two = monthly_series(df, date, metric).orderBy(F.col("month").desc()).limit(2)
    sides = two.agg(
        F.max("month").alias("month_b"),
        F.max_by("total", "month").alias("total_b"),
        F.when(F.count(F.lit(1)) == 2, F.min("month")).alias("month_a"),
        F.when(F.count(F.lit(1)) == 2, F.min_by("total", "month")).alias("total_a"),
    )
    return sides.select(
        "month_a", "month_b", "total_a", "total_b",
        F.round(F.col("total_b") - F.col("total_a"), 2).alias("difference"),
        _change(F.col("total_a"), F.col("total_b")).alias("percent_change"),
    )


def union_shared(left: DataFrame, right: DataFrame) -> DataFrame | None:
    """Rows of both versions on the columns they share, in the left order."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        return None
    return left.select(*shared).unionByName(right.select(*shared))


def breakdown_column(profile: DataFrame) -> DataFrame:
    """Text, repeated, not a reference; the fewest distinct values wins."""
    distinct, filled = F.col("distinct_count"), F.col("non_null")
    usable = (
        (F.col("inferred_type") == "text") & (filled > 0) & (distinct > 1)
        & (distinct < F.greatest(F.lit(2.0), filled * 0.8))
    )
    return profile.where(usable).orderBy("distinct_count", "position").limit(1).select("column")


def unique_key_column(profile: DataFrame) -> DataFrame:
    """First text column whose values are all different: the default reconcile key."""
    usable = (
        (F.col("inferred_type") == "text") & (F.col("non_null") > 0)
        & (F.col("distinct_count") == F.col("non_null"))
    )
    return profile.where(usable).orderBy("position").limit(1).select("column")


# ---------------------------------------------------------------- reconciliation


def _check_sides(a: DataFrame, b: DataFrame, names: list[str]) -> None:
    for df in (a, b):
        for name in names:
            checked(name, df.columns)


def _known_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df


def _per_key(df: DataFrame, keys: list[str], amount: str, side: str) -> DataFrame:
    """Equal rows first fold into one counted row, so copies never multiply in a join."""
    counted = _known_keys(df, keys).groupBy(*keys, F.col(amount).cast("double").alias("amount")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    return counted.withColumnsRenamed({"amount": f"amount_{side}", "rows": f"rows_{side}"})


def _key_totals(counted: DataFrame, keys: list[str], side: str) -> DataFrame:
    rows, amount = F.col(f"rows_{side}"), F.col(f"amount_{side}")
    return counted.groupBy(*keys).agg(
        F.sum(rows).alias(f"n_{side}"),
        F.count(F.lit(1)).alias(f"kinds_{side}"), F.min(amount).alias(f"low_{side}"), F.max(amount).alias(f"high_{side}"),
        F.coalesce(F.sum(F.when(amount.isNotNull(), rows)), F.lit(0)).alias(f"filled_{side}"),
        F.coalesce(F.sum(cents(amount) * rows), F.lit(0)).alias(f"cents_{side}"),
    )


def reconcile_matched(a: DataFrame, b: DataFrame, keys: list[str], amount: str, totals: bool = False) -> DataFrame:
    """Keys on both sides with amounts and difference, in run-length form.

    One line stands for all ``pairs`` of equal rows: those of one key with the same two amounts. A key whose rows differ on
    both sides is ``many_to_many`` and has a line for each of its pairs of amounts, dealt over tasks by parts of
    the left amounts. With ``totals`` such a key is one line with the totals over all its
    pairs instead, so that output stays linear in the input.
    """
    return _totalled(a, b, keys, amount).drop("widest") if totals else _lines(a, b, keys, amount)


#: Lines of one key that one task makes, about.
LINES_A_PART = 100_000


def _lines(a: DataFrame, b: DataFrame, keys: list[str], amount: str) -> DataFrame:
    _check_sides(a, b, [*keys, amount])
    left, right = _per_key(a, keys, amount, "a"), _per_key(b, keys, amount, "b")
    kinds = [x.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"kinds_{s}")) for x, s in ((left, "a"), (right, "b"))]
    made = F.col("kinds_a") * F.col("kinds_b")
    both = kinds[0].join(kinds[1], keys).select(
        *keys, ((F.col("kinds_a") > 1) & (F.col("kinds_b") > 1)).alias("many_to_many"),
        F.least(F.ceil(made / LINES_A_PART), F.col("kinds_a")).cast("int").alias("parts"))
    lhs = left.join(both, keys).withColumn("part", F.pmod(F.xxhash64("amount_a"), F.col("parts")).cast("int"))
    rhs = right.join(both.drop("many_to_many"), keys).select(*right.columns, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return lhs.join(rhs, [*keys, "part"]).select(
        *keys, "amount_a", "amount_b", (F.col("amount_a") - F.col("amount_b")).alias("difference"),
        (F.col("rows_a") * F.col("rows_b")).alias("pairs"), "many_to_many")


def _totalled(a: DataFrame, b: DataFrame, keys: list[str], amount: str) -> DataFrame:
    """``widest`` is the largest difference of any pair that a line stands for."""
    _check_sides(a, b, [*keys, amount])
    left, right = _per_key(a, keys, amount, "a"), _per_key(b, keys, amount, "b")
    both = _key_totals(left, keys, "a").join(_key_totals(right, keys, "b"), keys)
    many = (F.col("kinds_a") > 1) & (F.col("kinds_b") > 1)
    simple = both.where(~many).select(*keys)
    lines = left.join(simple, keys, "left_semi").join(right, keys).select(
        *keys, "amount_a", "amount_b",
        (F.col("amount_a") - F.col("amount_b")).alias("difference"),
        (F.col("rows_a") * F.col("rows_b")).alias("pairs"),
        F.lit(False).alias("many_to_many"), F.abs(F.col("amount_a") - F.col("amount_b")).alias("widest"),
    )
    total_a = units(F.col("cents_a") * F.col("filled_b"))
    total_b = units(F.col("cents_b") * F.col("filled_a"))
    totals = both.where(many).select(
        *keys, total_a.alias("amount_a"), total_b.alias("amount_b"),
        (total_a - total_b).alias("difference"),
        (F.col("n_a") * F.col("n_b")).alias("pairs"),
        F.lit(True).alias("many_to_many"),
        F.greatest(F.col("high_a") - F.col("low_b"), F.col("high_b") - F.col("low_a")).alias("widest"),
    )
    return lines.unionByName(totals)


def reconcile_only(a: DataFrame, b: DataFrame, keys: list[str], amount: str) -> DataFrame:
    """Rows of ``a`` whose key never appears in ``b``; a null key is never matched."""
    _check_sides(a, b, [*keys, amount])
    return a.select(*keys, F.col(amount).alias("amount")).join(
        b.select(*keys).distinct(), keys, "left_anti"
    )


def _reach(amount: Column, tolerance: float, sign: int) -> tuple[Column, Column, int]:
    """The furthest point whose difference to ``amount``, as doubles give it, is within tolerance: (double, rest, whether a value there counts).

    A rounded difference is within tolerance if the exact one is within the tolerance and half the gap to the next double, the end
    included if the tolerance's last bit is 0. The exact point is kept as a double and what that rounds off.
    """
    half, last_bit = math.ulp(tolerance) / 2, struct.unpack("<q", struct.pack("<d", tolerance))[0] & 1
    step = F.lit(sign * tolerance)
    near = amount + step
    back = near - amount
    rest = (amount - (near - back)) + (step - back) + F.lit(sign * half)
    point = near + rest
    return point, rest - (point - near), 0 if last_bit else 1


def _near_sums(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """One row: ``near`` row pairs within tolerance and ``near_cents``, the sum of their differences.

    No pair is made. Per key, right amounts lie in order with running counts and totals; each left amount reads them at
    both ends of its reach, and the two readings differ by what lies between. The order is dealt out by ranges of (key, amount),
    so a key of any size is spread; a key that goes on in a later range takes the totals of the ranges before along,
    which is one row a range.
    """
    sides, finite = [], {}
    for x, s in ((left, "a"), (right, "b")):
        finite[s] = x.where(F.col(f"amount_{s}").isNotNull() & ~F.isnan(f"amount_{s}") & (F.abs(f"amount_{s}") != float("inf"))).withColumn(
            f"amount_{s}", F.col(f"amount_{s}") + 0.0)
    spent = cents(F.col("amount_b")) * F.col("rows_b")
    no_rows, no_cents = F.lit(0).cast("long"), F.lit(0).cast("decimal(38,8)")
    sides.append(finite["b"].select(*keys, F.col("amount_b").alias("at"), F.lit(0.0).alias("rest"), F.lit(1).alias("turn"), F.col("rows_b").alias("rows"),
                                    spent.cast("decimal(38,8)").alias("cents"), no_rows.alias("asks"), no_cents.alias("own")))
    for sign in (-1, 1):
        at, rest, inside = _reach(F.col("amount_a"), tolerance, sign)
        # the lower end is read before a value there that counts, the upper end after it
        turn = 1 + (sign if inside else -sign)
        sides.append(finite["a"].select(*keys, at.alias("at"), rest.alias("rest"), F.lit(turn).alias("turn"), no_rows.alias("rows"), no_cents.alias("cents"),
                                        (F.col("rows_a") * sign).alias("asks"), cents(F.col("amount_a")).cast("decimal(38,8)").alias("own")))
    order = ["at", "rest", "turn"]
    events = sides[0].unionByName(sides[1]).unionByName(sides[2])
    # written, so that a row stays in its range
    events = stage(events.repartitionByRange(*keys, *order).withColumn("range", F.spark_partition_id()), "amounts")
    whole = F.struct(*keys)
    ends = events.groupBy("range").agg(F.min(whole).alias("first"), F.max(whole).alias("last"))
    in_order = Window.orderBy("range")  # one row a range
    continued = stage(ends.withColumn("before", F.lag("last").over(in_order)).where("first = before").select("range", "first"), "continued")
    spanning = continued.select(F.col("first").alias("key")).distinct()
    totals = events.where("rows > 0").withColumn("key", whole).join(spanning, "key", "left_semi").groupBy("key", "range").agg(
        F.sum("rows").alias("rows"), F.sum("cents").alias("cents"))
    carried = continued.select("range", F.col("first").alias("key")).join(totals.withColumnRenamed("range", "earlier"), "key").where("earlier < range").groupBy("range", "key").agg(
        F.sum("rows").alias("carried_rows"), F.sum("cents").alias("carried_cents"))
    so_far = Window.partitionBy("range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    read = events.withColumns({"key": whole, "seen": F.sum("rows").over(so_far), "spent": F.sum("cents").over(so_far)}).where("asks <> 0")
    read = read.join(carried, ["range", "key"], "left")
    seen = F.col("seen") + F.coalesce("carried_rows", F.lit(0))
    spent = F.col("spent") + F.coalesce("carried_cents", F.lit(0))
    return read.agg(F.coalesce(F.sum(F.col("asks") * seen), F.lit(0)).alias("near"),
                    F.coalesce(F.sum(F.col("asks") * (F.col("own") * seen - spent)), F.lit(0)).alias("near_cents"))


def reconcile_summary(
    a: DataFrame, b: DataFrame, keys: list[str], amount: str, tolerance: float = 0.01
) -> DataFrame:
    """Bucket counts and totals over all row pairs, without building the pairs."""
    _check_sides(a, b, [*keys, amount])
    left, right = _per_key(a, keys, amount, "a"), _per_key(b, keys, amount, "b")
    both = _key_totals(left, keys, "a").join(_key_totals(right, keys, "b"), keys)
    all_pairs = both.agg(
        F.coalesce(F.sum(F.col("n_a") * F.col("n_b")), F.lit(0)).alias("pairs"),
        F.coalesce(F.sum(F.col("filled_a") * F.col("filled_b")), F.lit(0)).alias("filled_pairs"),
        F.coalesce(
            F.sum(F.col("cents_a") * F.col("filled_b") - F.col("cents_b") * F.col("filled_a")), F.lit(0)
        ).alias("diff_cents"),
    )
    near = _near_sums(left, right, keys, tolerance)

    def unmatched(x: DataFrame, y: DataFrame, side: str) -> DataFrame:
        return reconcile_only(x, y, keys, amount).agg(
            F.count(F.lit(1)).alias(f"only_in_{side}"),
            money_sum_or_zero(F.col("amount")).alias(f"unmatched_value_{side}"),
        )

    one_row = (
        all_pairs.join(F.broadcast(near), F.lit(True))
        .join(F.broadcast(unmatched(a, b, "a")), F.lit(True))
        .join(F.broadcast(unmatched(b, a, "b")), F.lit(True))
    )
    return one_row.select(
        (F.col("pairs") - F.col("filled_pairs") + F.col("near")).alias("matched"),
        (F.col("filled_pairs") - F.col("near")).alias("matched_with_difference"),
        "only_in_a", "only_in_b",
        units(F.col("diff_cents") - F.col("near_cents")).alias("difference_total"),
        "unmatched_value_a", "unmatched_value_b",
    )


def reconcile_examples(
    a: DataFrame, b: DataFrame, keys: list[str], amount: str, tolerance: float = 0.01, n: int = 10
) -> DataFrame:
    """Ten example lines per bucket, lowest keys first; a key differs if any of its pairs does, also where totals cancel."""
    differing = _totalled(a, b, keys, amount).where(
        F.coalesce("widest", F.lit(0.0)) > tolerance
    ).orderBy(*keys, "amount_a", "amount_b").limit(n)
    sides = [differing.select(F.lit("differing").alias("bucket"), *keys, "amount_a", "amount_b")]
    for name, x, y in (("only_in_a", a, b), ("only_in_b", b, a)):
        rows = reconcile_only(x, y, keys, amount).orderBy(*keys, "amount").limit(n)
        value = F.col("amount").cast("double")
        none = F.lit(None).cast("double")
        sides.append(rows.select(
            F.lit(name).alias("bucket"), *keys,
            (value if name == "only_in_a" else none).alias("amount_a"),
            (value if name == "only_in_b" else none).alias("amount_b"),
        ))
    return sides[0].unionByName(sides[1]).unionByName(sides[2])
