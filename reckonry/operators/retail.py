"""Period profit and loss over the ledger.

The ledger is read once into a daily cube (day, kind, category, how it was
classified); every figure but the ranked lists derives from that small table.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from reckonry.functions import fixed_values as fv
from reckonry.plans.staging import stage

GRAINS = ("daily", "weekly", "monthly", "yearly")
FINER = {"daily": "daily", "weekly": "daily", "monthly": "weekly", "yearly": "monthly"}
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
MONEY = ("revenue", "refunds", "cogs", "expenses", "uncategorised")


def period_start(day: Column, grain: str, week_start: int = fv.SATURDAY) -> Column:
    if grain == "daily":
        return day
    if grain == "weekly":
        return F.date_sub(day, F.pmod(F.weekday(day) - week_start, F.lit(7)))
    return F.trunc(day, "month" if grain == "monthly" else "year").cast("date")


def period_end(start: Column, grain: str) -> Column:
    if grain == "daily":
        return start
    if grain == "weekly":
        return F.date_add(start, 6)
    if grain == "monthly":
        return F.last_day(start)
    return F.date_sub(F.add_months(start, 12), 1)


def period_label(start: Column, grain: str) -> Column:
    if grain == "daily":
        return start.cast("string")
    if grain == "weekly":
        return F.concat(start.cast("string"), F.lit(" → "), F.date_add(start, 6).cast("string"))
    return F.date_format(start, "yyyy-MM" if grain == "monthly" else "yyyy")


_STEP = {"daily": "interval 1 day", "weekly": "interval 7 days", "monthly": "interval 1 month", "yearly": "interval 1 year"}


def _start_of(day: dt.date, grain: str, week_start: int) -> dt.date:
    if grain == "weekly":
        return day - dt.timedelta(days=(day.weekday() - week_start) % 7)
    if grain == "monthly":
        return day.replace(day=1)
    return day.replace(month=1, day=1) if grain == "yearly" else day


def reporting_window(grain: str, today: dt.date, periods_back: int = 1, week_start: int = fv.SATURDAY) -> tuple[dt.date, dt.date]:
    """The last complete period with the ones before it, as plain dates for plan literals."""
    end = _start_of(today, grain, week_start) - dt.timedelta(days=1)
    start = _start_of(end, grain, week_start)
    for _ in range(max(periods_back, 0)):
        start = _start_of(start - dt.timedelta(days=1), grain, week_start)
    return start, end


# ---------------------------------------------------------------- cube and periods


def daily_cube(base: DataFrame) -> DataFrame:
    """A few rows per day, written once: ``base`` is a ledger with ``amount_base``."""
    amount = F.col("amount_base")
    back = (F.col("kind") == "revenue") & (amount < 0)
    cube = base.groupBy("occurred_on", "kind", "category", "classified_by").agg(
        F.sum(amount).alias("amount"), F.coalesce(F.sum(F.when(back, -amount)), F.lit(0).cast("decimal(38,10)")).alias("refunds"),
        F.count(F.lit(1)).alias("entries"))
    return stage(cube, "cube")


def _sum_when(test: Column, c: Column = None) -> Column:
    c = F.col("amount") if c is None else c
    return F.coalesce(F.sum(F.when(test, c)), F.lit(0).cast("decimal(38,10)"))


def _measures() -> list[Column]:
    kind = F.col("kind")
    revenue, cogs = kind == "revenue", kind == "cogs"
    return [
        _sum_when(revenue).alias("revenue"), F.sum("refunds").alias("refunds"), _sum_when(cogs).alias("cogs"),
        _sum_when(~revenue & ~cogs).alias("expenses"), F.sum("entries").alias("entries"),
        F.count_distinct("occurred_on").alias("trading_days"),
        _sum_when((F.col("classified_by") == "unmatched") & ~revenue).alias("uncategorised")]


def with_margins(periods: DataFrame) -> DataFrame:
    revenue = F.col("revenue")
    gross = revenue - F.col("cogs")
    net = gross - F.col("expenses")

    def ratio(part: Column) -> Column:
        return (part.cast("double") / F.nullif(revenue.cast("double"), F.lit(0.0)))

    days = F.datediff("period_end", "period_start") + 1
    return periods.withColumns({
        "gross_profit": gross, "net_profit": net, "gross_margin": ratio(gross), "net_margin": ratio(net), "days": days,
        "average_daily_revenue": F.bround(revenue / days, 2)})


def build_periods(
    cube: DataFrame, grain: str, window: tuple[dt.date, dt.date] | None = None, week_start: int = fv.SATURDAY
) -> DataFrame:
    """Consecutive periods with empty ones filled; a window widens the range it covers."""
    found = cube.groupBy(period_start(F.col("occurred_on"), grain, week_start).alias("period_start")).agg(*_measures())
    low, high = F.min("period_start"), F.max("period_start")
    if window:
        first, last = (period_start(F.lit(d.isoformat()).cast("date"), grain, week_start) for d in window)
        low, high = F.least(low, first), F.greatest(high, last)
    span = found.agg(low.alias("low"), high.alias("high"))
    every = span.where("low is not null").select(F.explode(F.sequence("low", "high", F.expr(_STEP[grain]))).alias("period_start"))
    filled = every.join(found, "period_start", "left")
    zero = F.lit(0).cast("decimal(38,10)")
    filled = filled.select(
        "period_start", period_end(F.col("period_start"), grain).alias("period_end"),
        period_label(F.col("period_start"), grain).alias("label"),
        *[F.coalesce(c, zero).alias(c) for c in MONEY], *[F.coalesce(c, F.lit(0)).alias(c) for c in ("entries", "trading_days")])
    return with_margins(filled)


def _shares(totals: DataFrame, keys: list[str]) -> DataFrame:
    """Amount per category with its share of revenue or of costs."""
    kinds = F.create_map(*[F.lit(x) for kv in fv.LEDGER_KINDS.items() for x in kv])
    side = F.coalesce(F.try_element_at(kinds, F.col("category")), F.col("kind"))
    whole = totals.groupBy(*keys).agg(
        _sum_when(F.col("kind") == "revenue").alias("__r"), _sum_when(F.col("kind") != "revenue").alias("__c"))
    per = totals.groupBy(*keys, "category").agg(
        F.max("kind").alias("kind"), F.sum("amount").alias("amount"), F.sum("entries").alias("entries"))
    joined = per.join(whole, keys) if keys else per.join(F.broadcast(whole), F.lit(True))
    base = F.when(side == "revenue", F.col("__r")).otherwise(F.col("__c")).cast("double")
    return joined.select(*keys, "category", "kind", "amount", "entries", (F.col("amount").cast("double") / F.nullif(base, F.lit(0.0))).alias("share"))


def category_shares(cube: DataFrame, grain: str, week_start: int = fv.SATURDAY) -> DataFrame:
    start = period_start(F.col("occurred_on"), grain, week_start).alias("period_start")
    totals = cube.groupBy(start, "kind", "category").agg(F.sum("amount").alias("amount"), F.sum("entries").alias("entries"))
    return _shares(totals, ["period_start"])


def window_total(periods: DataFrame) -> DataFrame:
    total = periods.agg(
        F.min("period_start").alias("period_start"), F.max("period_end").alias("period_end"),
        *[F.sum(c).alias(c) for c in (*MONEY, "entries", "trading_days")])
    return with_margins(total)


def window_categories(cube: DataFrame) -> DataFrame:
    totals = cube.groupBy("kind", "category").agg(F.sum("amount").alias("amount"), F.sum("entries").alias("entries"))
    return _shares(totals, [])


def last_two(periods: DataFrame) -> DataFrame:
    """The newest period with the one before it, on one row as ``cur`` and ``prev``."""
    names = [c for c in periods.columns]
    newest = periods.agg(F.max("period_start").alias("cur_start"))
    earlier = periods.join(F.broadcast(newest), F.col("period_start") < F.col("cur_start")).agg(F.max("period_start").alias("prev_start"))
    row = F.struct(*[F.col(c) for c in names])
    pair = periods.join(F.broadcast(newest), F.lit(True)).join(F.broadcast(earlier), F.lit(True))
    return pair.agg(
        F.max(F.when(F.col("period_start") == F.col("cur_start"), row)).alias("cur"),
        F.max(F.when(F.col("period_start") == F.col("prev_start"), row)).alias("prev"))


def movements(periods: DataFrame) -> DataFrame:
    """Five figures, newest period against the one before; percent over the size of the earlier one."""
    lines = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"prev.{m}").alias("previous"), F.col(f"cur.{m}").alias("current"))
        for m in ("revenue", "cogs", "gross_profit", "expenses", "net_profit")])
    out = last_two(periods).where("prev is not null").select(F.inline(lines))
    previous, current = F.col("previous"), F.col("current")
    return out.withColumns({
        "difference": current - previous,
        "percent_change": (current - previous).cast("double") / F.nullif(F.abs(previous).cast("double"), F.lit(0.0)) * 100})


def ranked(base: DataFrame, label: str, kinds: tuple[str, ...], n: int = 8) -> DataFrame:
    """Top labels by amount with their share of all labelled amounts."""
    named = base.where(F.col("kind").isin(*kinds)).withColumn("label", F.trim(label)).where("label <> ''")
    sums = named.groupBy("label").agg(
        F.sum("amount_base").alias("amount"), F.count(F.lit(1)).alias("entries"),
        F.sum("quantity").alias("quantity"))
    whole = sums.agg(F.sum("amount").cast("double").alias("whole"))
    top = sums.orderBy(F.desc("amount"), "label").limit(n)
    return top.join(F.broadcast(whole), F.lit(True)).select(
        "label", "amount", "entries", F.nullif(F.col("quantity"), F.lit(0)).alias("quantity"),
        (F.col("amount").cast("double") / F.nullif(F.col("whole"), F.lit(0.0))).alias("share"))


def weekday_revenue(cube: DataFrame) -> DataFrame:
    """Seven rows, Saturday first whatever the week start."""
    sums = cube.where("kind = 'revenue'").groupBy(F.weekday("occurred_on").alias("w")).agg(F.sum("amount").alias("amount"))
    names = F.array(*[F.lit(w) for w in WEEKDAYS])
    week = cube.sparkSession.range(7).select(
        F.col("id").alias("position"), ((F.col("id") + fv.SATURDAY) % 7).cast("int").alias("w"))
    return week.join(F.broadcast(sums), "w", "left").select(
        "position", F.element_at(names, F.col("w") + 1).alias("weekday"), F.coalesce("amount", F.lit(0).cast("decimal(38,10)")).alias("amount"))


def coverage(cube: DataFrame) -> DataFrame:
    how = F.col("classified_by")

    def entries(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col("entries"))), F.lit(0))

    return cube.agg(
        F.coalesce(F.sum("entries"), F.lit(0)).alias("entries"), F.min("occurred_on").alias("first_date"),
        F.max("occurred_on").alias("last_date"), F.count_distinct("occurred_on").alias("trading_days"),
        entries(how == "unmatched").alias("uncategorised_entries"), entries(how == "weak").alias("weakly_categorised_entries"))


# ---------------------------------------------------------------- insights


def _insight(df: DataFrame, test: Column, code: Column | str, severity: str, values: dict[str, Column]) -> DataFrame:
    code = F.lit(code) if isinstance(code, str) else code
    return df.where(test).select(
        code.alias("code"), F.lit(severity).alias("severity"),
        F.to_json(F.struct(*[v.alias(k) for k, v in values.items()])).alias("values"))


def result_insight(pair: DataFrame) -> DataFrame:
    net, revenue, label = F.col("cur.net_profit"), F.col("cur.revenue"), F.col("cur.label")
    values = {"period": label, "net_profit": F.round(net.cast("double"), 2), "revenue": F.round(revenue.cast("double"), 2)}
    return _insight(pair, net < 0, "loss_making", "alert", values).unionByName(
        _insight(pair, (net > 0) & (revenue > 0), "profitable", "good", values))


def margin_insight(pair: DataFrame) -> DataFrame:
    points = (F.col("cur.gross_margin") - F.col("prev.gross_margin")) * 100
    values = {"points": F.round(points, 4)}
    return _insight(pair, points <= -fv.MARGIN_POINTS, "margin_down", "watch", values).unionByName(
        _insight(pair, points >= fv.MARGIN_POINTS, "margin_up", "good", values))


def neighbours(periods: DataFrame) -> DataFrame:
    """(period_start, earlier) of every period that has one before it; a line a period."""
    return periods.select("period_start", F.lag("period_start").over(Window.orderBy("period_start")).alias("earlier")).where("earlier is not null")


def expense_changes(categories: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cost categories that jumped or appeared from one period to another, for each of ``pairs``(period_start, earlier)."""
    amounts = categories.groupBy("period_start", "category").agg(
        F.sum(F.when(F.col("kind") != "revenue", F.col("amount"))).alias("now"), F.sum("amount").alias("was"))
    here = amounts.where("now is not null").drop("was").join(pairs, "period_start")
    before = amounts.select(F.col("period_start").alias("earlier"), "category", "was")
    both = here.join(before, ["earlier", "category"], "left").withColumn("was", F.coalesce("was", F.lit(0).cast("decimal(38,10)")))
    moved = F.col("now") - F.col("was")
    material = F.abs(moved) >= fv.MATERIAL_AMOUNT
    spike = material & (F.col("was") > 0) & (moved / F.nullif(F.col("was"), F.lit(0)) >= fv.SPIKE_RATIO)
    new = material & (F.col("was") == 0) & (F.col("now") >= fv.MATERIAL_AMOUNT)
    return both.withColumn("code", F.when(spike, "expense_spike").when(new, "new_expense")).where("code is not null").select(
        "period_start", "code", "category", F.round(F.col("was").cast("double"), 2).alias("previous"), F.round(F.col("now").cast("double"), 2).alias("current"))


def expense_insights(categories: DataFrame, pair: DataFrame) -> DataFrame:
    """Cost categories of the newest period that jumped or appeared."""
    one = pair.where("prev is not null").select(F.col("cur.period_start").alias("period_start"), F.col("prev.period_start").alias("earlier"))
    return _insight(expense_changes(categories, F.broadcast(one)), F.lit(True), F.col("code"), "watch", {c: F.col(c) for c in ("category", "previous", "current")})


def concentration_insight(top: DataFrame, code: str, share: float) -> DataFrame:
    first = top.orderBy(F.desc("amount"), "label").limit(1)
    return _insight(first, F.col("share") >= share, code, "watch", {"label": F.col("label"), "share": F.round("share", 4)})


def refund_insight(total: DataFrame) -> DataFrame:
    revenue, refunds = F.col("revenue").cast("double"), F.col("refunds").cast("double")
    rate = refunds / (revenue + refunds)
    return _insight(total, (revenue > 0) & (refunds > 0) & (rate >= fv.REFUND_RATE), "refund_rate", "watch",
                    {"rate": F.round(rate, 4), "refunds": F.round(refunds, 2)})


def uncategorised_insight(total: DataFrame) -> DataFrame:
    costs, open_ = (F.col("cogs") + F.col("expenses")).cast("double"), F.col("uncategorised").cast("double")
    share = open_ / costs
    return _insight(total, (costs > 0) & (open_ > 0) & (share >= fv.UNCATEGORISED_SHARE), "uncategorised_costs", "watch",
                    {"share": F.round(share, 4), "amount": F.round(open_, 2)})


def quiet_insight(pair: DataFrame, grain: str) -> DataFrame:
    days, silent = F.col("cur.days"), F.col("cur.days") - F.col("cur.trading_days")
    test = F.lit(grain in ("monthly", "yearly")) & (days > 7) & (F.col("cur.trading_days") > 0) & (silent >= F.greatest(F.lit(3), F.floor(days / 4)))
    return _insight(pair, test, "quiet_days", "watch", {"silent_days": silent, "days": days})


def find_insights(base: DataFrame, grain: str, window=None, week_start: int = fv.SATURDAY) -> DataFrame:
    cube = daily_cube(base)
    periods = stage(build_periods(cube, grain, window, week_start), "periods")
    pair, total = last_two(periods), window_total(periods)
    return reduce(lambda a, b: a.unionByName(b), [
        result_insight(pair), margin_insight(pair), expense_insights(category_shares(cube, grain, week_start), pair),
        concentration_insight(ranked(base, "product", ("revenue",)), "product_concentration", fv.PRODUCT_SHARE),
        concentration_insight(ranked(base, "counterparty", ("revenue",)), "customer_concentration", fv.CUSTOMER_SHARE),
        refund_insight(total), uncategorised_insight(total), quiet_insight(pair, grain)])


def finer_series(base: DataFrame, grain: str, window: tuple[dt.date, dt.date], week_start: int = fv.SATURDAY) -> DataFrame:
    """The newest period of the window, one grain finer; the comparison period stays out."""
    start = _start_of(window[1], grain, week_start)
    inside = base.where(F.col("occurred_on").between(F.lit(start.isoformat()).cast("date"), F.lit(window[1].isoformat()).cast("date")))
    return build_periods(daily_cube(inside), FINER[grain], (start, window[1]), week_start)


def asset_levy(balances: DataFrame) -> DataFrame:
    """2.5 % of stock, cash and receivables less short debts, never below zero; refuses when one is missing."""
    needed = ("inventory_value", "cash", "receivables")
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in needed]))
    money = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(18,2)")
    base = F.greatest(money("inventory_value") + money("cash") + money("receivables") - money("short_term_liabilities"), F.lit(0).cast("decimal(20,2)"))
    known = F.size(missing) == 0
    return balances.select(
        "connection_id", known.alias("computed"), missing.alias("missing"),
        F.when(known, base).otherwise(0).cast("decimal(20,2)").alias("base"),
        F.when(known, F.bround(base * F.lit(fv.ASSET_LEVY_RATE).cast("decimal(4,3)"), 2)).otherwise(0).cast("decimal(20,2)").alias("amount"))
