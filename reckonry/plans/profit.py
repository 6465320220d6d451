"""Period profit-and-loss queries over the star-schema ledger."""

import datetime as dt

from pyspark.sql import functions as F

from reckonry.operators import retail as P
from reckonry.plans.catalog import Tables, query
from reckonry.plans.ledgers import base_ledger
from reckonry.plans.staging import stage

_LEDGER = """
    with g as (
      select cast(o_orderdate as date) as d, 'revenue' as kind, case when o_orderpriority = '1-URGENT' then 'wholesale' else 'sales' end as category,
             o_totalprice as amount, 'matched' as how, o_orderpriority as account, c_name as counterparty, o_orderstatus as product, cast(null as double) as quantity
      from orders join customer on o_custkey = c_custkey
      union all
      select cast(l_shipdate as date), case l_returnflag when 'R' then 'revenue' when 'A' then 'cogs' else 'expense' end,
             case l_returnflag when 'R' then 'sales' when 'A' then 'purchases' else case when l_linestatus = 'O' then 'other_expense' else 'transport' end end,
             case when l_returnflag = 'R' then -l_extendedprice else l_extendedprice end / case when l_linenumber = 7 then 0.25 else 1 end,
             case when l_linestatus = 'O' then 'unmatched' else 'matched' end, p_brand, '', p_name, l_quantity
      from lineitem join part on l_partkey = p_partkey)"""
_FIGURES = """
    coalesce(sum(case when kind = 'revenue' then amount end), 0) as revenue, coalesce(sum(case when kind = 'revenue' and amount < 0 then -amount end), 0) as refunds,
    coalesce(sum(case when kind = 'cogs' then amount end), 0) as cogs, coalesce(sum(case when kind not in ('revenue', 'cogs') then amount end), 0) as expenses,
    count(d) as entries, count(distinct d) as trading_days, coalesce(sum(case when how = 'unmatched' and kind <> 'revenue' then amount end), 0) as uncategorised"""


def _start(grain: str) -> str:
    return {"weekly": "cast(date_trunc('week', d + 2) - interval 2 day as date)", "monthly": "cast(date_trunc('month', d) as date)",
            "yearly": "cast(date_trunc('year', d) as date)", "daily": "d"}[grain]


def _periods_cte(grain: str) -> str:
    step = {"weekly": "7 day", "monthly": "1 month", "yearly": "1 year", "daily": "1 day"}[grain]
    last = {"weekly": "s + 6", "monthly": "last_day(s)", "yearly": "cast(s + interval 1 year - interval 1 day as date)", "daily": "s"}[grain]
    return _LEDGER + f""",
    k as (select *, {_start(grain)} as s from g),
    e as (select unnest(generate_series((select min(s) from k), (select max(s) from k), interval {step}))::date as s),
    p as (select e.s, cast({last} as date) as t, {_FIGURES} from e left join k using (s) group by 1, 2),
    q as (select *, revenue - cogs as gross_profit, revenue - cogs - expenses as net_profit,
            (revenue - cogs) / nullif(revenue, 0) as gross_margin, (revenue - cogs - expenses) / nullif(revenue, 0) as net_margin, t - s + 1 as days from p)"""


_OUT = """cast(s as varchar) as period_start, cast(t as varchar) as period_end, round(revenue, 2) as revenue, round(refunds, 2) as refunds,
    round(cogs, 2) as cogs, round(expenses, 2) as expenses, entries, trading_days, round(uncategorised, 2) as uncategorised,
    round(gross_profit, 2) as gross_profit, round(net_profit, 2) as net_profit, round(gross_margin, 6) as gross_margin, round(net_margin, 6) as net_margin, days"""


def _flat(periods):
    money = [*P.MONEY, "gross_profit", "net_profit"]
    return periods.select(
        F.col("period_start").cast("string").alias("period_start"), F.col("period_end").cast("string").alias("period_end"),
        *[F.round(F.col(c).cast("double"), 2).alias(c) for c in money], "entries", "trading_days",
        *[F.round(c, 6).alias(c) for c in ("gross_margin", "net_margin")], "days")


@query("F1 F3 F4 F6", _periods_cte("weekly") + f" select {_OUT} from q")
def profit_weekly(t: Tables):
    return _flat(P.build_periods(P.daily_cube(base_ledger(t)), "weekly"))


@query("F1 F3 F4 F6", _periods_cte("monthly") + f" select {_OUT} from q")
def profit_monthly(t: Tables):
    return _flat(P.build_periods(P.daily_cube(base_ledger(t)), "monthly"))


@query("F1 F3 F4 F6", _periods_cte("daily") + f" select {_OUT} from q")
def profit_daily(t: Tables):
    return _flat(P.build_periods(P.daily_cube(base_ledger(t)), "daily"))


@query("F1 F3", _periods_cte("yearly") + " select strftime(s, '%Y') as label, round(revenue, 2) as revenue, round(revenue / days, 2) as average_daily_revenue from q")
def profit_yearly(t: Tables):
    return P.build_periods(P.daily_cube(base_ledger(t)), "yearly").select(
        "label", F.round(F.col("revenue").cast("double"), 2).alias("revenue"), F.col("average_daily_revenue").cast("double").alias("average_daily_revenue"))


@query("F4", _LEDGER + f""",
    k as (select *, {_start('monthly')} as s from g where d between date '1997-03-01' and date '1997-08-31'),
    e as (select unnest(generate_series(date '1997-01-01', date '1997-12-01', interval 1 month))::date as s)
    select strftime(e.s, '%Y-%m') as label, coalesce(round(sum(amount) filter (where kind = 'revenue'), 2), 0) as revenue, count(d) as entries
    from e left join k using (s) group by 1""")
def profit_gap_fill(t: Tables):
    """A half year of trading reported over a forced full year."""
    inside = base_ledger(t).where("occurred_on between date '1997-03-01' and date '1997-08-31'")
    return P.build_periods(P.daily_cube(inside), "monthly", (dt.date(1997, 1, 5), dt.date(1997, 12, 20))).select(
        "label", F.round(F.col("revenue").cast("double"), 2).alias("revenue"), "entries")


@query("F5", _LEDGER + f""",
    c as (select {_start('monthly')} as s, kind, category, sum(amount) as a, count(*) as n from g group by 1, 2, 3),
    w as (select s, sum(case when kind = 'revenue' then a end) as r, sum(case when kind <> 'revenue' then a end) as x from c group by 1)
    select cast(s as varchar) as period_start, category, kind, round(a, 2) as amount, n as entries, round(a / nullif(case when kind = 'revenue' then r else x end, 0), 6) as share
    from c join w using (s)""")
def category_shares(t: Tables):
    return P.category_shares(P.daily_cube(base_ledger(t)), "monthly").select(
        F.col("period_start").cast("string").alias("period_start"), "category", "kind",
        F.round(F.col("amount").cast("double"), 2).alias("amount"), "entries", F.round("share", 6).alias("share"))


@query("F7", _periods_cte("monthly") + """
    select cast(min(s) as varchar) as period_start, cast(max(t) as varchar) as period_end, round(sum(revenue), 2) as revenue, round(sum(refunds), 2) as refunds,
           round(sum(cogs), 2) as cogs, round(sum(expenses), 2) as expenses, cast(sum(entries) as bigint) as entries, cast(sum(trading_days) as bigint) as trading_days from q""")
def window_total(t: Tables):
    return _flat(P.window_total(P.build_periods(P.daily_cube(base_ledger(t)), "monthly"))).select(
        "period_start", "period_end", "revenue", "refunds", "cogs", "expenses", "entries", "trading_days")


@query("F7 F5", _LEDGER + """,
    c as (select kind, category, sum(amount) as a, count(*) as n from g group by 1, 2)
    select category, kind, round(a, 2) as amount, n as entries,
           round(a / (select sum(c2.a) from c c2 where (c2.kind = 'revenue') = (c.kind = 'revenue')), 6) as share from c""")
def window_categories(t: Tables):
    return P.window_categories(P.daily_cube(base_ledger(t))).select(
        "category", "kind", F.round(F.col("amount").cast("double"), 2).alias("amount"), "entries", F.round("share", 6).alias("share"))


@query("F8", _periods_cte("monthly") + """,
    r as (select *, row_number() over (order by s desc) as i from q), c as (select * from r where i = 1), b as (select * from r where i = 2),
    m as (select 'revenue' as metric, b.revenue as x, c.revenue as y from b, c union all select 'cogs', b.cogs, c.cogs from b, c
          union all select 'gross_profit', b.gross_profit, c.gross_profit from b, c union all select 'expenses', b.expenses, c.expenses from b, c
          union all select 'net_profit', b.net_profit, c.net_profit from b, c)
    select metric, round(x, 2) as previous, round(y, 2) as current, round(y - x, 2) as difference, round((y - x) / nullif(abs(x), 0) * 100, 4) as percent_change from m""")
def movements(t: Tables):
    return P.movements(P.build_periods(P.daily_cube(base_ledger(t)), "monthly")).select(
        "metric", *[F.round(F.col(c).cast("double"), 2).alias(c) for c in ("previous", "current", "difference")],
        F.round("percent_change", 4).alias("percent_change"))


def _rank_sql(label: str, kinds: str) -> str:
    return _LEDGER + f""",
    r as (select trim({label}) as label, sum(amount) as a, count(*) as n, sum(quantity) as x from g where kind in ({kinds}) and trim({label}) <> '' group by 1)
    select label, round(a, 2) as amount, n as entries, nullif(x, 0) as quantity, round(a / (select sum(a) from r), 6) as share from r order by a desc, label limit 8"""


def _ranked(df):
    return df.select("label", F.round(F.col("amount").cast("double"), 2).alias("amount"), "entries",
                     F.col("quantity").cast("double").alias("quantity"), F.round("share", 6).alias("share"))


@query("F9", _rank_sql("product", "'revenue'"))
def top_products(t: Tables):
    return _ranked(P.ranked(base_ledger(t), "product", ("revenue",)))


@query("F9", _rank_sql("counterparty", "'revenue'"))
def top_customers(t: Tables):
    return _ranked(P.ranked(base_ledger(t), "counterparty", ("revenue",)))


@query("F9", _rank_sql("account", "'expense', 'cogs'"))
def top_expense_accounts(t: Tables):
    return _ranked(P.ranked(base_ledger(t), "account", ("expense", "cogs")))


@query("F10", _LEDGER + """
    , w as (select (dayofweek(d) + 1) % 7 as position, sum(amount) as a from g where kind = 'revenue' group by 1)
    select p as position, ['Saturday','Sunday','Monday','Tuesday','Wednesday','Thursday','Friday'][p + 1] as weekday, round(coalesce(a, 0), 2) as amount
    from range(7) x(p) left join w on w.position = p""")
def weekday_revenue(t: Tables):
    return P.weekday_revenue(P.daily_cube(base_ledger(t))).withColumn("amount", F.round(F.col("amount").cast("double"), 2))


@query("F11", _LEDGER + """
    select count(*) as entries, cast(min(d) as varchar) as first_date, cast(max(d) as varchar) as last_date, count(distinct d) as trading_days,
           count(*) filter (where how = 'unmatched') as uncategorised_entries, count(*) filter (where how = 'weak') as weakly_categorised_entries from g""")
def ledger_coverage(t: Tables):
    return P.coverage(P.daily_cube(base_ledger(t))).withColumns({
        c: F.col(c).cast("string") for c in ("first_date", "last_date")})


_PAIR = """, r as (select *, row_number() over (order by s desc) as i from q), c as (select * from r where i = 1), b as (select * from r where i = 2)"""


def _insight_query(found):
    return found.select("code", "severity")


@query("F12", _periods_cte("monthly") + _PAIR + """
    select case when net_profit < 0 then 'loss_making' else 'profitable' end as code, case when net_profit < 0 then 'alert' else 'good' end as severity,
           strftime(s, '%Y-%m') as period, round(net_profit, 2) as net_profit from c where net_profit < 0 or (net_profit > 0 and revenue > 0)""")
def insight_result(t: Tables):
    pair = P.last_two(P.build_periods(P.daily_cube(base_ledger(t)), "monthly"))
    return P.result_insight(pair).select("code", "severity", F.get_json_object("values", "$.period").alias("period"),
                                         F.get_json_object("values", "$.net_profit").cast("double").alias("net_profit"))


@query("F13", _periods_cte("yearly") + _PAIR + """
    , m as (select (c.gross_margin - b.gross_margin) * 100 as p from b, c)
    select case when p <= -2 then 'margin_down' else 'margin_up' end as code, case when p <= -2 then 'watch' else 'good' end as severity, round(p, 4) as points
    from m where p <= -2 or p >= 2""")
def insight_margin(t: Tables):
    pair = P.last_two(P.build_periods(P.daily_cube(base_ledger(t)), "yearly"))
    return P.margin_insight(pair).select("code", "severity", F.get_json_object("values", "$.points").cast("double").alias("points"))


@query("F14", _periods_cte("monthly") + """,
    e2 as (select s, lag(s) over (order by s) as before from q),
    n as (select s, category, sum(amount) filter (kind <> 'revenue') as now, sum(amount) as a from k group by 1, 2),
    j as (select n.s, n.category, n.now, coalesce(b.a, 0) as was from n join e2 using (s) left join n b on b.s = e2.before and b.category = n.category
          where n.now is not null and e2.before is not null)
    select cast(s as varchar) as month, case when was > 0 then 'expense_spike' else 'new_expense' end as code, category, round(was, 2) as previous, round(now, 2) as current from j
    where abs(now - was) >= 50 and ((was > 0 and (now - was) / was >= 0.4) or (was = 0 and now >= 50))""")
def insight_expenses(t: Tables):
    """Every month of the whole ledger against the month before it."""
    cube = stage(P.daily_cube(base_ledger(t)), "cube")
    found = P.expense_changes(P.category_shares(cube, "monthly"), P.neighbours(P.build_periods(cube, "monthly")))
    return found.select(F.col("period_start").cast("string").alias("month"), "code", "category", "previous", "current")


@query("F15", _LEDGER + """,
    p as (select product as label, sum(amount) as a from g where kind = 'revenue' and product <> '' group by 1),
    q as (select counterparty as label, sum(amount) as a from g where kind = 'revenue' and counterparty <> '' group by 1),
    u as (select 'product_concentration' as code, label, a / (select sum(a) from p) as share, 0.40 as floor, row_number() over (order by a desc, label) as i from p
          union all select 'customer_concentration', label, a / (select sum(a) from q), 0.35, row_number() over (order by a desc, label) from q)
    select code, label, round(share, 4) as share from u where i = 1 and share >= floor""")
def insight_concentration(t: Tables):
    base = base_ledger(t)
    found = P.concentration_insight(P.ranked(base, "product", ("revenue",)), "product_concentration", 0.40).unionByName(
        P.concentration_insight(P.ranked(base, "counterparty", ("revenue",)), "customer_concentration", 0.35))
    return found.select("code", F.get_json_object("values", "$.label").alias("label"), F.get_json_object("values", "$.share").cast("double").alias("share"))


@query("F16 F17", _periods_cte("monthly") + """
    , z as (select sum(revenue) as r, sum(refunds) as b, sum(cogs) + sum(expenses) as c, sum(uncategorised) as u from q)
    select 'refund_rate' as code, round(b / (r + b), 4) as share from z where r > 0 and b > 0 and b / (r + b) >= 0.05
    union all select 'uncategorised_costs', round(u / c, 4) from z where c > 0 and u > 0 and u / c >= 0.1""")
def insight_refunds_uncategorised(t: Tables):
    total = P.window_total(P.build_periods(P.daily_cube(base_ledger(t)), "monthly"))
    a = P.refund_insight(total).select("code", F.get_json_object("values", "$.rate").cast("double").alias("share"))
    return a.unionByName(P.uncategorised_insight(total).select("code", F.get_json_object("values", "$.share").cast("double").alias("share")))


@query("F18", _periods_cte("yearly").replace("from lineitem join part on l_partkey = p_partkey)", "from lineitem join part on l_partkey = p_partkey), h as (select * from g where isodow(d) < 6)").replace("as s from g)", "as s from h)") + _PAIR + """
    select 'quiet_days' as code, days - trading_days as silent_days, days from c where days > 7 and trading_days > 0 and days - trading_days >= greatest(3, floor(days / 4))""")
def insight_quiet_days(t: Tables):
    """A shop that shuts at weekends."""
    weekdays = base_ledger(t).where(F.weekday("occurred_on") < 5)
    pair = P.last_two(P.build_periods(P.daily_cube(weekdays), "yearly"))
    return P.quiet_insight(pair, "yearly").select("code", *[F.get_json_object("values", f"$.{c}").cast("int").alias(c) for c in ("silent_days", "days")])


@query("F12 F13 F14 F15 F16 F17 F18", _periods_cte("monthly") + _PAIR + """
    , n as (select category, sum(amount) as a from k where s = (select s from c) and kind <> 'revenue' group by 1),
      o as (select category, sum(amount) as a from k where s = (select s from b) group by 1),
      j as (select n.a as now, coalesce(o.a, 0) as was from n left join o using (category)),
      pr as (select product as label, sum(amount) as a from g where kind = 'revenue' and trim(product) <> '' group by 1),
      cu as (select counterparty as label, sum(amount) as a from g where kind = 'revenue' and trim(counterparty) <> '' group by 1),
      z as (select sum(revenue) as r, sum(refunds) as f, sum(cogs) + sum(expenses) as x, sum(uncategorised) as u from q)
    select case when net_profit < 0 then 'loss_making' else 'profitable' end as code, case when net_profit < 0 then 'alert' else 'good' end as severity
      from c where net_profit < 0 or (net_profit > 0 and revenue > 0)
    union all select case when d < 0 then 'margin_down' else 'margin_up' end, case when d < 0 then 'watch' else 'good' end
      from (select (c.gross_margin - b.gross_margin) * 100 as d from b, c) where d <= -2 or d >= 2
    union all select case when was > 0 then 'expense_spike' else 'new_expense' end, 'watch' from j
      where abs(now - was) >= 50 and ((was > 0 and (now - was) / was >= 0.4) or (was = 0 and now >= 50))
    union all select 'product_concentration', 'watch' from pr having max(a) / sum(a) >= 0.4
    union all select 'customer_concentration', 'watch' from cu having max(a) / sum(a) >= 0.35
    union all select 'refund_rate', 'watch' from z where r > 0 and f > 0 and f / (r + f) >= 0.05
    union all select 'uncategorised_costs', 'watch' from z where x > 0 and u > 0 and u / x >= 0.1
    union all select 'quiet_days', 'watch' from c where days > 7 and trading_days > 0 and days - trading_days >= greatest(3, floor(days / 4))""")
def all_insights(t: Tables):
    return P.find_insights(base_ledger(t), "monthly").select("code", "severity")


@query("F19 F2", _LEDGER + f""",
    k as (select *, {_start('weekly')} as s from g where d between date '1998-02-01' and date '1998-02-28'),
    e as (select unnest(generate_series(date '1998-01-31', date '1998-02-28', interval 7 day))::date as s)
    select cast(e.s as varchar) as period_start, coalesce(round(sum(amount) filter (where kind = 'revenue'), 2), 0) as revenue, count(d) as entries
    from e left join k using (s) group by 1""")
def finer_weekly_series(t: Tables):
    window = P.reporting_window("monthly", dt.date(1998, 3, 15))
    return P.finer_series(base_ledger(t), "monthly", window).select(
        F.col("period_start").cast("string").alias("period_start"), F.round(F.col("revenue").cast("double"), 2).alias("revenue"), "entries")


@query("F20", """
    with b as (select c_custkey as k, case when c_custkey % 10 = 0 then null else cast(c_acctbal as decimal(18,2)) end as inv, cast(100.10 as decimal(18,2)) as cash,
                 case when c_custkey % 15 = 0 then null else cast(50 as decimal(18,2)) end as rec, cast(case when c_custkey % 2 = 0 then 2000 else null end as decimal(18,2)) as debt from customer),
         x as (select *, inv is not null and rec is not null as ok, greatest(inv + cash + rec - coalesce(debt, 0), 0) as base from b)
    select k as connection_id, ok as computed, concat_ws(',', case when inv is null then 'inventory_value' end, case when rec is null then 'receivables' end) as missing,
           cast(case when ok then base else 0 end as double) as base from x""")
def asset_levy(t: Tables):
    k = F.col("c_custkey")
    balances = t.customer.select(
        k.alias("connection_id"), F.when(k % 10 != 0, F.col("c_acctbal")).alias("inventory_value"), F.lit(100.10).alias("cash"),
        F.when(k % 15 != 0, F.lit(50)).alias("receivables"), F.when(k % 2 == 0, F.lit(2000)).alias("short_term_liabilities"))
    return P.asset_levy(balances).select("connection_id", "computed", F.concat_ws(",", "missing").alias("missing"), F.col("base").cast("double").alias("base"))
