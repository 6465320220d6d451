"""Period comparison, headline figures and reconciliation queries."""

from pyspark.sql import functions as F

from reckonry.operators import analytics as A
from reckonry.plans.catalog import Tables, query
from reckonry.plans.sums import money_sum

Y96, Y97 = ("1996-01-01", "1996-12-31"), ("1997-01-01", "1997-12-31")

_SUMS = """
    sum(case when cast(o_orderdate as date) between date '1996-01-01' and date '1996-12-31'
             then cast(round(o_totalprice * 100) as bigint) else 0 end) as a,
    sum(case when cast(o_orderdate as date) between date '1997-01-01' and date '1997-12-31'
             then cast(round(o_totalprice * 100) as bigint) else 0 end) as b"""
_CHANGE = """cast(a as double) / 100 as total_a, cast(b as double) / 100 as total_b,
    cast(b - a as double) / 100 as difference,
    round(cast(b - a as double) / nullif(cast(a as double), 0) * 100, 2) as percent_change"""


@query("A1 A3", f"select {_CHANGE} from (select {_SUMS} from orders)")
def period_totals(t: Tables):
    return A.compare_totals(t.orders, "o_orderdate", "o_totalprice", Y96, Y97)


@query("A2 A3", f"""
    select label, {_CHANGE} from (
      select o_orderpriority as label, {_SUMS} from orders group by 1)
    order by abs(b - a) desc, label limit 3""")
def period_drivers(t: Tables):
    return A.compare_drivers(t.orders, "o_orderdate", "o_totalprice", Y96, Y97, "o_orderpriority", top_n=3)


@query("A2", f"""
    select label, {_CHANGE} from (
      select o_custkey as label, {_SUMS} from orders group by 1)
    order by abs(b - a) desc, label limit 5""")
def period_customer_drivers(t: Tables):
    return A.compare_drivers(t.orders, "o_orderdate", "o_totalprice", Y96, Y97, "o_custkey")


@query("A4", " union all ".join(f"""
    select count(*) as row_count, '{c}' as "column",
      cast(sum(cast(round({c} * 100) as bigint)) as double) / 100 as total,
      round(cast(sum(cast(round({c} * 100) as bigint)) as double) / (100 * count({c})), 2) as average,
      min({c}) as minimum, max({c}) as maximum, count(*) filter (where {c} < 0) as negative_rows
    from lineitem""" for c in ("l_extendedprice", "l_quantity")))
def kpi_money_columns(t: Tables):
    return A.money_kpis(t.lineitem, ["l_extendedprice", "l_quantity", "not_a_column"])


@query("A5", """
    select cast(min(cast(o_orderdate as date)) as varchar) as earliest,
           cast(max(cast(o_orderdate as date)) as varchar) as latest,
           count(distinct strftime(o_orderdate, '%Y-%m')) as distinct_months from orders""")
def kpi_date_span(t: Tables):
    return A.date_span(t.orders, "o_orderdate")


@query("A6", """
    select l_suppkey as label, cast(sum(cast(round(l_extendedprice * 100) as bigint)) as double) / 100 as total,
           count(*) as row_count
    from lineitem group by 1 order by abs(total) desc, label limit 10""")
def kpi_top_breakdown(t: Tables):
    return A.top_breakdown(t.lineitem, "l_suppkey", "l_extendedprice")


_MONTHLY = """
    select strftime(o_orderdate, '%Y-%m') as month,
           cast(sum(cast(round(o_totalprice * 100) as bigint)) as double) / 100 as total,
           count(*) as row_count
    from orders where o_orderdate is not null group by 1"""


@query("A7", _MONTHLY)
def kpi_monthly_series(t: Tables):
    return A.monthly_series(t.orders, "o_orderdate", "o_totalprice")


@query("A8", f"""
    with m as (select *, row_number() over (order by month desc) as n from ({_MONTHLY})),
         p as (select max(case when n = 2 then month end) as month_a, max(case when n = 1 then month end) as month_b,
                      max(case when n = 2 then total end) as total_a, max(case when n = 1 then total end) as total_b
               from m where n <= 2)
    select *, round(total_b - total_a, 2) as difference,
           round((total_b - total_a) / nullif(total_a, 0) * 100, 2) as percent_change from p""")
def latest_two_months(t: Tables):
    return A.latest_months(t.orders, "o_orderdate", "o_totalprice")


@query("A8 A9", """
    with m as (
      select strftime(o_orderdate, '%Y-%m') as month,
             cast(sum(cast(round(o_totalprice * 100) as bigint)) as double) / 100 as total
      from (select o_orderkey, o_totalprice, o_orderdate from orders where o_orderdate >= timestamp '1998-01-01'
            union all
            select o_orderkey, o_totalprice, o_orderdate from orders where o_orderdate < timestamp '1998-01-01')
      group by 1)
    select month, total from m""")
def union_of_versions(t: Tables):
    """Two versions of one dataset that share only some columns."""
    new = t.orders.where("o_orderdate >= timestamp '1998-01-01'").drop("o_orderstatus")
    old = t.orders.where("o_orderdate < timestamp '1998-01-01'").drop("o_orderpriority", "o_custkey")
    both = A.union_shared(new, old)
    return A.monthly_series(both, "o_orderdate", "o_totalprice").drop("row_count")


def _books(t: Tables):
    """Orders against the sum of their lines."""
    orders = t.orders.select(F.col("o_orderkey").alias("ref"), F.col("o_totalprice").alias("amount"))
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("ref")).agg(
        money_sum(F.col("l_extendedprice")).alias("amount")
    )
    return orders, lines


_BOOKS = """
    with a as (select o_orderkey as ref, o_totalprice as amount from orders),
         b as (select l_orderkey as ref, cast(sum(cast(round(l_extendedprice * 100) as bigint)) as double) / 100 as amount
               from lineitem group by 1)"""


@query("A10", _BOOKS + """
    select a.ref, a.amount as amount_a, b.amount as amount_b, round(a.amount - b.amount, 2) as difference,
           1 as pairs, false as many_to_many
    from a join b on a.ref = b.ref""")
def reconcile_order_lines(t: Tables):
    a, b = _books(t)
    return A.reconcile_matched(a, b, ["ref"], "amount").withColumn("difference", F.round("difference", 2))


@query("A11", _BOOKS + """
    select 'a' as side, a.ref, a.amount from a where not exists (select 1 from b where b.ref = a.ref)
    union all
    select 'b', b.ref, b.amount from b where not exists (select 1 from a where a.ref = b.ref)""")
def reconcile_unmatched(t: Tables):
    a, b = _books(t)
    return (
        A.reconcile_only(a, b, ["ref"], "amount").select(F.lit("a").alias("side"), "ref", "amount")
        .unionByName(A.reconcile_only(b, a, ["ref"], "amount").select(F.lit("b").alias("side"), "ref", "amount"))
    )


def _perturbed(t: Tables):
    """A second ledger: some orders missing, some off by a little, some extra."""
    a = t.orders.select(F.col("o_orderkey").alias("ref"), F.col("o_totalprice").alias("amount"))
    k = F.col("ref")
    b = a.where(k % 7 != 3).select(
        F.when(k % 11 == 5, k + 100000000).otherwise(k).alias("ref"),
        F.when(k % 5 == 0, F.col("amount") + 4.2).otherwise(F.col("amount")).alias("amount"),
    )
    return a, b


_PERTURBED = """
    with a as (select o_orderkey as ref, o_totalprice as amount from orders),
         b as (select case when ref % 11 = 5 then ref + 100000000 else ref end as ref,
                      case when ref % 5 = 0 then amount + 4.2 else amount end as amount
               from a where ref % 7 <> 3)"""
_BUCKETS = """
    , m as (select a.amount - b.amount as d, cast(round(a.amount * 100) as bigint)
                   - cast(round(b.amount * 100) as bigint) as c from a join b on a.ref = b.ref)
    select (select count(*) from m where coalesce(abs(d), 0) <= 0.01) as matched,
           (select count(*) from m where abs(d) > 0.01) as matched_with_difference,
           (select count(*) from a where not exists (select 1 from b where b.ref = a.ref)) as only_in_a,
           (select count(*) from b where not exists (select 1 from a where b.ref = a.ref)) as only_in_b,
           (select cast(coalesce(sum(c), 0) as double) / 100 from m where abs(d) > 0.01) as difference_total,
           (select cast(coalesce(sum(cast(round(amount * 100) as bigint)), 0) as double) / 100 from a
             where not exists (select 1 from b where b.ref = a.ref)) as unmatched_value_a,
           (select cast(coalesce(sum(cast(round(amount * 100) as bigint)), 0) as double) / 100 from b
             where not exists (select 1 from a where b.ref = a.ref)) as unmatched_value_b"""


@query("A12", _PERTURBED + _BUCKETS)
def reconcile_buckets(t: Tables):
    a, b = _perturbed(t)
    return A.reconcile_summary(a, b, ["ref"], "amount")


@query("A12 A10", """
    with a as (select l_suppkey as ref, l_extendedprice as amount from lineitem where l_returnflag = 'A'),
         b as (select l_suppkey as ref, l_extendedprice as amount from lineitem where l_returnflag = 'R')"""
       + _BUCKETS)
def reconcile_repeated_keys(t: Tables):
    """Every key repeats on both sides: counts cover all pairs though none is built."""
    side = t.lineitem.select(F.col("l_suppkey").alias("ref"), F.col("l_extendedprice").alias("amount"), "l_returnflag")
    return A.reconcile_summary(
        side.where("l_returnflag = 'A'").drop("l_returnflag"),
        side.where("l_returnflag = 'R'").drop("l_returnflag"), ["ref"], "amount")


_RETURNS = """
    with a as (select l_partkey as ref, l_discount as amount from lineitem where l_returnflag = 'A'),
         b as (select l_partkey as ref, l_discount as amount from lineitem where l_returnflag = 'R')"""


def _returns(t: Tables):
    side = t.lineitem.select(F.col("l_partkey").alias("ref"), F.col("l_discount").alias("amount"), "l_returnflag")
    return [side.where(F.col("l_returnflag") == flag).drop("l_returnflag") for flag in ("A", "R")]


@query("A10", _RETURNS + """
    , p as (select a.ref, a.amount as amount_a, b.amount as amount_b, count(*) as pairs from a join b on a.ref = b.ref group by 1, 2, 3),
      k as (select ref, count(distinct amount_a) > 1 and count(distinct amount_b) > 1 as many_to_many from p group by 1)
    select ref, amount_a, amount_b, round(amount_a - amount_b, 2) as difference, pairs, many_to_many from p join k using (ref)""")
def reconcile_repeated_lines(t: Tables):
    """Every pair of rows of a repeated key, equal ones as one counted line."""
    return A.reconcile_matched(*_returns(t), ["ref"], "amount").withColumn("difference", F.round("difference", 2))


@query("A10", _RETURNS + """
    , s as (select ref, count(*) as n, count(distinct amount) as kinds, sum(cast(round(amount * 100) as bigint)) as c, 'a' as side from a group by 1
            union all select ref, count(*), count(distinct amount), sum(cast(round(amount * 100) as bigint)), 'b' from b group by 1)
    select x.ref, x.n * y.n as pairs, round(cast(x.c * y.n as double) / 100, 2) as amount_a, round(cast(y.c * x.n as double) / 100, 2) as amount_b
    from s x join s y on x.ref = y.ref and x.side = 'a' and y.side = 'b' where x.kinds > 1 and y.kinds > 1""")
def reconcile_repeated_totals(t: Tables):
    return A.reconcile_matched(*_returns(t), ["ref"], "amount", totals=True).where("many_to_many").select("ref", "pairs", "amount_a", "amount_b")


@query("A12", _RETURNS + """
    , m as (select a.amount - b.amount as d, cast(round(a.amount * 100) as bigint) - cast(round(b.amount * 100) as bigint) as c from a join b on a.ref = b.ref)
    select count(*) filter (abs(d) <= 0.04) as matched, count(*) filter (abs(d) > 0.04) as matched_with_difference,
           round(cast(coalesce(sum(c) filter (abs(d) > 0.04), 0) as double) / 100, 2) as difference_total from m""")
def reconcile_wide_tolerance(t: Tables):
    """Differences that fall on the tolerance itself count as doubles have them."""
    return A.reconcile_summary(*_returns(t), ["ref"], "amount", 0.04).select("matched", "matched_with_difference", "difference_total")


@query("A12", _PERTURBED + """
    select * from (select 'differing' as bucket, a.ref, a.amount as amount_a, b.amount as amount_b
      from a join b on a.ref = b.ref where abs(a.amount - b.amount) > 0.01 order by a.ref limit 10)
    union all select * from (select 'only_in_a', ref, amount, null from a
      where not exists (select 1 from b where b.ref = a.ref) order by ref limit 10)
    union all select * from (select 'only_in_b', ref, null, amount from b
      where not exists (select 1 from a where b.ref = a.ref) order by ref limit 10)""")
def reconcile_bucket_examples(t: Tables):
    a, b = _perturbed(t)
    return A.reconcile_examples(a, b, ["ref"], "amount")
