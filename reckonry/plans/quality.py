"""Profiles, data-quality signals and cleaning proposals over the given tables."""

from pyspark.sql import functions as F

from reckonry.functions import fixed_values as fv
from reckonry.operators import analytics as A
from reckonry.operators import profile as D
from reckonry.operators import proposals as R
from reckonry.plans.catalog import Tables, query

ROW = "__source_row"


def _like_any(text: str, hints) -> str:
    return f"regexp_matches(lower({text}), '{'|'.join(hints)}')"


def _profile_sql(table: str, columns: list[tuple[str, str]], row: str) -> str:
    parts = []
    for i, (c, kind) in enumerate(columns):
        filled = f"count({c}) filter (where cast({c} as varchar) <> '')"
        number = kind == "number"

        def only(expr: str, wanted: bool, cast: str = "double") -> str:
            return f"cast({expr} as {cast})" if wanted else f"cast(null as {cast})"

        top = (
            f"(select string_agg(v || '=' || n, '; ' order by n desc, f, v) from (select cast({c} as varchar) as v, count(*) as n, "
            f"min({row}) as f from {table} where {c} is not null and cast({c} as varchar) <> '' group by 1 order by n desc, f, v limit 5))"
        )
        parts.append(f"""
          select {i} as position, '{c}' as "column", '{kind}' as inferred_type, count(*) as row_count,
            {filled} as non_null, count(*) - {filled} as null_count,
            count(distinct {c}) as distinct_count,
            {_like_any(f"'{c} {c}'", fv.MONEY_HINTS)} as is_money, {_like_any(f"'{c} {c}'", fv.KEY_HINTS)} as is_key,
            {only(f'round(min({c}), 2)', number)} as minimum, {only(f'round(max({c}), 2)', number)} as maximum,
            {only(f'round(sum({c}), 2)', number)} as total, {only(f'round(sum({c}) / count({c}), 4)', number)} as mean,
            {only(f'round(median({c}), 4)', number)} as median,
            count(*) filter (where {number} and try_cast({c} as double) < 0) as negative_count,
            count(*) filter (where {number} and try_cast({c} as double) = 0) as zero_count,
            {only(f"min(strftime({c}, '%Y-%m-%d'))" if kind == 'date' else 'null', kind == 'date', 'varchar')} as earliest,
            {only(f"max(strftime({c}, '%Y-%m-%d'))" if kind == 'date' else 'null', kind == 'date', 'varchar')} as latest,
            {top if kind == 'text' else 'cast(null as varchar)'} as top_values,
            count(*) filter (where {kind == 'text'} and (cast({c} as varchar) <> trim(cast({c} as varchar)) or cast({c} as varchar) like '%  %')) as whitespace_issues,
            0 as case_variants
          from {table}""")
    return " union all ".join(parts)


_ORDERS = [("o_orderkey", "number"), ("o_custkey", "number"), ("o_orderstatus", "text"),
           ("o_totalprice", "number"), ("o_orderdate", "date"), ("o_orderpriority", "text")]
_LINES = [("l_orderkey", "number"), ("l_partkey", "number"), ("l_suppkey", "number"), ("l_linenumber", "number"),
          ("l_quantity", "number"), ("l_extendedprice", "number"), ("l_discount", "number"), ("l_tax", "number"),
          ("l_returnflag", "text"), ("l_linestatus", "text"), ("l_shipdate", "date")]


def _flat_profile(profile):
    return profile.select(
        "position", "column", "inferred_type", "row_count", "non_null", "null_count", "distinct_count",
        "is_money", "is_key", "minimum", "maximum", "total", "mean", "median", "negative_count", "zero_count",
        "earliest", "latest",
        F.when(F.col("top_values").isNotNull(), F.concat_ws("; ", F.transform(
            "top_values", lambda s: F.concat(s["value"], F.lit("="), s["count"].cast("string"))))).alias("top_values"),
        "whitespace_issues", "case_variants",
    )


@query("D1 D2 D3 D4 D5 D6 D15", _profile_sql("orders", _ORDERS, "o_orderkey"))
def profile_orders(t: Tables):
    return _flat_profile(D.profile_columns(t.orders, row="o_orderkey"))


@query("D1 D2 D3 D5 D14", "select \"column\", non_null, distinct_count, total, mean, median, negative_count from ("
       + _profile_sql("lineitem", _LINES, "l_orderkey") + ")")
def profile_lineitem(t: Tables):
    return D.profile_columns(t.spread("lineitem"), row="l_orderkey").select(
        "column", "non_null", "distinct_count", "total", "mean", "median", "negative_count")


@query("D14 D6", """
    select 'l_extendedprice' as "column", round(sum(l_extendedprice), 2) as total, 0 as negatives from lineitem
    union all select 'l_tax', round(sum(l_tax), 2), 0 from lineitem""")
def money_column_totals(t: Tables):
    profile = D.profile_columns(t.lineitem.select("l_extendedprice", "l_tax", "l_returnflag", "l_quantity"), row=None)
    return D.money_totals(profile)


@query("D16 T9", """
    select 'lang' as "column", (select string_agg(lang || '=' || n, '; ' order by n desc, f) from (
        select lang, count(*) n, min(doc_id) f from documents group by 1 order by n desc, f limit 5)) as frequent, count(distinct lang) as kinds from documents
    union all
    select 'source', (select string_agg(source || '=' || n, '; ' order by n desc, f) from (
        select source, count(*) n, min(doc_id) f from documents group by 1 order by n desc, f limit 5)), count(distinct source) from documents""")
def profile_for_sharing(t: Tables):
    docs = t.documents.select(F.col("doc_id").alias(ROW), "lang", "source")
    return D.redacted_context(D.profile_columns(docs)).select(
        "column", F.concat_ws("; ", F.transform("frequent_values", lambda s: F.concat(s["value"], F.lit("="), s["count"].cast("string")))).alias("frequent"),
        F.col("distinct").alias("kinds"))


@query("A13 A14", """
    select 'o_orderstatus' as breakdown, 'none' as key_column where
      (select count(distinct o_orderstatus) from orders) < (select count(distinct o_orderpriority) from orders)
      and (select count(distinct o_orderstatus) from orders) > 1""")
def default_columns(t: Tables):
    profile = D.profile_columns(t.orders, row="o_orderkey")
    breakdown = A.breakdown_column(profile).agg(F.max("column").alias("breakdown"))
    key = A.unique_key_column(profile).agg(F.coalesce(F.max("column"), F.lit("none")).alias("key_column"))
    return breakdown.join(F.broadcast(key), F.lit(True))


@query("D7", """
    with g as (select text, count(*) n from documents group by 1 having count(*) > 1)
    select count(*) as group_count, cast(sum(n - 1) as bigint) as duplicate_rows, cast(null as double) as materiality from g""")
def duplicate_documents(t: Tables):
    return D.exact_duplicates(t.documents.select(F.col("doc_id").alias(ROW), "text"))


@query("D7", """
    with g as (select lang, source, md5(text) as digest, min(doc_id) f, count(*) n from documents group by lang, source, text having count(*) > 1)
    select f as first_row, n as copies, lang, source, digest from g order by f limit 5""")
def duplicate_document_examples(t: Tables):
    docs = t.documents.select(F.col("doc_id").alias(ROW), "lang", "source", "text")
    return D.duplicate_examples(docs).withColumn("digest", F.md5("text")).drop("text")


def _invoice_lines(t: Tables):
    """Lines keyed by an invoice reference that repeats with different content."""
    return t.lineitem.select(
        (F.col("l_orderkey") * 1000000000 + F.col("l_partkey") * 10000 + F.col("l_quantity").cast("int")).alias(ROW),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("invoice"),
        F.col("l_suppkey").alias("supplier_code"), F.col("l_extendedprice").alias("net_amount"), F.col("l_tax").alias("rate"),
    )


_INVOICES = """
    with d as (select l_orderkey || '-' || l_linenumber as invoice, l_suppkey, l_extendedprice, l_tax, count(*) as n
               from lineitem group by 1, 2, 3, 4),
         k as (select invoice, cast(sum(n) as bigint) as row_count, count(*) as versions,
                      sum(cast(round(l_extendedprice * 100) as bigint) * n) as cents
               from d group by 1 having count(*) > 1)"""


@query("D8", _INVOICES + """
    select count(*) as group_count, cast(sum(row_count) as bigint) as affected_rows, cast(sum(cents) as double) / 100 as materiality from k""")
def invoice_key_conflicts(t: Tables):
    return D.key_conflict_summary(_invoice_lines(t), "invoice")


@query("D8", _INVOICES + " select invoice, row_count, versions from k")
def invoice_key_conflict_list(t: Tables):
    return D.key_conflicts(_invoice_lines(t), "invoice").select("invoice", "row_count", "versions")


def respelled_suppliers(t: Tables):
    """Each brand typed four ways across the lines that sell it."""
    style = F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(5))
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    brand = F.regexp_replace("p_brand", "#", " ")
    name = (
        F.when(style <= 1, F.concat(brand, F.lit(" Ltd")))
        .when(style == 2, F.concat(F.upper(brand), F.lit(" LIMITED")))
        .when(style == 3, F.lower(brand)).otherwise(F.concat(brand, F.lit(".")))
    )
    return lines.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias(ROW), name.alias("supplier"),
        F.col("p_type").alias("kind"), F.col("l_extendedprice").alias("net_amount"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("vat"), F.col("l_shipdate").cast("date").alias("day"),
    )


_RESPELLED = """
    with s as (
      select case when (l_orderkey + l_linenumber) % 5 <= 1 then replace(p_brand, '#', ' ') || ' Ltd'
                  when (l_orderkey + l_linenumber) % 5 = 2 then upper(replace(p_brand, '#', ' ')) || ' LIMITED'
                  when (l_orderkey + l_linenumber) % 5 = 3 then lower(replace(p_brand, '#', ' '))
                  else replace(p_brand, '#', ' ') || '.' end as value,
             lower(replace(p_brand, '#', ' ')) as key, l_orderkey * 10 + l_linenumber as r,
             cast(round(l_extendedprice * 100) as bigint) as cents
      from lineitem join part on l_partkey = p_partkey),
    v as (select key, value, count(*) as n, min(r) as f, sum(cents) as cents from s group by 1, 2),
    w as (select *, first_value(value) over (partition by key order by n desc, f) as suggested from v)"""


@query("D9", _RESPELLED + ' select \'supplier\' as "column", key, value, n, suggested from w')
def entity_spellings(t: Tables):
    data = respelled_suppliers(t)
    return D.entity_spellings(data, ["supplier", "kind"]).select("column", "key", "value", "n", "suggested")


@query("D9", _RESPELLED + """
    select 'supplier' as "column", count(distinct key) as group_count, cast(sum(n) as bigint) as affected_rows,
           count(*) filter (where value <> suggested) as respelled from w""")
def entity_variant_summary(t: Tables):
    return D.entity_variants(D.entity_spellings(respelled_suppliers(t), ["supplier", "kind"]))


@query("D10", """
    with sums as (select cast(sum(cast(round(o_totalprice * 100) as bigint)) as double) / 100 as s from orders)
    select 'total' as "column", s as computed, round(s - 0.25, 2) as declared, 0.25 as difference, false as reconciles, 0 as source_row from sums
    union all select 'orders', count(*), count(*), 0, true, 0 from orders""")
def declared_totals_check(t: Tables):
    """A stated grand total, short by 25p, beside a stated count that agrees."""
    cents = (F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / 100.0).alias("total")
    wide = t.orders.agg(cents, F.count(F.lit(1)).cast("double").alias("orders"))
    computed = wide.unpivot([], ["total", "orders"], "column", "computed")
    stated = wide.select(F.round(F.col("total") - 0.25, 2).alias("total"), "orders").unpivot(
        [], ["total", "orders"], "column", "declared").withColumn("source_row", F.lit(0))
    return D.declared_totals(computed, stated)


@query("D11", """
    select rate, count(*) as row_count, count(*) filter (where not (abs(rate - 0.05) < 0.005 or abs(rate - 0.2) < 0.005 or abs(rate) < 0.005)) as anomalies
    from (select round(round(l_extendedprice * l_tax, 2) / l_extendedprice, 4) as rate from lineitem where l_extendedprice <> 0)
    group by 1""")
def tax_rate_distribution(t: Tables):
    data = t.lineitem.select(F.col("l_extendedprice").alias("net"), F.round(F.col("l_extendedprice") * F.col("l_tax"), 2).alias("tax"))
    return D.rate_distribution(data, "net", "tax", n=None)


@query("D11", """
    select count(*) as row_count, count(*) filter (where rate_ok) as standard
    from (select least(abs(l_tax), abs(l_tax - 0.02), abs(l_tax - 0.04)) < 0.005 as rate_ok from lineitem where l_quantity <> 0)""")
def tax_rates_with_own_list(t: Tables):
    data = t.lineitem.select(F.lit(1.0).alias("net"), F.col("l_tax").alias("tax"))
    return D.row_rates(data, "net", "tax", rates=(0.0, 0.02, 0.04)).agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if("is_standard").alias("standard"))


@query("D12", """
    select cast(min(cast(l_shipdate as date)) as varchar) as earliest, cast(max(cast(l_shipdate as date)) as varchar) as latest,
           count(distinct strftime(l_shipdate, '%Y-%m')) as distinct_months, true as spans_multiple_months from lineitem""")
def ship_date_coverage(t: Tables):
    return D.date_coverage(t.lineitem, "l_shipdate")


@query("D12", "select strftime(l_shipdate, '%Y-%m') as month, count(*) as row_count from lineitem where l_shipdate is not null group by 1")
def ship_date_months(t: Tables):
    return D.date_months(t.lineitem, "l_shipdate")


def _fence_sql(table: str, column: str) -> str:
    return f"""
    with c as (select count({column}) as n from {table}),
         r as (select row_number() over (order by {column}) as i, {column} as v from {table} where {column} is not null),
         p as (select n, (n + 1) * 0.25 as a, (n + 1) * 0.75 as b from c),
         q as (select (select v from r where i = floor(a)) + (a - floor(a)) * ((select v from r where i = ceil(a)) - (select v from r where i = floor(a))) as q1,
                      (select v from r where i = floor(b)) + (b - floor(b)) * ((select v from r where i = ceil(b)) - (select v from r where i = floor(b))) as q3 from p),
         f as (select q1, q3, q1 - 3 * (q3 - q1) as low, q3 + 3 * (q3 - q1) as high from q)"""


@query("D13", _fence_sql("events", "value") + """
    select 'value' as "column", count(*) as outliers, round(any_value(low), 2) as low, round(any_value(high), 2) as high,
           cast(sum(cast(round(abs(value) * 100) as bigint)) as double) / 100 as materiality
    from events, f where value < low or value > high having count(*) > 0""")
def event_value_outliers(t: Tables):
    return D.outlier_summary(t.events.select(F.col("event_id").alias(ROW), "value"), ["value"])


@query("D13", _fence_sql("events", "value") + """ select round(q1, 4) as q1, round(q3, 4) as q3, round(low, 4) as low, round(high, 4) as high from f""")
def event_value_quartiles(t: Tables):
    return D.outlier_bounds(t.events, ["value"]).select(*[F.round(c, 4).alias(c) for c in ("q1", "q3", "low", "high")])


@query("R1 R2 R3 R6 R7 R8 R9 D7 D8 D9 D11", _RESPELLED + """
    , tax as (select cast(round(l_extendedprice * 100) as bigint) as cents, round(l_extendedprice * l_tax / l_extendedprice, 4) as rate from lineitem),
    dup as (select (n - 1) * cents as m, n - 1 as extra from (
              select r, value, p_type, l_extendedprice, l_tax, day, count(*) as n, any_value(cents) as cents
              from (select case when (l_orderkey + l_linenumber) % 5 <= 1 then replace(p_brand, '#', ' ') || ' Ltd'
                     when (l_orderkey + l_linenumber) % 5 = 2 then upper(replace(p_brand, '#', ' ')) || ' LIMITED'
                     when (l_orderkey + l_linenumber) % 5 = 3 then lower(replace(p_brand, '#', ' '))
                     else replace(p_brand, '#', ' ') || '.' end as value, 1 as r, p_type, l_extendedprice, l_tax,
                     cast(l_shipdate as date) as day, cast(round(l_extendedprice * 100) as bigint) as cents
                    from lineitem join part on l_partkey = p_partkey) group by 1, 2, 3, 4, 5, 6 having count(*) > 1))
    select 'entity:supplier' as group_key, 'map_values' as step_type, 'medium' as confidence,
           cast(sum(n) as bigint) as affected_rows, cast(sum(cents) as double) / 100 as materiality from w where value <> suggested
    union all
    select 'vat:rate_anomaly', 'review_vat_rate', 'medium', count(*), cast(sum(cents) as double) / 100 from tax
     where not (abs(rate - 0.05) < 0.005 or abs(rate - 0.2) < 0.005 or abs(rate) < 0.005)
    union all
    select 'duplicates:exact', 'drop_duplicate_rows', 'medium', cast(sum(extra) as bigint), cast(sum(m) as double) / 100 from dup having count(*) > 0""")
def proposals_for_lines(t: Tables):
    """Everything the signals propose for the respelled supplier lines, ranked."""
    found = R.build_proposals(respelled_suppliers(t))
    return found.where("confidence = 'medium'").select("group_key", "step_type", "confidence", "affected_rows", "materiality")


def _one_month(t: Tables):
    """Orders booked into August, one in twenty straying into another month."""
    k = F.col("o_orderkey")
    day = F.date_add(F.lit("2026-08-01").cast("date"), F.pmod(k, F.lit(28)).cast("int"))
    stray = F.add_months(day, F.when(k % 40 == 0, -5).otherwise(2))
    return t.orders.select(
        k.alias(ROW), F.when(k % 20 == 0, stray).otherwise(day).alias("booked"), F.date_format(day, "dd/MM/yyyy").alias("__raw_booked"),
        F.col("o_totalprice").alias("net_amount"))


@query("R4 R7", """
    select 'date_ambiguity:booked' as group_key, 'review_ambiguous_dates' as step_type, 'booked' as column_name, 'medium' as confidence,
           count(*) as affected_rows, cast(sum(cast(round(o_totalprice * 100) as bigint)) as double) / 100 as materiality
    from orders where o_orderkey % 20 = 0 having count(*) > 0""")
def stray_date_proposal(t: Tables):
    found = R.stray_dates(_one_month(t), "booked", ambiguous=1, order="dmy")
    return found.select("group_key", "step_type", "column_name", "confidence", "affected_rows", "materiality")


@query("R4", """
    select o_orderkey as source_row, strftime(date '2026-08-01' + cast(o_orderkey % 28 as integer), '%d/%m/%Y') as raw,
           case when o_orderkey % 40 = 0 then '2026-03' else '2026-10' end as month from orders where o_orderkey % 20 = 0""")
def stray_date_rows(t: Tables):
    return R.stray_date_rows(_one_month(t), "booked").select("source_row", "raw", F.substring("read_as", 1, 7).alias("month"))


@query("R5 D10", """
    select 'invariant:declared_totals' as group_key, 'block_totals_mismatch' as step_type, 'low' as confidence, 0 as affected_rows, 0.25 as materiality
    where (select count(*) from orders) > 0""")
def totals_mismatch_proposal(t: Tables):
    found = R.totals_mismatch(declared_totals_check(t))
    return found.select("group_key", "step_type", "confidence", "affected_rows", "materiality")
