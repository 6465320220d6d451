"""Sheets built from the given tables: one messy workbook per customer."""

from functools import reduce

from pyspark.sql import Window, functions as F

from reckonry.operators import grid as G
from reckonry.operators import profile as D
from reckonry.plans.catalog import Tables, query


def customer_sheets(t: Tables):
    """Title, blank row, header on row 4, orders, blank, total, footnote - per customer."""
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    price = F.format_number("o_totalprice", 2)
    style = F.col("o_orderkey") % 3
    money = F.when(style == 0, price).when(style == 1, F.concat(F.lit("£"), price)).otherwise(F.concat(F.lit("("), price, F.lit(")")))
    text = lambda *v: F.array(*[x if not isinstance(x, (str, type(None))) else F.lit(x).cast("string") for x in v])
    row = lambda no, cells: F.struct(no.cast("int").alias("source_row"), cells.alias("cells"))
    data = o.select(
        F.concat(F.lit("customer-"), F.col("o_custkey")).alias("file"), F.lit("Orders").alias("sheet"), (place + 4).cast("int").alias("source_row"),
        text(F.date_format("o_orderdate", "dd/MM/yyyy"), F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string")), F.col("o_orderpriority"), money, F.col("o_orderstatus")).alias("cells"))
    n = F.col("n")
    frame = o.groupBy("o_custkey", "c_name").agg(
        F.count(F.lit(1)).alias("n"), (F.sum(F.round(F.col("o_totalprice") * 100).cast("long") * F.when(F.col("o_orderkey") % 3 == 2, -1).otherwise(1)) / 100.0).alias("total"))
    none = [None] * 4
    rows = F.array(
        row(F.lit(1), text(F.col("c_name"), *none)), row(F.lit(2), text("Order export", *none)), row(F.lit(3), text(None, *none)),
        row(F.lit(4), text("Date", "Order No", "Priority", "Net Sales", "Status")), row(n + 5, text("", *none)),
        row(n + 6, text("TOTAL", None, None, F.format_number("total", 2), None)), row(n + 7, text(None, *none)),
        row(n + 8, text("* Prices exclude delivery and any goods sent back later.", *none)))
    around = frame.select(F.concat(F.lit("customer-"), F.col("o_custkey")).alias("file"), F.lit("Orders").alias("sheet"), F.inline(rows))
    return data.unionByName(around)


_N = "(select o_custkey as k, count(*) as n from orders group by 1)"


@query("P1 P2 P3 P4 P5", f"select 'customer-' || k as file, 'Orders' as sheet, 4 as header_row, 0 as first_col, 4 as last_col from {_N}")
def sheet_headers(t: Tables):
    return G.find_headers(customer_sheets(t)).select("file", "sheet", "header_row", "first_col", "last_col")


#: The sheets cell by cell, and each part of the score by joining a candidate to the rows beneath it.
_SCORES = """
    with o as (select 'customer-' || o_custkey as file, c_name, row_number() over (partition by o_custkey order by o_orderkey) as i, o_orderkey, o_orderdate, o_orderpriority, o_orderstatus
               from orders join customer on o_custkey = c_custkey),
    n as (select file, c_name, count(*) as n from o group by 1, 2),
    cells as (
      select file, i + 4 as r, 0 as c, strftime(o_orderdate, '%d/%m/%Y') as text, 'date' as shape from o
      union all select file, i + 4, 1, 'ORD-' || o_orderkey, 'short_text' from o
      union all select file, i + 4, 2, o_orderpriority, 'short_text' from o
      union all select file, i + 4, 3, 'price', 'number' from o
      union all select file, i + 4, 4, o_orderstatus, 'short_text' from o
      union all select file, 1, 0, c_name, 'short_text' from n
      union all select file, 2, 0, 'Order export', 'short_text' from n
      union all select file, 4, h.c, h.text, 'short_text' from n, (values (0, 'Date'), (1, 'Order No'), (2, 'Priority'), (3, 'Net Sales'), (4, 'Status')) h(c, text)
      union all select file, n + 6, 0, 'TOTAL', 'short_text' from n
      union all select file, n + 6, 3, 'total', 'number' from n
      union all select file, n + 8, 0, '* Prices exclude delivery and any goods sent back later.', 'long_text' from n),
    head as (select *, shape in ('short_text', 'long_text') and length(text) <= 60 and regexp_matches(text, '[A-Za-z]') as likely, count(*) over (partition by file, r) as filled
             from cells where r <= 101),
    rows as (select distinct file, r, filled from head),
    beneath as (select a.file, a.r, b.r as s, b.filled from rows a join rows b on a.file = b.file and b.r between a.r + 1 and a.r + 60 where a.r <= 40),
    near as (select file, r, count(*) filter (s <= r + 10) as rows_beneath, count(*) filter (filled > 1) as wide_rows from beneath group by 1, 2),
    modal as (select file, r, arg_max(filled, k) as body_width from (
      select file, r, filled, {'n': count(*), 'first': -min(s)} as k from beneath where filled > 1 group by 1, 2, 3) group by 1, 2),
    spots as (select a.file, a.r, b.c from rows a join (select distinct file, c from head) b using (file) where a.r <= 40),
    below as (select p.file, p.r, p.c, count(*) filter (h.filled > 1) as used, count(*) filter (h.r <= p.r + 10) as near_cells,
                count(*) filter (h.r <= p.r + 10 and h.shape in ('number', 'date')) as near_typed, count(*) filter (h.r <= p.r + 20) as seen
              from spots p join head h on h.file = p.file and h.c = p.c and h.r between p.r + 1 and p.r + 60 group by 1, 2, 3),
    common as (select file, r, c, arg_max(shape, k) as common from (
      select p.file, p.r, p.c, h.shape, {'n': count(*), 'first': -min(h.r)} as k from spots p join head h on h.file = p.file and h.c = p.c and h.r between p.r + 1 and p.r + 20
      group by 1, 2, 3, 4) group by 1, 2, 3),
    parts as (select p.file, p.r, count(h.text) as cells, count(*) filter (h.likely) as likely, count(distinct lower(h.text)) as labels,
        count(*) filter (coalesce(used, 0) >= greatest(1, wide_rows // 5)) as body_cols,
        count(*) filter (h.text is not null and coalesce(used, 0) >= greatest(1, wide_rows // 5)) as covered,
        count(*) filter (h.text is not null and coalesce(used, 0) < greatest(1, wide_rows // 5)) as surplus,
        coalesce(sum(near_cells), 0) as near_cells, coalesce(sum(near_typed), 0) as near_typed,
        count(*) filter (h.text is not null and seen >= 3) as judged, count(*) filter (h.text is not null and seen >= 3 and h.shape <> common) as differing
      from spots p join near using (file, r) left join head h on h.file = p.file and h.r = p.r and h.c = p.c
      left join below b on b.file = p.file and b.r = p.r and b.c = p.c left join common k on k.file = p.file and k.r = p.r and k.c = p.c group by 1, 2),
    ratios as (select p.file, p.r, likely / cells as header_ratio, labels / cells as distinct_ratio,
        case when body_cols > 0 then covered / body_cols * (1 - 0.3::double * (surplus / cells)) else 1 - least(1, abs(cells - body_width) / body_width) end as width_match,
        case when near_cells > 0 then near_typed / near_cells else 0 end as typed_contrast, case when judged > 0 then differing / judged else 0 end as column_contrast
      from parts p join near using (file, r) join modal using (file, r) where cells >= 2 and body_width >= 2 and rows_beneath > 0),
    raw as (select *, 0.25::double * header_ratio + 0.15::double * distinct_ratio + 0.2::double * width_match + 0.15::double * least(1, typed_contrast * 1.5::double)
        + 0.25::double * column_contrast as raw from ratios)
    select file, 'Orders' as sheet, r as header_row, round(header_ratio, 9) as header_ratio, round(distinct_ratio, 9) as distinct_ratio, round(width_match, 9) as width_match,
      round(typed_contrast, 9) as typed_contrast, round(column_contrast, 9) as column_contrast,
      round(if(typed_contrast < 0.05 and header_ratio > 0.9 and column_contrast < 0.5, raw * 0.4::double, raw), 9) as score from raw"""


@query("P2 P3 P4", _SCORES)
def sheet_header_scores(t: Tables):
    parts = ("header_ratio", "distinct_ratio", "width_match", "typed_contrast", "column_contrast", "score")
    return G.header_scores(customer_sheets(t)).withColumns({c: F.round(c, 9) for c in parts})


@query("P6 P7 P8", f"""
    select kind, cast(sum(c) as bigint) as n from (
      select unnest(['header', 'above_header', 'subtotal', 'footnote', 'data', 'blank']) as kind, unnest([1, 2, 1, 1, n, 3]) as c from {_N}) group by 1""")
def sheet_row_kinds(t: Tables):
    cells = customer_sheets(t)
    return G.classify_rows(cells, G.find_headers(cells)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("P9 P10 P11", """
    with o as (select o_custkey as k, count(*) as n, count(*) filter (where day(o_orderdate) <= 12) as amb, max(case when o_orderkey % 3 = 1 then 1 else 0 end) as cur,
                 max(case when o_orderkey % 3 = 2 then 1 else 0 end) as par, max(case when o_totalprice >= 1000 then 1 else 0 end) as thou from orders group by 1)
    select 'customer-' || k as file, 0 as position, 'date' as "column", 'date' as inferred_type, n as non_null, 'dmy' as date_order, '' as number_styles, amb as ambiguous_dates from o
    union all select 'customer-' || k, 1, 'order_no', 'text', n, null, '', 0 from o
    union all select 'customer-' || k, 2, 'priority', 'text', n, null, '', 0 from o
    union all select 'customer-' || k, 3, 'net_sales', 'number', n, null, concat_ws('|', case when cur = 1 then 'currency' end, case when par = 1 then 'parentheses' end, case when thou = 1 then 'thousands' end), 0 from o
    union all select 'customer-' || k, 4, 'status', 'text', n, null, '', 0 from o""")
def sheet_columns(t: Tables):
    book = G.Workbooks(customer_sheets(t))
    return book.columns.select("file", "position", "column", "inferred_type", "non_null", "date_order", F.concat_ws("|", "number_styles").alias("number_styles"), "ambiguous_dates")


@query("P12", """
    select o_orderkey as order_no, cast(o_orderdate as date)::varchar as date, case when o_orderkey % 3 = 2 then -o_totalprice else o_totalprice end as net_sales, o_orderstatus as status from orders""")
def sheet_tables(t: Tables):
    """The sheets of every shape as one typed table each, laid together."""
    book = G.Workbooks(customer_sheets(t))
    tables = [book.table(signature=shape).select(
        F.regexp_replace("order_no", "ORD-", "").cast("long").alias("order_no"), F.col("date").cast("string").alias("date"), "net_sales", "status")
        for shape in book.shapes()]
    return reduce(lambda a, b: a.unionByName(b), tables)


@query("P13 P14 S11", f"""
    select count(*) as sheets, count(distinct k) as files, cast(sum(n) as bigint) as data_rows, 1 as shapes,
           substr(sha256('header@4|cols=5|date:date|order_no:text|priority:text|net_sales:number|status:text'), 1, 32) as source_signature,
           substr(sha256('date|net_sales|order_no|priority|status'), 1, 32) as column_hash from {_N}""")
def sheet_fingerprints(t: Tables):
    summary = G.Workbooks(customer_sheets(t)).summary
    primary = G.primary_tables(summary)
    return summary.join(primary, ["file", "sheet"]).agg(
        F.count(F.lit(1)).alias("sheets"), F.count_distinct("file").alias("files"), F.sum("data_rows").alias("data_rows"),
        F.count_distinct("source_signature").alias("shapes"), F.min("source_signature").alias("source_signature"), F.min("column_hash").alias("column_hash"))


@query("P14 P11", """
    select 'customer-' || o_custkey as file, 'date' as "column", count(*) filter (where day(o_orderdate) <= 12) || ' date(s) could be day-first or month-first; read as dmy' as warning
    from orders group by o_custkey having count(*) filter (where day(o_orderdate) <= 12) > 0""")
def sheet_warnings(t: Tables):
    return G.parse_warnings(G.Workbooks(customer_sheets(t)).columns).select("file", "column", "warning")


@query("D10 P8", """
    select 'customer-' || o_custkey as file, 'net_sales' as "column", count(*) + 6 as source_row,
           cast(sum(cast(round(o_totalprice * 100) as bigint) * case when o_orderkey % 3 = 2 then -1 else 1 end) as double) / 100 as declared
    from orders group by 1, o_custkey having sum(cast(round(o_totalprice * 100) as bigint) * case when o_orderkey % 3 = 2 then -1 else 1 end) is not null""")
def sheet_declared_totals(t: Tables):
    book = G.Workbooks(customer_sheets(t))
    return G.declared_figures(book.rows, book.columns).select("file", "column", "source_row", "declared")


@query("P15", """
    select 'customer-' || k as file, r as source_row, c.c_name as value from (select distinct o_custkey as k from orders) join customer c on c_custkey = k, (values (1), (2)) v(r)""")
def sheet_merged_cells(t: Tables):
    """The title merged over two rows and all five columns."""
    cells = customer_sheets(t)
    ranges = cells.where("source_row = 1").select(
        "file", "sheet", F.lit(1).alias("first_row"), F.lit(2).alias("last_row"), F.lit(0).alias("first_col"), F.lit(4).alias("last_col"))
    return G.fill_merged(cells, ranges).where("source_row <= 2").select(
        "file", "source_row", F.try_element_at("cells", F.lit(5)).alias("value"))
