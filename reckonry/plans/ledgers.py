"""Ledger queries: sheets, feeds and posted lines built from the star schema."""

from pyspark.sql import functions as F

from reckonry.functions import fixed_values as fv
from reckonry.operators import ledger as E
from reckonry.plans.catalog import Tables, query
from reckonry.sources import feeds

ROW = "__source_row"


def _sums(entries):
    return entries.groupBy("kind", "category", "classified_by").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").cast("double").alias("amount"))


def two_column_sheet(t: Tables):
    """One row per order: takings on one side, a delivery cost on the other."""
    o = t.orders
    return o.select(
        F.col("o_orderkey").alias(ROW), F.when(F.col("o_orderkey") % 50 == 0, None).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"),
        F.when(F.col("o_orderkey") % 2 == 0, "Cash sales").otherwise("Transport").alias("description"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("income"),
        F.when(F.col("o_orderkey") % 4 == 0, F.floor(F.col("o_totalprice") / 10)).alias("expenses"))


_ROLES_TWO = {"date": "date", "description": "description", "income": "income", "expense": "expenses"}


@query("E2 E5 E8", """
    with r as (select o_orderkey % 50 <> 0 as dated, o_orderkey % 2 = 0 as cash, case when o_orderkey % 3 <> 0 then cast(o_totalprice as decimal(18,2)) end as i,
                 case when o_orderkey % 4 = 0 then cast(floor(o_totalprice / 10) as decimal(18,2)) end as e from orders),
         x as (select 'revenue' as hint, cash, i as amount from r where dated and i is not null and i <> 0
               union all select 'expense', cash, e from r where dated and e is not null and e <> 0)
    select hint as kind, case when hint = 'revenue' then case when cash then 'sales' else 'other_income' end
                              else case when cash then 'other_expense' else 'transport' end end as category,
           case when (hint = 'revenue') = cash then 'matched' else 'weak' end as classified_by, count(*) as n, cast(sum(amount) as double) as amount
    from x group by 1, 2, 3""")
def two_column_ledger(t: Tables):
    return _sums(E.entries_from_sheet(two_column_sheet(t), _ROLES_TWO)[0])


@query("E12 E5", """
    with r as (select o_orderkey % 50 <> 0 as dated, case when o_orderkey % 3 <> 0 then o_totalprice end as i, case when o_orderkey % 4 = 0 then o_totalprice end as e from orders)
    select 'entries' as what, count(i) filter (where dated) + count(e) filter (where dated) as count from r
    union all select 'uncategorised', 0 union all select 'skipped:no_date', count(*) from r where not dated""")
def sheet_batch_summary(t: Tables):
    return E.batch_summary(*E.entries_from_sheet(two_column_sheet(t), _ROLES_TWO))


_KINDS = ("Sale", "Iib", "Iibsi", "Stock purchase", "Koronto", "Shop rent", "Mystery")


@query("E3 E8", f"""
    with k(i, hint, category, how) as (values (0, 'revenue', 'other_income', 'unmatched'), (1, 'revenue', 'sales', 'matched'), (2, 'cogs', 'purchases', 'matched'),
               (3, 'cogs', 'purchases', 'matched'), (4, 'expense', 'electricity', 'matched'), (5, 'expense', 'rent', 'matched'), (6, 'expense', 'other_expense', 'unmatched'))
    select hint as kind, category, how as classified_by, count(*) as n, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as amount
    from lineitem join k on l_partkey % 7 = i where l_extendedprice <> 0 group by 1, 2, 3""")
def typed_ledger(t: Tables):
    names = F.array(*[F.lit(k) for k in _KINDS])
    sheet = t.lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias(ROW), F.date_format("l_shipdate", "dd/MM/yyyy").alias("taariikh"),
        F.element_at(names, (F.col("l_partkey") % 7 + 1).cast("int")).alias("nooca"), F.col("l_extendedprice").alias("qiimaha"))
    return _sums(E.entries_from_sheet(sheet, {"date": "taariikh", "type": "nooca", "amount": "qiimaha"})[0])


@query("E4 E5", """
    select case when c_acctbal > 0 then 'revenue' else 'expense' end as kind, case when c_acctbal > 0 then 'sales' else 'rent' end as category,
           'matched' as classified_by, count(*) as n, cast(sum(abs(cast(c_acctbal as decimal(18,2)))) as double) as amount
    from customer where cast(c_acctbal as decimal(18,2)) <> 0 group by 1, 2""")
def signed_ledger(t: Tables):
    sheet = t.customer.select(
        F.col("c_custkey").alias(ROW), F.lit("2026-08-01").alias("day"),
        F.when(F.col("c_acctbal") > 0, "Iibka").otherwise("Kirada").alias("note"), F.col("c_acctbal").alias("net"))
    return _sums(E.entries_from_sheet(sheet, {"date": "day", "description": "note", "amount": "net"})[0])


@query("E1", """
    select 'date' as role, 'o_orderdate' as "column" where (select count(*) from orders) > 0 union all select 'amount', 'o_totalprice' union all select 'type', 'kind'
    union all select 'counterparty', 'customer_name' union all select 'quantity', 'qty'""")
def sheet_roles(t: Tables):
    from reckonry.operators.profile import profile_columns

    sheet = t.orders.select(
        "o_orderdate", "o_totalprice", F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("customer_name"), F.col("o_custkey").alias("qty"))
    profile = profile_columns(sheet, row=None)
    return t.spark.createDataFrame(list(E.detect_columns(profile).items()), "role string, column string")


@query("S3 E6", """
    with l as (select o_orderkey, o_custkey % 8 as k, l_linenumber % 4 as m, cast(l_extendedprice as decimal(18,2)) as a, p_type, l_quantity
               from orders join lineitem on o_orderkey = l_orderkey join part on p_partkey = l_partkey where o_custkey % 8 <> 7 and o_orderkey % 40 <> 0 and l_linenumber % 4 <> 3),
         h as (select case when k in (0, 1, 2, 3) then 'revenue' when m = 2 then 'expense' else 'cogs' end as hint, case when k in (2, 3, 6) then -a else a end as a, m from l),
         i as (select hint, case when hint = 'revenue' then case when m = 2 then 'other_income' else 'other_income' end when hint = 'cogs' then 'purchases' else 'rent' end as category,
                case when m = 2 then case when hint = 'revenue' then 'weak' else 'matched' end else 'unmatched' end as how, a from h),
         w as (select case when o_custkey % 8 in (0, 1, 2, 3) then 'revenue' else 'expense' end as hint, o_custkey % 8 as k, cast(o_totalprice as decimal(18,2)) as a from orders
               where o_custkey % 8 <> 7 and o_orderkey % 40 <> 0 and not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_linenumber % 4 <> 3)),
         x as (select * from i union all select hint, case when k in (0, 1) then 'sales' when hint = 'revenue' then case k when 3 then 'sales' else 'other_income' end when k = 4 then 'purchases' else 'other_expense' end,
                 case when k in (0, 1, 3) then 'matched' when k = 4 then 'weak' else 'unmatched' end, case when k in (2, 3, 6) then -a else a end from w)
    select hint as kind, case when hint = 'expense' and category = 'purchases' then 'other_expense' else category end as category, how as classified_by, count(*) as n, cast(sum(a) as double) as amount from x group by 1, 2, 3""")
def document_feed_ledger(t: Tables):
    return _sums(E.entries_from_documents(feeds.parse_documents(feed_lines(t)))[0])


@query("S3 E12", """
    select case when o_custkey % 8 = 7 then 'unknown_entity' else 'no_dated_lines' end as reason, count(*) as n from orders
    where o_custkey % 8 = 7 or o_orderkey % 40 = 0 group by 1
    union all select 'malformed_document', count(*) from nation""")
def document_feed_skips(t: Tables):
    broken = t.nation.select(F.lit("Invoice").alias("entity"), F.concat(F.lit("not json "), "n_name").alias("json"))
    return E.entries_from_documents(feeds.parse_documents(feed_lines(t).unionByName(broken)))[1].groupBy("reason").agg(
        F.count(F.lit(1)).alias("n"))


def feed_lines(t: Tables):
    """Orders and their lines as feed documents in JSON, one per line."""
    entities = ("Invoice", "SalesReceipt", "CreditMemo", "RefundReceipt", "Purchase", "Bill", "VendorCredit", "Estimate")
    item = F.struct(F.struct(F.col("p_partkey").cast("string").alias("value"), F.col("p_type").alias("name")).alias("ItemRef"), F.col("l_quantity").alias("Qty"))
    rent = F.struct(F.struct(F.lit("9").alias("value"), F.lit("Shop rent").alias("name")).alias("AccountRef"))
    m = F.col("l_linenumber") % 4
    kind = F.when(m == 3, "SubTotalLineDetail").when(m == 2, "AccountBasedExpenseLineDetail").when(m == 1, "SalesItemLineDetail").otherwise("ItemBasedExpenseLineDetail")
    line = F.struct(
        F.concat_ws("-", "l_linenumber", "l_partkey").alias("Id"), F.col("l_extendedprice").alias("Amount"), kind.alias("DetailType"),
        F.when(m == 1, item).alias("SalesItemLineDetail"), F.when(m == 0, item).alias("ItemBasedExpenseLineDetail"),
        F.when(m == 2, rent).alias("AccountBasedExpenseLineDetail"))
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.collect_list(line).alias("Line"))
    entity = F.element_at(F.array(*[F.lit(e) for e in entities]), (F.col("o_custkey") % 8 + 1).cast("int"))
    docs = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    body = F.struct(
        F.col("o_orderkey").cast("string").alias("Id"), F.when(F.col("o_orderkey") % 40 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("TxnDate"),
        F.col("o_totalprice").alias("TotalAmt"), F.struct(F.lit("USD").alias("value"), F.lit("US Dollar").alias("name")).alias("CurrencyRef"),
        F.struct(F.col("o_custkey").cast("string").alias("value"), F.lit("Shop").alias("name")).alias("CustomerRef"), "Line")
    return docs.select(entity.alias("entity"), F.to_json(body).alias("json"))


_ACCOUNTS = ("asset_cash", "income", "expense_direct_cost", "expense")
_ACCOUNT_NAMES = ("Bank", "Product sales", "Cost of goods", "Electricity")


def posted_lines(t: Tables):
    k = (F.col("l_suppkey") % 4).cast("int")
    amount = F.col("l_extendedprice")
    income = k == 1
    names = F.array(*[F.lit(n) for n in _ACCOUNT_NAMES])
    raw = t.lineitem.select(
        F.xxhash64(*t.lineitem.columns).alias("id"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.lit("line").alias("name"),
        F.when(~income, amount).otherwise(0.0).alias("debit"), F.when(income, amount).otherwise(0.0).alias("credit"),
        F.when(F.col("l_linenumber") == 1, None).otherwise(F.when(income, -amount).otherwise(amount)).alias("balance"),
        F.array((k + 100).cast("string"), F.element_at(names, k + 1)).alias("account_id"),
        F.array(F.lit("1"), F.lit("Customer")).alias("partner_id"), F.array(F.lit("false")).alias("product_id"), F.array(F.lit("2"), F.lit("Sales")).alias("journal_id"),
        F.col("l_quantity").alias("quantity"), F.array(F.lit("1"), F.lit("usd")).alias("company_currency_id"),
        F.when(F.col("l_linestatus") == "F", "posted").otherwise("draft").alias("parent_state"))
    return feeds.posted_lines(raw, "1995-01-01", "1999-12-31")


def chart_of_accounts(t: Tables):
    return t.region.where("r_regionkey < 4").select(
        (F.col("r_regionkey") + 100).alias("id"),
        F.element_at(F.array(*[F.lit(n) for n in _ACCOUNT_NAMES]), F.col("r_regionkey") + 1).alias("name"),
        F.element_at(F.array(*[F.lit(n) for n in _ACCOUNTS]), F.col("r_regionkey") + 1).alias("account_type"))


@query("S4 E7", """
    select case l_suppkey % 4 when 1 then 'revenue' when 2 then 'cogs' else 'expense' end as kind, case l_suppkey % 4 when 1 then 'sales' when 2 then 'purchases' else 'electricity' end as category,
           'matched' as classified_by, count(*) as n, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as amount
    from lineitem where l_suppkey % 4 <> 0 and l_linestatus = 'F' and cast(l_shipdate as date) between date '1995-01-01' and date '1999-12-31' group by 1, 2""")
def posted_ledger(t: Tables):
    return _sums(E.entries_from_postings(posted_lines(t), chart_of_accounts(t))[0])


def _keyword_case(text: str) -> str:
    return "case " + " ".join(
        f"when regexp_matches({text}, '{'|'.join(words)}') then '{c}'" for c, words in fv.LEDGER_KEYWORDS) + " end"


@query("E8", f"""
    with h as (select p_partkey % 4 as k, lower(p_name || ' ' || p_type) as text, lower(case p_partkey % 6 when 0 then 'freight ' when 1 then 'koronto ' when 2 then 'staff cost ' when 3 then 'other income ' when 4 then 'cost of ' else '' end || p_name || ' ' || p_type) as t from part),
         c as (select case k when 0 then 'revenue' when 1 then 'cogs' when 2 then 'expense' end as hint, {_keyword_case('t')} as w, t from h),
         d as (select *, case {' '.join(f"when w = '{c}' then '{k}'" for c, k in fv.LEDGER_KINDS.items())} end as wk from c),
         e as (select hint, case when w is not null and (hint is null or hint = wk) then wk when w is not null then hint
                      when regexp_matches(t, 'income|revenue|dakhli') and hint is distinct from 'expense' then 'revenue' else coalesce(hint, 'expense') end as kind,
                    case when w is not null and (hint is null or hint = wk) then w end as own,
                    case when w is not null and (hint is null or hint = wk) then 'matched' when w is not null then 'weak'
                         when regexp_matches(t, 'income|revenue|dakhli') and hint is distinct from 'expense' then 'weak'
                         when regexp_matches(t, 'expense|cost|overhead|kharash|kharashaad') then 'weak' else 'unmatched' end as how from d)
    select kind, coalesce(own, case kind when 'revenue' then 'other_income' when 'cogs' then 'purchases' else 'other_expense' end) as category, how as classified_by, count(*) as n
    from e group by 1, 2, 3""")
def account_classes(t: Tables):
    k, p = F.col("p_partkey") % 4, F.col("p_partkey") % 6
    lead = F.when(p == 0, "freight ").when(p == 1, "koronto ").when(p == 2, "staff cost ").when(p == 3, "other income ").when(p == 4, "cost of ").otherwise("")
    parts = t.part.select(F.concat(lead, F.col("p_name")).alias("account"), F.col("p_type").alias("description"),
                          F.when(k == 0, "revenue").when(k == 1, "cogs").when(k == 2, "expense").alias("hint"))
    done = E.classify(parts, F.col("account"), F.col("description"), F.col("hint"))
    return done.groupBy("kind", "category", "classified_by").agg(F.count(F.lit(1)).alias("n"))


def ledger(t: Tables):
    """One ledger from the star schema: orders sell, lines buy, returned lines come back."""
    sales = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderdate").cast("date").alias("occurred_on"), F.lit("revenue").alias("kind"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "wholesale").otherwise("sales").alias("category"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"), F.lit("USD").alias("currency"),
        F.col("o_orderpriority").alias("account"), F.col("c_name").alias("counterparty"), F.col("o_orderstatus").alias("product"),
        F.lit("matched").alias("classified_by"), F.concat(F.lit("o:"), F.col("o_orderkey")).alias("source_ref"),
        F.lit(None).cast("decimal(18,4)").alias("quantity"))
    back = F.col("l_returnflag") == "R"
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_shipdate").cast("date").alias("occurred_on"),
        F.when(back, "revenue").when(F.col("l_returnflag") == "A", "cogs").otherwise("expense").alias("kind"),
        F.when(back, "sales").when(F.col("l_returnflag") == "A", "purchases").otherwise(F.when(F.col("l_linestatus") == "O", "other_expense").otherwise("transport")).alias("category"),
        F.when(back, -price).otherwise(price).alias("amount"), F.when(F.col("l_linenumber") == 7, "KWD").otherwise("USD").alias("currency"),
        F.col("p_brand").alias("account"), F.lit("").alias("counterparty"), F.col("p_name").alias("product"),
        F.when(F.col("l_linestatus") == "O", "unmatched").otherwise("matched").alias("classified_by"),
        F.concat(F.lit("l:"), F.xxhash64(*t.lineitem.columns).cast("string")).alias("source_ref"), F.col("l_quantity").cast("decimal(18,4)").alias("quantity"))
    return E.to_ledger(sales.unionByName(lines))


def rates(t: Tables):
    """One rate per currency, held as a table."""
    return t.region.where("r_regionkey = 0").select(F.lit("KWD").alias("currency"), F.lit(0.25).cast("decimal(18,6)").alias("rate"))


def base_ledger(t: Tables):
    return E.convert(ledger(t), rates(t))


@query("E9", """
    with l as (
      select 'lines' as part, case when l_linenumber = 7 then 'KWD' else 'USD' end as currency, l_returnflag = 'R' as negative,
             cast(round(case when l_linenumber = 7 then l_extendedprice / 0.25 else l_extendedprice end, 6) as decimal(28,6)) as amount from lineitem
      union all select 'orders', 'USD', false, cast(o_totalprice as decimal(28,6)) from orders join customer on o_custkey = c_custkey)
    select part, currency, negative, count(*) as n, round(cast(sum(amount) as double), 2) as amount from l group by 1, 2, 3""")
def ledger_in_base_currency(t: Tables):
    part = F.when(F.col("source_ref").startswith("l:"), "lines").otherwise("orders")
    return base_ledger(t).groupBy(part.alias("part"), "currency", (F.col("amount") < 0).alias("negative")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.round(F.abs("amount_base"), 6)).cast("double"), 2).alias("amount"))


@query("E10", """
    with b as (select 1 as batch_no, o_orderkey % 1000 as k, o_orderkey, o_totalprice from orders)
    select source_ref, batch_no, amount from (
      select 'ref:' || o_orderkey as source_ref, case when o_orderkey % 3 = 0 then 2 else 1 end as batch_no,
             cast(case when o_orderkey % 3 = 0 then o_totalprice + 50 else o_totalprice end as double) as amount from orders where o_orderkey % 5 <> 0
      union all select '', 1, o_totalprice from orders where o_orderkey % 5 = 0
      union all select '', 2, o_totalprice + 50 from orders where o_orderkey % 15 = 0)""")
def merged_batches(t: Tables):
    ref = F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.concat(F.lit("ref:"), "o_orderkey"))
    first = t.orders.select(ref.alias("source_ref"), F.lit(1).alias("batch_no"), F.col("o_totalprice").alias("amount"))
    second = t.orders.where("o_orderkey % 3 = 0").select(ref.alias("source_ref"), F.lit(2).alias("batch_no"), (F.col("o_totalprice") + 50).alias("amount"))
    return E.merge_batches(first.unionByName(second))


@query("E11 ST2", """
    with e as (select o_custkey, max_by(cast(o_orderdate as date), o_orderkey) as d from orders where o_orderstatus = 'F' group by 1)
    select c_custkey as connection_id, cast(coalesce(d - 7, date '2002-01-01' - 90) as varchar) as window_start, '2002-01-01' as window_end
    from customer left join e on o_custkey = c_custkey""")
def sync_windows(t: Tables):
    runs = t.orders.select(
        F.col("o_custkey").alias("connection_id"), F.col("o_orderdate").cast("date").alias("window_end"), F.col("o_orderkey").alias("finished_at"),
        F.when(F.col("o_orderstatus") == "F", "succeeded").otherwise("failed").alias("status"))
    out = E.sync_window(runs, t.customer.select(F.col("c_custkey").alias("connection_id")), F.lit("2002-01-01").cast("date"))
    return out.select("connection_id", F.col("window_start").cast("string").alias("window_start"), F.col("window_end").cast("string").alias("window_end"))


def _old_version(t: Tables):
    """An old version that stored floats, text dates and few of today's columns."""
    return t.orders.select(
        F.when(F.col("o_orderkey") % 20 == 0, "unknown").when(F.col("o_orderkey") % 35 == 1, " ").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("occurred_on"),
        F.when(F.col("o_orderkey") % 30 != 7, F.col("o_totalprice")).alias("amount"), F.lit(None).cast("string").alias("kind"))


@query("E13", """
    select strftime(o_orderdate, '%Y-%m') as month, 'expense' as kind, 'other_expense' as category, 'USD' as currency, count(*) as n,
           cast(sum(cast(o_totalprice as decimal(18,2))) as double) as amount
    from orders where o_orderkey % 20 <> 0 and o_orderkey % 35 <> 1 and o_orderkey % 30 <> 7 group by 1""")
def ledger_read_back(t: Tables):
    entries, _ = E.read_back(_old_version(t))
    return entries.groupBy(F.date_format("occurred_on", "yyyy-MM").alias("month"), "kind", "category", "currency").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").cast("double").alias("amount"))


@query("E13", """
    select case when o_orderkey % 20 = 0 or o_orderkey % 35 = 1 then 'no date' else 'no amount' end as reason, count(*) as n
    from orders where o_orderkey % 20 = 0 or o_orderkey % 35 = 1 or o_orderkey % 30 = 7 group by 1""")
def ledger_read_back_skipped(t: Tables):
    _, skipped = E.read_back(_old_version(t))
    return skipped.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
