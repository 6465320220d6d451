"""Column jobs: numbers, dates, labels, keys and redaction over derived text."""

from pyspark.sql import functions as F

from reckonry.functions import scalars as S
from reckonry.functions import text as T
from reckonry.plans.catalog import Tables, query
from reckonry.plans.sums import money_sum_or_zero


def spelled_prices(t: Tables):
    """Line prices written the eight ways ledgers write them."""
    whole = F.floor(F.col("l_extendedprice"))
    price = F.format_number("l_extendedprice", 2)
    plain = F.regexp_replace(price, ",", "")
    style = F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(9))
    text = (
        F.when(style == 0, plain)
        .when(style == 1, F.concat(F.lit("("), price, F.lit(")")))
        .when(style == 2, F.concat(F.lit("£"), price))
        .when(style == 3, F.concat(price, F.lit(" CR")))
        .when(style == 4, F.concat(F.lit(" $ "), price, F.lit(" DR")))
        .when(style == 5, F.concat(plain, F.lit("-")))
        .when(style == 6, F.translate(price, ",.", ".,"))
        .when(style == 7, F.concat(F.regexp_replace(F.format_number(whole, 0), ",", "'")))
        .otherwise(F.lit("n/a"))
    )
    return t.spread("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", style.alias("spelling"), text.alias("raw"))


@query("L4 L2", """
    with s as (select (l_orderkey + l_linenumber) % 9 as spelling, l_extendedprice as p from lineitem),
         v as (select spelling, case when spelling in (1, 3, 5) then -1 else 1 end as sign,
                      case when spelling = 7 then floor(p) when spelling = 8 then null else p end as p,
                      case when spelling in (0, 5, 8) or (spelling = 6 and p < 1000) or (spelling = 7 and floor(p) < 1000)
                           then false when p >= 1000 or spelling = 6 then p >= 1000 else false end as grouped,
                      p < 1000 as small from s)
    select spelling,
           trim(both '|' from concat_ws('|', case when spelling in (3, 4) then 'credit_suffix' end,
             case when spelling = 1 then 'parentheses' end, case when spelling in (2, 4) then 'currency' end,
             case when grouped then 'thousands' end)) as styles,
           count(p) as readable, count(*) - count(p) as unreadable,
           cast(coalesce(sum(sign * cast(round(p * 100) as bigint)), 0) as double) / 100 as total
    from v group by 1, 2""")
def number_spellings(t: Tables):
    read = spelled_prices(t).withColumn("number", S.parse_number(F.col("raw")))
    return read.groupBy(
        "spelling", F.coalesce(F.concat_ws("|", "number.styles"), F.lit("")).alias("styles")
    ).agg(
        F.count("number").alias("readable"),
        F.count_if(F.col("number").isNull()).alias("unreadable"),
        money_sum_or_zero(F.col("number.value")).alias("total"),
    )


def spelled_dates(t: Tables):
    d = F.col("o_orderdate").cast("date")
    style = F.pmod("o_orderkey", F.lit(6))
    text = (
        F.when(style == 0, F.date_format(d, "dd/MM/yyyy"))
        .when(style == 1, F.date_format(d, "yyyy-MM-dd"))
        .when(style == 2, F.date_format(d, "d MMM yyyy"))
        .when(style == 3, F.date_format(d, "dd.MM.yy"))
        .when(style == 4, F.date_format(d, "yyyy/M/d"))
        .otherwise(F.concat(F.date_format(d, "dd-MM-yyyy"), F.lit(" 10:45:00")))
    )
    return t.spread("orders").select("o_orderkey", d.alias("day"), style.alias("spelling"), text.alias("raw"))


@query("L5", """
    with s as (select o_orderkey % 6 as spelling, cast(o_orderdate as date) as day from orders)
    select spelling,
           case when spelling in (1, 4) then 'ymd' else 'dmy' end as date_order,
           spelling in (0, 3, 5) and day(day) <= 12 as ambiguous,
           count(*) as n, cast(min(day) as varchar) as earliest, cast(max(day) as varchar) as latest,
           count(distinct day) as days
    from s group by 1, 2, 3""")
def date_spellings(t: Tables):
    read = spelled_dates(t).withColumn("date", S.parse_date(F.col("raw")))
    return read.groupBy("spelling", F.col("date.order").alias("date_order"), F.col("date.ambiguous").alias("ambiguous")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("date.value").cast("string").alias("earliest"),
        F.max("date.value").cast("string").alias("latest"),
        F.count_distinct("date.value").alias("days"),
    )


@query("L5", """
    select cast(strptime(case when day(o_orderdate) > 12 then strftime(o_orderdate, '%Y-%m-%d')
                  else strftime(o_orderdate, '%Y-%d-%m') end, '%Y-%m-%d')::date as varchar) as read_as, count(*) as n
    from orders group by 1""")
def dates_read_month_first(t: Tables):
    text = F.date_format(F.col("o_orderdate").cast("date"), "dd/MM/yyyy")
    read = t.orders.select(S.parse_date(text, prefer="mdy")["value"].cast("string").alias("read_as"))
    return read.groupBy("read_as").agg(F.count(F.lit(1)).alias("n"))


@query("L5", """
    select l_shipdate is not null as readable, count(*) as n,
           cast(min(date '1899-12-30' + cast(61 + l_partkey % 59940 as integer)) as varchar) as earliest
    from lineitem group by 1""")
def date_serials(t: Tables):
    serial = (F.lit(61) + F.pmod("l_partkey", F.lit(59940))).cast("string")
    read = t.lineitem.select(S.serial_date_struct(serial)["value"].alias("day"))
    return read.groupBy(F.col("day").isNotNull().alias("readable")).agg(
        F.count(F.lit(1)).alias("n"), F.min("day").cast("string").alias("earliest"))


@query("L1 L7", """
    select lower(p_name) as entity, count(*) as n, count(distinct (p_partkey % 4)) as spellings from part group by 1""")
def entity_keys(t: Tables):
    """Part names retyped with legal forms, case, punctuation and odd spaces."""
    style, name = F.pmod("p_partkey", F.lit(4)), F.col("p_name")
    text = (
        F.when(style == 0, F.concat(name, F.lit(" Ltd")))
        .when(style == 1, F.concat(F.upper(name), F.lit(" LIMITED.")))
        .when(style == 2, F.concat(F.lit("  "), F.regexp_replace(name, " ", " "), F.lit(" & Co.​")))
        .otherwise(F.regexp_replace(name, " ", " - "))
    )
    keyed = t.part.select(text.alias("raw"), style.alias("style")).withColumn("entity", S.entity_key(F.col("raw")))
    return keyed.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("style").alias("spellings"))


@query("L3 L2 L6", """
    select case o_orderkey % 5 when 0 then 'subtotal' when 1 then 'data' when 2 then 'subtotal'
             when 3 then 'null' else case when o_orderkey % 2 = 0 then 'true' else 'false' end end as kind,
           count(*) as n from orders group by 1""")
def label_kinds(t: Tables):
    k = F.pmod("o_orderkey", F.lit(5))
    text = (
        F.when(k == 0, F.concat(F.lit("Total "), F.date_format("o_orderdate", "MMMM yyyy")))
        .when(k == 1, F.concat(F.lit("Total "), F.col("o_orderpriority"), F.lit(" Ltd")))
        .when(k == 2, F.lit("  Sub-Total: "))
        .when(k == 3, F.lit(" #N/A "))
        .otherwise(F.when(F.col("o_orderkey") % 2 == 0, "Yes").otherwise("n"))
    )
    raw = t.orders.select(text.alias("raw")).withColumns({
        "empty": S.is_null_token(F.col("raw")),
        "summary": S.is_subtotal_label(F.col("raw")),
        "truth": S.looks_like_boolean(F.col("raw")),
    })
    kind = (
        F.when(F.col("empty"), "null").when(F.col("summary"), "subtotal")
        .when(F.col("truth").isNotNull(), F.col("truth").cast("string")).otherwise("data")
    )
    return raw.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("L8", """
    select strftime(o_orderdate, '%Y-%m-%d') as day, count(*) as n,
           sum(cast(case when o_orderkey % 10 = 0 then null else cast(o_totalprice as decimal(18,2)) end as double)) is not null as has_amount,
           count(case when o_orderkey % 10 = 0 then null else o_totalprice end) as amounts
    from orders group by 1""")
def feed_values(t: Tables):
    raw = t.orders.select(
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("d"),
        F.when(F.col("o_orderkey") % 10 == 0, "twelve").otherwise(F.concat(F.lit(" "), F.format_string("%.2f", "o_totalprice"))).alias("a"),
    )
    read = raw.select(S.parse_iso_date(F.col("d")).cast("string").alias("day"), S.to_decimal(F.col("a")).alias("amount"))
    return read.groupBy("day").agg(
        F.count(F.lit(1)).alias("n"), (F.count("amount") > 0).alias("has_amount"), F.count("amount").alias("amounts"))


def _sql_redactions(column: str) -> list[str]:
    """Nested SQL replacements in the fixed order, without the look-ahead RE2 refuses."""
    from reckonry.functions.fixed_values import REDACTIONS

    stages = [column]
    for kind, pattern in REDACTIONS:
        p, keep = pattern.replace(r"(?!\d)", ""), ""
        if kind == "card":
            # RE2 sees no word boundary before an accented letter; take the letter and give it back.
            p, keep = p.removesuffix(r"\b") + r"(?:\b|([^\x00-\x7F]))", r"\1"
        stages.append(f"regexp_replace({stages[-1]}, '{p}', '[{kind}]{keep}', 'g')")
    return stages


def _redaction_sql() -> str:
    from reckonry.functions.fixed_values import REDACTIONS

    stages, parts = _sql_redactions("text"), []
    for i, (kind, pattern) in enumerate(REDACTIONS):
        p = pattern.replace(r"(?!\d)", "")
        parts.append(
            f"select '{kind}' as kind, cast(sum(len(regexp_extract_all({stages[i]}, '{p}'))) as bigint) as hits, "
            f"count(*) filter (where len(regexp_extract_all({stages[i]}, '{p}')) > 0) as rows from documents"
        )
    return " union all ".join(parts)


@query("T9", _redaction_sql())
def redaction_counts(t: Tables):
    return T.redaction_report(t.spread("documents"), "text")


@query("T9", f"""
    select doc_id, md5(redacted) as digest, length(redacted) as chars
    from (select doc_id, text, {_sql_redactions('text')[-1]} as redacted from documents)
    where redacted <> text""")
def redacted_documents(t: Tables):
    redacted = t.spread("documents").select("doc_id", "text", T.redact(F.col("text")).alias("redacted"))
    return redacted.where(F.col("redacted") != F.col("text")).select(
        "doc_id", F.md5("redacted").alias("digest"), F.length("redacted").cast("long").alias("chars"))


@query("T10", """
    select lower(p_name) as merchant, count(*) as n from part group by 1""")
def statement_lines(t: Tables):
    style = F.pmod("p_partkey", F.lit(4))
    text = (
        F.when(style == 0, F.concat(F.lit("CARD PAYMENT TO "), F.upper("p_name"), F.lit(" 08/06/26 CARD 4417")))
        .when(style == 1, F.concat(F.lit("Direct Debit: "), F.col("p_name"), F.lit(" REF: AB12-"), F.col("p_partkey")))
        .when(style == 2, F.concat(F.lit("POS "), F.col("p_name"), F.lit(" 08jun26 GBP 123456")))
        .otherwise(F.concat(F.lit("faster payment "), F.regexp_replace("p_name", " ", "*")))
    )
    lines = t.part.select(T.statement_line(text).alias("merchant"))
    return lines.groupBy("merchant").agg(F.count(F.lit(1)).alias("n"))
