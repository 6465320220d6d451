"""Rule categorisation over text derived from the given tables."""

from pyspark.sql import functions as F

from reckonry.functions import fixed_values as fv
from reckonry.functions.text import words_of
from reckonry.operators import clean as C
from reckonry.operators import rules as K
from reckonry.plans.catalog import Tables, query

ROW = "__source_row"

# Merchants a line can carry, with the rule that should place each (None: no rule).
_MERCHANTS = (
    ("TFL TRAVEL CH", 17), ("HMRC VAT", 1), ("SCREWFIX DIRECT", 33), ("UBER TRIP", 18), ("UBER *EATS", 46),
    ("PARKING FINE PCN", 4), ("NCP CAR PARK", 19), ("AMAZON WEB SERVICES", 16), ("AMZN MKTP UK", 44),
    ("TESCO PETROL", 15), ("TESCO STORES", 45), ("NETFLIX.COM", 48), ("BRITISH GAS BUSINESS", 23),
    ("GOOGLE ADS", 35), ("GOOGLE *CLOUD", 29), ("XERO", 40), ("STRIPE FEE", 38), ("CASH WITHDRAWAL LINK", 7),
    ("ZQX TRADING", None), ("VELLUM AND SON", None),
)


def bank_lines(t: Tables):
    """Every order line as a bank statement line."""
    names = F.array(*[F.lit(m) for m, _ in _MERCHANTS])
    k = F.pmod(F.col("l_partkey"), F.lit(len(_MERCHANTS))).cast("int")
    dressed = F.pmod(F.col("l_orderkey"), F.lit(3))
    merchant = F.element_at(names, k + 1)
    text = (
        F.when(dressed == 0, F.concat(F.lit("CARD PAYMENT TO "), merchant, F.lit(" 08/06/26")))
        .when(dressed == 1, F.lower(merchant)).otherwise(F.concat(F.lit("Direct Debit - "), merchant, F.lit(" REF 00"), F.col("l_suppkey").cast("string"))))
    return t.spread("lineitem").select(
        F.xxhash64(*t.lineitem.columns).alias(ROW), text.alias("description"),
        F.col("l_returnflag").alias("type"), F.col("l_extendedprice").alias("amount"), k.alias("merchant_no"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("null" if v is None else f"'{v.replace(chr(39), chr(39) * 2)}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


_BOX = {name: box for name, box, _ in fv.TAX_CATEGORIES}
_PLACED = [
    (i, no, *(fv.TAX_RULES[no - 1][1:] if no else (None,) * 4), _BOX[fv.TAX_RULES[no - 1][1]] if no else None)
    for i, (_, no) in enumerate(_MERCHANTS)
]
_PLACED_SQL = f"""
    with m(merchant_no, rule_no, category, confidence, evidence, account, box) as (values {_values(_PLACED)}),
         l as (select l_partkey % {len(_MERCHANTS)} as merchant_no, l_orderkey % 3 as dressed,
                 case when l_orderkey % 3 = 2 then l_suppkey end as supplier from lineitem),
         v as (select m.*, dressed, supplier, count(*) as rows from l join m using (merchant_no) group by all)"""


@query("K2 K3", _PLACED_SQL + """
    select rule_no, category, box, confidence, account, count(*) as kinds, cast(sum(rows) as bigint) as rows from v group by 1, 2, 3, 4, 5""")
def rule_decisions(t: Tables):
    return K.decide_values(bank_lines(t), "description").groupBy("rule_no", "category", "box", "confidence", "account").agg(
        F.count(F.lit(1)).alias("kinds"), F.sum("rows").alias("rows"))


def _rules_sql(column: str) -> str:
    """The ordered rules as one SQL expression, look-aheads written as extra tests."""
    import re

    whens = []
    for no, rule in enumerate(fv.TAX_RULES, start=1):
        parts = []
        for alternative in rule[0].split("|") if "(?:" not in rule[0] else re.split(r"\|(?![^(]*\))", rule[0]):
            negative = re.search(r"\(\?!\.\*(.*?)\)$", alternative)
            positive = re.search(r"\(\?=\.\*(.*?)\)$", alternative)
            plain = re.sub(r"\(\?[!=].*\)$", "", alternative)
            if plain == r"\bbp\b":
                negative = None
            test = f"regexp_matches({column}, '{plain}')"
            if negative:
                test = f"({test} and not regexp_matches({column}, '{plain}.*{negative.group(1)}'))"
            if positive:
                test = f"({test} and regexp_matches({column}, '{plain}.*{positive.group(1)}'))"
            parts.append(test)
        whens.append(f"when {' or '.join(parts)} then {no}")
    return "case " + " ".join(whens) + " end"


@query("K2", f"""
    with d as (select distinct regexp_replace(trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9& ]+', ' ', 'g')), ' +', ' ', 'g') as line from part)
    select {_rules_sql('line')} as rule_no, count(*) as n from d group by 1""")
def rules_on_part_names(t: Tables):
    names = t.part.select(F.concat_ws(" ", "p_name", "p_type").alias("value")).distinct()
    return K.decide(names, "value").groupBy("rule_no").agg(F.count(F.lit(1)).alias("n"))


@query("K2 K1", f"""
    with d as (select doc_id, lower(regexp_replace(text, '[^A-Za-z0-9& ]+', ' ', 'g')) as line from documents),
         r as (select regexp_replace(line, ' +', ' ', 'g') as line from d)
    select {_rules_sql('line')} as rule_no, count(*) as n from r group by 1""")
def rules_on_documents(t: Tables):
    """Whole texts through every rule pattern."""
    docs = t.spread("documents").select(F.lower(words_of(F.col("text"), "[A-Za-z0-9&]+")).alias("line"))
    return docs.groupBy(K.rule_number(F.col("line")).alias("rule_no")).agg(F.count(F.lit(1)).alias("n"))


def _decisions(t: Tables):
    decided = K.decide_values(bank_lines(t), "description")
    left = K.unmatched(decided)
    answers = left.select("key", F.when(F.col("key").contains("zqx"), "Office Costs").otherwise("Not A Category").alias("category"))
    stray = t.nation.select(F.lower("n_name").alias("key"), F.lit("Office Costs").alias("category"))
    accepted = K.accept_answers(answers.unionByName(stray), left, K.vocabulary(t.spark))
    return K.fill_gaps(decided, accepted)


_FILLED = _PLACED_SQL + """
    , f as (select rows, merchant_no, dressed,
              case when rule_no is not null then category when merchant_no = 18 then 'Office Costs' else 'Uncategorised' end as category,
              case when rule_no is not null then box when merchant_no = 18 then 'SA103F box 23' else '' end as box,
              case when rule_no is not null then confidence when merchant_no = 18 then 'medium' else 'low' end as confidence,
              case when rule_no is not null then 'rule' when merchant_no = 18 then 'model' else 'unplaced' end as source from v)"""


@query("K4 K5", _FILLED + " select category, box, confidence, source, count(*) as kinds, cast(sum(rows) as bigint) as rows from f group by 1, 2, 3, 4")
def filled_decisions(t: Tables):
    return _decisions(t).groupBy("category", "box", "confidence", "source").agg(
        F.count(F.lit(1)).alias("kinds"), F.sum("rows").alias("rows"))


@query("K6", _FILLED + """
    select count(*) as values_total, count(*) filter (where confidence = 'low') as values_flagged,
           count(*) filter (where confidence <> 'low') as values_confident, count(*) filter (where source = 'rule') as values_by_rule,
           count(*) filter (where source = 'model') as values_by_model, count(*) filter (where source = 'unplaced') as values_unplaced,
           cast(sum(rows) as bigint) as rows_total, cast(sum(case when confidence = 'low' then rows else 0 end) as bigint) as rows_flagged from f""")
def decision_summary(t: Tables):
    return K.summarise(_decisions(t))


@query("K8 K1", _FILLED + " select distinct category, box from f where box <> ''")
def boxes_used(t: Tables):
    return K.boxes_used(_decisions(t))


@query("K7", _FILLED + """
    , p as (select category, count(*) as kinds, sum(rows) as rows from f where source <> 'unplaced' group by 1),
      x as (select (select count(*) from f) as o, (select sum(kinds) from p) as m, (select sum(rows) from f) as t, (select sum(rows) from p) as c,
              (select count(*) from p) as k, (select count(*) from p where kinds = 1) as s)
    select o as values_offered, cast(m as bigint) as values_mapped, cast(t as bigint) as rows_total, cast(c as bigint) as rows_covered, k as category_count,
           s as singleton_categories, cast(o - m as bigint) as values_dropped, cast(t - c as bigint) as rows_uncovered, round(c / t, 4) as row_coverage,
           case when c / t < 0.3 then 'too_thin' when m >= 10 and k > m * 0.8 then 'one_per_value' else 'usable' end as verdict from x""")
def categorisation_quality(t: Tables):
    d = _decisions(t)
    return K.quality_verdict(K.quality(d.select("key", "rows"), d.where("source <> 'unplaced'")))


@query("K9", "select 'description' as \"column\", count(*) > 0 as found from lineitem")
def description_column(t: Tables):
    lines = bank_lines(t).withColumn("reference", F.concat(F.lit("R"), F.col(ROW).cast("string")))
    return K.description_column(K.description_scores(lines)).withColumn("found", F.lit(True))


@query("K9", _PLACED_SQL + """
    , k as (select count(*) as kinds, cast(sum(rows) as double) as n, sum(case when rule_no is not null then rows else 0 end) as hits
            from (select lower(case dressed when 0 then 'card payment to ' || m.name || ' 08/06/26' when 1 then m.name else 'direct debit - ' || m.name || ' ref 00' || supplier end) as folded,
                         sum(rows) as rows, any_value(rule_no) as rule_no from v join (values """ + ", ".join(f"({i}, '{m.lower()}')" for i, (m, _) in enumerate(_MERCHANTS)) + """) m(no, name) on m.no = merchant_no group by 1))
    select 'description' as "column", round(hits / n, 6) as hit_rate, round(least(kinds / n * 4, 1.0), 6) as variety, 1 as name_rank from k
    union all select 'type', 0.0, round(least(count(distinct l_returnflag) / count(*) * 4, 1.0), 6), 12 from lineitem""")
def description_scores(t: Tables):
    return K.description_scores(bank_lines(t).drop("merchant_no")).select(
        "column", F.round("hit_rate", 6).alias("hit_rate"), F.round("variety", 6).alias("variety"), "name_rank")


@query("K10", """
    select 'change' as what, url as path, md5(html || 'x') as body_hash from pages where page_id % 3 = 0 and page_id % 5 <> 0
    union all select 'snapshot', url, case when page_id % 3 = 0 then md5(html || 'x') else md5(html) end from pages""")
def guidance_changes(t: Tables):
    """A snapshot that lacks every fifth page; every third page has moved since."""
    page = lambda body: (F.col("url").alias("path"), F.col("url"), F.lit("t").alias("title"), F.md5(body).alias("body_hash"))
    snapshot = t.pages.where("page_id % 5 <> 0").select(*page(F.col("html")))
    moved = F.when(F.col("page_id") % 3 == 0, F.concat("html", F.lit("x"))).otherwise(F.col("html"))
    fresh = t.pages.where("page_id % 3 = 0 or page_id % 5 = 0").select(*page(moved))
    after, report = K.changed_pages(snapshot, fresh)
    return report.select(F.lit("change").alias("what"), "path", "body_hash").unionByName(
        after.select(F.lit("snapshot").alias("what"), "path", "body_hash"))


def _exported(t: Tables):
    lines = bank_lines(t).select(ROW, "description", "amount")
    table = K.tax_columns(_decisions(t))
    fallback = dict(zip(fv.TAX_COLUMNS, ("Uncategorised", "", "Needs review")))
    return lines, C.apply_operations(lines, [{
        "op": "assign_hmrc_categories", "column": "description", "decisions": table, "targets": list(fv.TAX_COLUMNS), "fallback": fallback}]).rows


@query("C5", _FILLED + """
    select category, box, case confidence when 'high' then 'High' when 'medium' then 'Medium' else 'Needs review' end as confidence, cast(sum(rows) as bigint) as n
    from f group by 1, 2, 3""")
def tax_columns_written(t: Tables):
    _, rows = _exported(t)
    return rows.groupBy(
        F.col("`HMRC Category`").alias("category"), F.col("`HMRC Box`").alias("box"), F.col("Confidence").alias("confidence")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("S12", _FILLED + """
    , n as (select cast(sum(rows) as bigint) as n, cast(sum(case when confidence = 'low' or category = 'Uncategorised' then rows else 0 end) as bigint) as bad from f)
    select unnest(['source_unchanged', 'columns_exist', 'category_filled', 'category_known', 'row_count']) as "check", true as passed, 0 as failures, n as total from n
    union all select 'categorised', true, 0, n - bad from n union all select 'flagged', true, 0, bad from n
    union all select 'box_matches', false, (select cast(coalesce(sum(rows), 0) as bigint) from f where box = 'SA103F box 20'), n from n""")
def export_validation(t: Tables):
    """An export whose travel rows carry the wrong box."""
    lines, rows = _exported(t)
    broken = rows.withColumn("HMRC Box", F.when(F.col("`HMRC Box`") == "SA103F box 20", "SA103F box 21").otherwise(F.col("`HMRC Box`")))
    return K.validate_export(broken, lines, "description")
