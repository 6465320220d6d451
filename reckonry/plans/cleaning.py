"""Cleaning steps, change logs and the review life of proposals."""

from pyspark.sql import functions as F

from reckonry.operators import clean as C
from reckonry.operators import proposals as R
from reckonry.plans.catalog import Tables, query
from reckonry.plans.quality import _RESPELLED, respelled_suppliers
from reckonry.plans.scalar_columns import spelled_dates, spelled_prices

ROW = "__source_row"


def _docs(t: Tables):
    return t.documents.select(F.col("doc_id").alias(ROW), "text", "lang", "source")


@query("C6", "select min(doc_id) as doc_id, count(*) > 0 as kept from documents group by text")
def drop_duplicates_first(t: Tables):
    return C.drop_duplicate_rows(_docs(t), ["text"]).select(F.col(ROW).alias("doc_id"), F.lit(True).alias("kept"))


@query("C6", "select max(doc_id) as doc_id, lang, source, count(*) > 0 as kept from documents group by text, lang, source")
def drop_duplicates_last(t: Tables):
    return C.drop_duplicate_rows(_docs(t), keep="last").select(
        F.col(ROW).alias("doc_id"), "lang", "source", F.lit(True).alias("kept"))


@query("C1 C2", """
    select upper(p_name) as name, count(*) as n from part group by 1""")
def tidy_names(t: Tables):
    raw = t.part.select(F.col("p_partkey").alias(ROW), F.concat(F.lit("  "), F.regexp_replace("p_name", " ", "   "), F.lit(" ")).alias("name"))
    done = C.apply_operations(raw, [
        {"op": "normalize_whitespace", "column": "name"}, {"op": "normalize_case", "column": "name", "style": "upper"}])
    return done.rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("C3 C11 M1", _RESPELLED + """
    select suggested as supplier, cast(sum(n) as bigint) as n, cast(sum(cents) as double) / 100 as net from w group by 1""")
def merge_spellings(t: Tables):
    """Apply the mapping the spellings propose."""
    from reckonry.operators.profile import entity_spellings

    data = respelled_suppliers(t)
    mapping = R.entity_mapping(entity_spellings(data, ["supplier"])).select("value", F.col("suggested").alias("canonical"))
    done = C.apply_operations(data, [{"op": "map_values", "column": "supplier", "mapping": mapping}])
    return done.rows.groupBy("supplier").agg(
        F.count(F.lit(1)).alias("n"),
        (F.sum(F.round(F.col("net_amount") * 100).cast("long")) / 100.0).alias("net"))


_PRIORITY = {"1-urgent": "Now", "2-high": "Now", "3-medium": "Soon"}


@query("C4", """
    select case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'Now' when o_orderpriority = '3-MEDIUM' then 'Soon'
                else 'Later' end as category, count(*) as n from orders group by 1""")
def assign_order_category(t: Tables):
    data = t.orders.withColumn(ROW, F.col("o_orderkey"))
    done = C.apply_operations(data, [{
        "op": "assign_category", "column": "o_orderpriority", "target": "category", "mapping": _PRIORITY, "fallback": "Later"}])
    return done.rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("C7 L4", """
    select spelling, count(*) as n, count(v) as readable, cast(coalesce(sum(cast(round(v * 100) as bigint)), 0) as double) / 100 as total
    from (select (l_orderkey + l_linenumber) % 9 as spelling,
            case (l_orderkey + l_linenumber) % 9 when 1 then -l_extendedprice when 3 then -l_extendedprice when 5 then -l_extendedprice
              when 7 then floor(l_extendedprice) when 8 then null else l_extendedprice end as v from lineitem) group by 1""")
def coerce_prices(t: Tables):
    raw = spelled_prices(t).withColumn(ROW, F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    done = C.apply_operations(raw, [{"op": "coerce_number", "column": "raw"}])
    return done.rows.groupBy("spelling").agg(
        F.count(F.lit(1)).alias("n"), F.count("raw").alias("readable"),
        (F.coalesce(F.sum(F.round(F.col("raw") * 100).cast("long")), F.lit(0)) / 100.0).alias("total"))


@query("C8 L5", """
    select strftime(o_orderdate, '%Y-%m-%d') as day, count(*) as n from orders group by 1""")
def normalize_order_dates(t: Tables):
    raw = spelled_dates(t).withColumn(ROW, F.col("o_orderkey"))
    done = C.apply_operations(raw, [{"op": "normalize_date", "column": "raw", "order": "dmy"}])
    return done.rows.groupBy(F.col("raw").alias("day")).agg(F.count(F.lit(1)).alias("n"))


_PIPELINE_SQL = """
    with base as (select o_orderkey as r, o_orderpriority as p, o_orderstatus as s from orders),
         n as (select count(*) as total, count(distinct (s, p)) as kinds,
                      count(*) filter (where p in ('1-URGENT', '5-LOW')) as mapped from base)
    select 0 as step, 'normalize_whitespace' as op, 'priority' as "column", total as rows_changed, 0 as rows_removed,
           0 as rows_unmatched, total as row_count, null as warning from n
    union all select 1, 'map_values', 'priority', mapped, 0, 0, total, case when mapped > total * 0.5 then
           'this mapping rewrote ' || mapped || ' of ' || total || ' rows' end from n
    union all select 2, 'normalize_case', 'missing', 0, 0, 0, total, 'column ''missing'' is not present; step skipped' from n
    union all select 3, 'drop_duplicate_rows', null, 0, total - kinds, 0, total, null from n
    union all select 4, 'review_outliers', 'priority', 0, 0, 0, kinds, null from n
    union all select 5, 'no_such_step', null, 0, 0, 0, kinds, 'unknown operation ''no_such_step''; skipped' from n"""


def _pipeline(t: Tables):
    data = t.orders.select(
        F.col("o_orderkey").alias(ROW), F.concat(F.lit(" "), "o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    return C.apply_operations(data, [
        {"op": "normalize_whitespace", "column": "priority"},
        {"op": "map_values", "column": "priority", "mapping": {"1-URGENT": "urgent", "5-LOW": "low"}},
        {"op": "normalize_case", "column": "missing"},
        {"op": "drop_duplicate_rows", "keep": "first"},
        {"op": "review_outliers", "column": "priority"},
        {"op": "no_such_step"},
    ])


@query("C9 C10 C11", _PIPELINE_SQL)
def cleaning_change_log(t: Tables):
    return _pipeline(t).log


@query("C10 C6", """
    select min(o_orderkey) as source_row, o_orderstatus as status,
           case o_orderpriority when '1-URGENT' then 'urgent' when '5-LOW' then 'low' else o_orderpriority end as priority
    from orders group by o_orderstatus, o_orderpriority""")
def cleaning_result(t: Tables):
    return _pipeline(t).rows.withColumnRenamed(ROW, "source_row")


@query("C11", """
    select o_orderkey as source_row, o_orderpriority as before,
           case o_orderpriority when '1-URGENT' then 'urgent' else 'low' end as after
    from orders where o_orderpriority in ('1-URGENT', '5-LOW') order by o_orderkey limit 5""")
def cleaning_samples(t: Tables):
    return _pipeline(t).samples(1)


# ---------------------------------------------------------------- review state


def _proposals(t: Tables):
    """One proposal per customer and order priority; money is what those orders hold."""
    g = t.orders.groupBy("o_custkey", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("affected_rows"),
        (F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / 100.0).alias("materiality"))
    tier = F.when(F.col("o_orderpriority") == "1-URGENT", "low").when(
        F.col("o_orderpriority") == "5-LOW", "high").otherwise("medium")
    step = F.when(tier == "low", "block_totals_mismatch").when(tier == "high", "coerce_number").when(
        F.col("o_orderpriority") == "2-HIGH", "review_outliers").otherwise("map_values")
    fresh = g.select(
        F.col("o_custkey").alias("dataset_version"), F.concat(step, F.lit(":"), "o_orderpriority").alias("group_key"),
        step.alias("step_type"), F.lit(None).cast("string").alias("column_name"), F.col("o_orderpriority").alias("title"),
        F.to_json(F.struct(step.alias("op"))).alias("operation"), F.lit("{}").alias("evidence"),
        tier.alias("confidence"), "affected_rows", "materiality")
    return R.store_pending(fresh, F.col("dataset_version"))


_PROPOSALS = """
    with p as (select o_custkey as dataset_version, o_orderpriority as priority,
                 case o_orderpriority when '1-URGENT' then 'low' when '5-LOW' then 'high' else 'medium' end as confidence,
                 case o_orderpriority when '1-URGENT' then 'block_totals_mismatch' when '5-LOW' then 'coerce_number'
                   when '2-HIGH' then 'review_outliers' else 'map_values' end as step_type,
                 count(*) as affected_rows, cast(sum(cast(round(o_totalprice * 100) as bigint)) as double) / 100 as materiality
               from orders group by 1, 2),
         q as (select *, step_type || ':' || priority as group_key from p)"""


@query("R8 O9", _PROPOSALS + """
    select dataset_version, group_key, confidence, materiality from q
    order by case confidence when 'low' then 0 when 'medium' then 1 else 2 end, materiality desc, affected_rows desc, group_key""")
def ranked_proposals(t: Tables):
    return R.rank(_proposals(t)).select("dataset_version", "group_key", "confidence", "materiality")


@query("R9", _PROPOSALS + """
    select count(*) as total, count(*) filter (where confidence = 'high') as auto, count(*) filter (where confidence = 'medium') as review,
           count(*) filter (where confidence = 'low') as blocking,
           cast(sum(case when confidence <> 'high' then cast(round(materiality * 100) as bigint) else 0 end) as double) / 100 as review_materiality,
           true as blocked, round(count(*) filter (where confidence = 'high') / count(*), 3) as automation_rate from q""")
def proposal_summary(t: Tables):
    return R.summarise(_proposals(t))


def _decided(t: Tables):
    stored = _proposals(t)
    now = F.lit("2026-08-31 09:00:00").cast("timestamp")
    ask = stored.select(
        "dataset_version", "group_key", (F.col("dataset_version") % 3 == 0).alias("approve"),
        F.lit("kim").alias("decided_by"), now.alias("decided_at"), F.lit("checked").alias("note"),
    ).where("dataset_version % 3 <> 2")
    decided = R.decide(stored, ask)
    rest = decided.where("status = 'pending'").select(
        "dataset_version", "group_key", F.lit(True).alias("approve"), F.lit("x").alias("decided_by"),
        now.alias("decided_at"), F.lit("y").alias("note"))
    return R.decide(decided, rest, automatic_note="approved by schedule")


_DECIDED = _PROPOSALS + """
    , s as (select *, case when dataset_version % 3 = 0 then 'approved' when dataset_version % 3 = 1 then 'rejected'
                    when confidence <> 'low' then 'approved' else 'pending' end as status,
                 case when dataset_version % 3 <> 2 then 'kim' end as decided_by,
                 case when dataset_version % 3 <> 2 then 'checked' when confidence <> 'low' then 'approved by schedule' end as note
            from q)"""


@query("R11", _DECIDED + """ select status, confidence, decided_by, note, count(*) as n from s group by 1, 2, 3, 4""")
def decided_proposals(t: Tables):
    return _decided(t).groupBy("status", "confidence", "decided_by", "note").agg(F.count(F.lit(1)).alias("n"))


@query("R12 R13", _DECIDED + """
    select dataset_version, count(*) filter (where status = 'pending' and confidence = 'low') as open_blocks,
           count(*) filter (where status = 'approved' and step_type in ('map_values', 'coerce_number')) as transforms,
           count(*) filter (where status = 'approved' and step_type in ('review_outliers', 'block_totals_mismatch')) as advisories,
           case when open_blocks > 0 then 'refused' when transforms > 0 then 'write_version' when advisories > 0 then 'acknowledge'
                else 'nothing_approved' end as outcome
    from s group by 1""")
def apply_gates(t: Tables):
    return R.apply_gate(_decided(t))


@query("R12", _DECIDED + """
    select case when status = 'approved' and step_type = 'map_values' then 'applied' else status end as status, count(*) as n from s group by 1""")
def applied_proposals(t: Tables):
    stored = _decided(t)
    applied = R.mark_applied(stored, stored.where("step_type = 'map_values'"))
    return applied.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("R10", _DECIDED + """
    select case when status = 'pending' then 'superseded' else status end as status, count(*) as n from s group by 1
    union all select 'pending', count(*) from q where dataset_version % 3 = 2""")
def superseded_proposals(t: Tables):
    fresh = _proposals(t).where("dataset_version % 3 = 2")
    both = R.supersede_and_insert(_decided(t), fresh, F.lit("2026-09-01 00:00:00").cast("timestamp"))
    return both.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("R10", _PROPOSALS + " select 'pending' as status, 2 * count(*) as n from q")
def appended_proposals(t: Tables):
    stored = _proposals(t)
    return R.append_pending(stored, stored).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("O9", _DECIDED + """
    select dataset_version, count(*) as pending, cast(sum(cast(round(materiality * 100) as bigint)) as double) / 100 as at_stake
    from s where status = 'pending' group by 1""")
def pending_at_stake(t: Tables):
    return R.pending_money(_decided(t))


@query("R7", """
    select l_suppkey as supplier, count(*) as affected_rows,
           cast(greatest(sum(cast(round(abs(l_extendedprice) * 100) as bigint)), sum(cast(round(abs(l_tax) * 100) as bigint))) as double) / 100 as materiality
    from lineitem where l_returnflag = 'R' group by 1""")
def money_at_stake(t: Tables):
    return R.money_at_stake(t.lineitem.where("l_returnflag = 'R'"), [F.col("l_suppkey").alias("supplier")])
