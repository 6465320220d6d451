"""Recipe capture, mapping resolution, replay and invariants over derived files."""

from pyspark.sql import functions as F

from reckonry.operators import profile as D
from reckonry.operators import recipes as M
from reckonry.plans.catalog import Tables, query
from reckonry.plans.sums import money_sum

ROW = "__source_row"
_NO = "cast(replace(p_brand, 'Brand#', '') as integer)"


def brand_lines(t: Tables):
    """Brands as typed this month: some canonical, some respelled, some misspelled, some new."""
    style = F.pmod("p_partkey", F.lit(4))
    brand = F.col("p_brand")
    typed = (
        F.when(style == 0, brand).when(style == 1, F.upper(brand))
        .when(style == 2, F.concat(F.regexp_replace(brand, "#", " "), F.lit(" Ltd")))
        .otherwise(F.regexp_replace(brand, "Brand", "Brannd")))
    number = F.regexp_replace(brand, "Brand#", "").cast("int")
    typed = F.when(number % 2 == 0, typed).otherwise(brand)
    return t.part.select(F.col("p_partkey").alias(ROW), typed.alias("brand"), F.col("p_retailprice").alias("net_amount"))


def brand_vocabulary(t: Tables):
    even = F.regexp_replace("p_brand", "Brand#", "").cast("int") % 2 == 0
    names = t.part.where(even).groupBy(F.col("p_brand").alias("value")).agg(F.min("p_partkey").alias("first_row"))
    return M.build_vocabulary(names)


_TYPED = f"""
    with s as (
      select p_partkey as r, {_NO} as no, p_brand as b, p_retailprice as p,
             case when {_NO} % 2 = 1 then p_brand when p_partkey % 4 = 0 then p_brand when p_partkey % 4 = 1 then upper(p_brand)
                  when p_partkey % 4 = 2 then replace(p_brand, '#', ' ') || ' Ltd' else replace(p_brand, 'Brand', 'Brannd') end as value
      from part),
    g as (select value, b, no, count(*) as rows, cast(sum(cast(round(p * 100) as bigint)) as double) / 100 as materiality from s group by 1, 2, 3),
    o as (select *, case when no % 2 = 0 and lower(value) = lower(b) then 'vocabulary'
                         when no % 2 = 0 then 'ambiguous_match' when no = 1 or no > 10 then 'ambiguous_match' else 'unmapped_value' end as outcome,
                 case when no % 2 = 0 then b when no = 1 or no between 11 and 19 then 'Brand#18' when no > 20 then 'Brand#2' end as best from g)"""


@query("M7 M8", _TYPED + """
    select value, lower(value) as key, rows, outcome, case when outcome = 'vocabulary' then b end as resolved,
           case when outcome = 'ambiguous_match' then best end as suggestion, materiality from o""")
def mapping_resolution(t: Tables):
    return M.resolve_values(brand_lines(t), "brand", brand_vocabulary(t), money="net_amount")


@query("M2", """
    with m as (select distinct 'Old ' || p_brand as value, p_brand as canonical from part),
         v as (select p_brand as value, p_brand as canonical from part group by 1)
    select lower(value) as source_key, value as source_value, canonical as canonical_value, true as confirmed from m
    union all select lower(value), value, canonical, false from v""")
def vocabulary_build(t: Tables):
    brands = t.part.groupBy(F.col("p_brand").alias("value")).agg(F.min("p_partkey").alias("first_row"))
    merges = brands.select(F.concat(F.lit("Old "), "value").alias("value"), F.col("value").alias("canonical"))
    respelled = brands.select(F.concat(F.lit(" "), F.upper("value")).alias("value"), (F.col("first_row") + 1000000000).alias("first_row"))
    return M.build_vocabulary(brands.unionByName(respelled), merges)


def _mapping_table(t: Tables):
    return t.customer.where("c_custkey % 2 = 0").select(
        F.lower("c_name").alias("source_key"), F.col("c_name").alias("source_value"), F.lit("kept").alias("canonical_value"),
        F.when(F.col("c_custkey") % 4 == 0, "kim").alias("confirmed_by"), F.lit(3).cast("long").alias("hit_count"))


_UPSERT = """
    select lower(c_name) as source_key, c_name as source_value, case when c_custkey % 2 = 0 then 'kept' else 'new' end as canonical_value,
           case when c_custkey % 4 = 0 then 'kim' when c_custkey % 3 = 0 then 'lee' end as confirmed_by,
           case when c_custkey % 2 = 0 then 3 else 0 end as hit_count
    from customer where c_custkey % 2 = 0 or c_custkey % 3 = 0"""


@query("M3", _UPSERT)
def mapping_upsert(t: Tables):
    entries = t.customer.where("c_custkey % 3 = 0").select(
        F.concat(F.lit(" "), F.upper("c_name")).alias("source_key"), F.col("c_name").alias("source_value"),
        F.lit("new").alias("canonical_value"), F.lit("lee").alias("confirmed_by"))
    return M.upsert_mapping(_mapping_table(t), entries)


@query("M4", """
    select hit_count, count(*) as n from (
      select case when c_custkey in (select o_custkey from orders) then 4 else 3 end as hit_count from customer where c_custkey % 2 = 0) group by 1""")
def mapping_hits(t: Tables):
    keys = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.lower("c_name").alias("source_key"))
    return M.record_hits(_mapping_table(t), keys).groupBy("hit_count").agg(F.count(F.lit(1)).alias("n"))


def _steps():
    return [
        {"id": "step_01", "op": "normalize_whitespace", "params": {"column": "brand"}},
        {"id": "step_02", "op": "map_values", "params": {"column": "brand", "mapping_table_id": "brands"}},
        {"id": "step_03", "op": "review_outliers", "params": {"column": "net_amount"}},
        {"id": "step_04", "op": "normalize_case", "params": {"column": "region"}},
        {"id": "step_05", "op": "coerce_number", "params": {"column": "net_amount"}, "enabled": False},
    ]


def _replayed(t: Tables):
    return M.replay(brand_lines(t), _steps(), {"brands": brand_vocabulary(t)}, "net_amount", expected=["brand"])


@query("M10 M9 M19", _TYPED + """
    select outcome as type, 'review' as severity, case outcome when 'ambiguous_match' then 'ambiguous:brand:' else 'unmapped:brand:' end || lower(value) as group_key,
           'brand' as column_name, value as source_value, case when outcome = 'ambiguous_match' then best end as suggested_value, rows as affected_rows, materiality
    from o where outcome <> 'vocabulary'
    union all select 'missing_column', 'block', 'missing_column:region', 'region', null, null, 0, null
    union all select 'new_column', 'review', 'new_column', null, null, null, 0, null""")
def replay_deviations(t: Tables):
    return _replayed(t).deviations.drop("title")


@query("M10 C3", _TYPED + """
    select case when outcome = 'vocabulary' then b else value end as brand, cast(sum(rows) as bigint) as n from o group by 1""")
def replayed_rows(t: Tables):
    return _replayed(t).cleaned.rows.groupBy("brand").agg(F.count(F.lit(1)).alias("n"))


@query("M11", _TYPED + """
    , x as (select sum(rows) as total, sum(rows) filter (where outcome <> 'vocabulary') as touched,
              count(*) filter (where outcome <> 'vocabulary') as n,
              sum(cast(round(materiality * 100) as bigint)) filter (where outcome <> 'vocabulary') as cents,
              coalesce(sum(rows) filter (where outcome = 'vocabulary' and value <> b), 0) as fixed from o)
    select cast(total as bigint) as rows_processed, cast(total - touched as bigint) as rows_matched, cast(fixed as bigint) as auto_corrections,
           n + 2 as deviations, 1 as block, n + 1 as review, cast(cents as double) / 100 as review_materiality,
           round(1 - touched / total, 4) as automation_rate from x""")
def replay_figures(t: Tables):
    return _replayed(t).summary()


@query("M12", """
    select 'row_count' as id, 'row_count_within' as type, null as "column", null as columns, cast(count(*) as double) as baseline, 60.0 as tolerance_pct, null as expected, 'review' as severity from lineitem
    union all select 'required_columns', 'columns_present', null, 'l_extendedprice,l_shipdate,l_returnflag', null, null, null, 'block'
    union all select 'total_l_extendedprice', 'total_within', 'l_extendedprice', null, round(sum(l_extendedprice), 2), 200.0, null, 'review' from lineitem
    union all select 'type_l_extendedprice', 'column_type', 'l_extendedprice', null, null, null, 'number', 'block'
    union all select 'type_l_shipdate', 'column_type', 'l_shipdate', null, null, null, 'date', 'block'""")
def invariants_from_profile(t: Tables):
    profile = D.profile_columns(t.lineitem.select("l_extendedprice", "l_shipdate", "l_returnflag"), row=None)
    return M.default_invariants(profile).withColumn("columns", F.when(F.col("columns").isNotNull(), F.concat_ws(",", "columns")))


def _next_month(t: Tables):
    """A later file: far fewer rows, one column gone, one column drifted to text."""
    return t.lineitem.where("l_returnflag = 'R'").select(
        "l_extendedprice", F.date_format("l_shipdate", "dd/MM/yyyy").alias("l_shipdate"), F.col("l_quantity").cast("string").alias("l_quantity"))


def _outcomes(t: Tables):
    base = t.lineitem.agg(F.count(F.lit(1)).alias("n"), money_sum(F.col("l_extendedprice")).alias("s")).first()
    return M.check_invariants(_next_month(t), [
        dict(id="row_count", type="row_count_within", column=None, columns=None, baseline=float(base.n), tolerance_pct=60.0, expected=None, severity="review"),
        dict(id="required", type="columns_present", column=None, columns=["l_extendedprice", "l_returnflag"], baseline=None, tolerance_pct=None, expected=None, severity="block"),
        dict(id="total", type="total_within", column="l_extendedprice", columns=None, baseline=float(base.s), tolerance_pct=50.0, expected=None, severity="review"),
        dict(id="date", type="column_type", column="l_shipdate", columns=None, baseline=None, tolerance_pct=None, expected="date", severity="block"),
        dict(id="number", type="column_type", column="l_quantity", columns=None, baseline=None, tolerance_pct=None, expected="number", severity="block"),
    ])


_OUTCOMES = """
    with b as (select count(*) as n, cast(sum(cast(round(l_extendedprice * 100) as bigint)) as double) / 100 as s from lineitem),
         f as (select count(*) as n, cast(sum(cast(round(l_extendedprice * 100) as bigint)) as double) / 100 as s from lineitem where l_returnflag = 'R'),
         c as (
    select 'row_count' as id, 'row_count_within' as type, null as "column", cast(b.n as double) as baseline, cast(f.n as double) as actual, null as missing,
           f.n between b.n * 0.4 and b.n * 1.6 as passed, 'review' as severity from b, f
    union all select 'required', 'columns_present', null, null, null, 'l_returnflag', false, 'block'
    union all select 'total', 'total_within', 'l_extendedprice', b.s, f.s, null, f.s between b.s * 0.5 and b.s * 1.5, 'review' from b, f
    union all select 'date', 'column_type', 'l_shipdate', null, null, null, false, 'block'
    union all select 'number', 'column_type', 'l_quantity', null, null, null, true, 'block')"""


@query("M13 M14 M15 M16", _OUTCOMES + " select * from c")
def invariant_outcomes(t: Tables):
    return _outcomes(t)


@query("M13 M14 M15 M16", _OUTCOMES + """
    select case type when 'columns_present' then 'missing_column' when 'column_type' then 'type_drift' else 'invariant_failure' end as type, severity,
           case id when 'row_count' then 'invariant:row_count' when 'required' then 'invariant:columns_present' when 'total' then 'invariant:total:l_extendedprice'
             else 'invariant:type:' || "column" end as group_key,
           case when type = 'total_within' then round(abs(actual - baseline), 2) end as materiality
    from c where not passed""")
def invariant_failures(t: Tables):
    return M.invariant_deviations(_outcomes(t)).select("type", "severity", "group_key", "materiality")


def _runs(t: Tables):
    """Customers' files as runs; their orders are the deviations."""
    runs = t.customer.select(F.col("c_custkey").alias("run_id"), F.col("c_nationkey").alias("input_version"))
    severity = F.when(F.col("o_orderpriority") == "1-URGENT", "block").when(F.col("o_orderpriority") == "5-LOW", "auto").otherwise("review")
    deviations = t.orders.select(F.col("o_custkey").alias("run_id"), severity.alias("severity"), F.col("o_orderpriority").alias("group_key"))
    settled = t.nation.select(
        F.col("n_nationkey").alias("input_version"), F.explode(F.array(F.lit("1-URGENT"), F.lit("2-HIGH"), F.lit("3-MEDIUM"))).alias("group_key"),
        F.when(F.col("n_nationkey") % 2 == 0, "accepted").otherwise("pending").alias("resolution"))
    return deviations, runs, settled


@query("M17", """
    with d as (select o_custkey as run_id, o_orderpriority as k, case o_orderpriority when '1-URGENT' then 'block' when '5-LOW' then 'auto' else 'review' end as severity from orders),
         o as (select c_custkey as run_id, c_nationkey as input_version,
                 count(k) filter (where not (c_nationkey % 2 = 0 and k in ('1-URGENT', '2-HIGH', '3-MEDIUM'))) as outstanding,
                 coalesce(bool_or(severity = 'block' and not (c_nationkey % 2 = 0)), false) as blocks,
                 coalesce(bool_or(severity = 'review' and not (c_nationkey % 2 = 0 and k in ('2-HIGH', '3-MEDIUM'))), false) as reviews
               from customer left join d on run_id = c_custkey group by 1, 2)
    select run_id, input_version, outstanding, case when blocks then 'blocked' when reviews then 'needs_review' else 'succeeded' end as status,
           not blocks and not reviews as writes_version from o""")
def run_verdicts(t: Tables):
    return M.run_verdicts(*_runs(t))


@query("M18 M3", _TYPED + """
    select lower(b) as source_key, b as source_value, b as canonical_value, null as confirmed_by, 0 as hit_count from (select distinct b from o where no % 2 = 0)
    union all select lower(value), value, best, 'kim', 0 from o where outcome = 'ambiguous_match'""")
def deviation_write_back(t: Tables):
    vocabulary = brand_vocabulary(t)
    found = M.value_deviations(M.resolve_values(brand_lines(t), "brand", vocabulary), "brand")
    decisions = found.select(
        "group_key", F.when(F.col("suggested_value").isNotNull(), "mapped").otherwise("ignored").alias("resolution"),
        F.col("suggested_value").alias("resolved_value"), F.lit("kim").alias("resolved_by"))
    table = vocabulary.select("source_key", "source_value", "canonical_value", F.lit(None).cast("string").alias("confirmed_by"), F.lit(0).cast("long").alias("hit_count"))
    return M.write_back(table, M.resolve_deviations(found, decisions))


def _recipes(t: Tables):
    """Customers as recipes; their orders by date as versions; order lines as runs."""
    versions = t.orders.select(
        F.col("o_custkey").alias("recipe_id"), F.col("o_orderkey").alias("recipe_version_id"), F.col("o_orderkey").alias("version_no"),
        F.col("o_orderpriority").alias("steps"), F.col("o_orderstatus").alias("invariants"))
    current = versions.groupBy("recipe_id").agg(F.max("recipe_version_id").alias("current_version_id"))
    recipes = t.customer.join(current, F.col("c_custkey") == F.col("recipe_id")).select(
        "recipe_id", F.col("c_name").alias("recipe_name"), F.col("c_nationkey").alias("workspace_id"),
        F.sha2(F.col("c_name"), 256).alias("source_signature"), (F.col("c_acctbal") > 0).alias("enabled"), "current_version_id")
    runs = t.lineitem.select(F.col("l_orderkey").alias("recipe_version_id"))
    return recipes, versions, runs


@query("M5", """
    with cur as (select o_custkey, max(o_orderkey) as v from orders group by 1)
    select c_nationkey as workspace_id, c_name as name, c_custkey as recipe_id, o_orderkey as recipe_version_id, o_orderpriority as steps,
           o_orderstatus as invariants, (select count(*) from lineitem where l_orderkey = o_orderkey) as run_count
    from customer join cur on o_custkey = c_custkey join orders on o_orderkey = v where c_acctbal > 0""")
def recipe_match(t: Tables):
    """Files of all customers arrive, and files of suppliers that no recipe knows."""
    recipes, versions, runs = _recipes(t)
    arrivals = t.customer.select(F.col("c_nationkey").alias("workspace_id"), F.sha2("c_name", 256).alias("source_signature")).unionByName(
        t.supplier.select(F.col("s_nationkey").alias("workspace_id"), F.sha2("s_name", 256).alias("source_signature")))
    return M.match_recipes(arrivals, recipes, versions, runs).select(
        "workspace_id", F.col("recipe_name").alias("name"), "recipe_id", "recipe_version_id", "steps", "invariants", "run_count")


@query("M6", """
    with l as (select o_custkey, max(o_orderkey) as n, max_by(o_orderpriority, o_orderkey) as s, max_by(o_orderstatus, o_orderkey) as i from orders group by 1)
    select 'capture' as way, c_custkey as recipe_id, coalesce(n, 0) + 1 as version_no, '3-MEDIUM' as steps, 'x' as invariants from customer left join l on o_custkey = c_custkey
      where s is null or s <> '3-MEDIUM'
    union all select 'edit', c_custkey, n + 1, '3-MEDIUM', i from customer join l on o_custkey = c_custkey""")
def recipe_versions(t: Tables):
    _, versions, _ = _recipes(t)
    asked = t.customer.select(F.col("c_custkey").alias("recipe_id"), F.lit("3-MEDIUM").alias("steps"), F.lit("x").alias("invariants"))
    captured = M.capture_versions(versions, asked).select(F.lit("capture").alias("way"), "*")
    return captured.unionByName(M.edit_versions(versions, asked.drop("invariants")).select(F.lit("edit").alias("way"), "*"))


@query("M1", """
    with p as (select o_orderpriority as k, count(*) as n from orders group by 1), r as (select *, row_number() over (order by k) as i from p)
    select 'step_0' || i as id, case when i = 1 then 'map_values' else 'normalize_case' end as op,
           case when i = 1 then '{"column":"brand"}' else '{"column":"' || k || '"}' end as params,
           case when i = 1 then 'brands' end as mapping_table_id,
           case i when 1 then 'review' when 2 then 'auto' when 3 then 'block' else 'review' end as confidence_tier, k as group_key
    from r""")
def recipe_steps(t: Tables):
    kinds = t.orders.groupBy(F.col("o_orderpriority").alias("group_key")).agg(F.count(F.lit(1)).alias("n"))
    no = F.substring("group_key", 1, 1).cast("int")
    operation = F.when(no == 1, F.lit('{"op":"map_values","column":"brand","mapping":{"a":"b"}}')).otherwise(
        F.concat(F.lit('{"op":"normalize_case","column":"'), "group_key", F.lit('"}')))
    confidence = F.when(no == 2, "high").when(no == 3, "low").otherwise("medium")
    applied = kinds.select(no.alias("order_no"), operation.alias("operation"), confidence.alias("confidence"), "group_key")
    tables = t.part.agg(F.lit("brand").alias("column"), F.lit("brands").alias("mapping_table_id"))
    return M.capture_steps(applied, tables).drop("on_ambiguous", "enabled")
