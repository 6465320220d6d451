"""Turn profile signals into ranked cleaning proposals, and track what people decide.

Tiers: ``high`` can apply by itself, ``medium`` waits for a person, ``low`` blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from reckonry.functions import fixed_values as fv
from reckonry.operators import profile as D
from reckonry.plans.sums import cents, units

SCHEMA = (
    "group_key string, step_type string, column_name string, title string, operation string, "
    "evidence string, confidence string, affected_rows long, materiality double"
)
TIER_RANK = "case confidence when 'low' then 0 when 'medium' then 1 else 2 end"
OPERATIONS = (*fv.TRANSFORM_OPERATIONS, *fv.ADVISORY_OPERATIONS)


def _proposal(
    group_key: Column, step: str, column: Column | None, title: Column, operation: dict[str, Column],
    confidence: str, affected: Column, materiality: Column | None = None, evidence: dict[str, Column] | None = None,
) -> list[Column]:
    def as_json(fields: dict[str, Column]) -> Column:
        return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))

    none = F.lit(None)
    return [
        group_key.alias("group_key"), F.lit(step).alias("step_type"),
        (none if column is None else column).cast("string").alias("column_name"), title.alias("title"),
        as_json({"op": F.lit(step), **operation}).alias("operation"),
        (as_json(evidence) if evidence else F.lit("{}")).alias("evidence"),
        F.lit(confidence).alias("confidence"), affected.cast("long").alias("affected_rows"),
        (none if materiality is None else materiality).cast("double").alias("materiality"),
    ]


def automatic(profile: DataFrame) -> DataFrame:
    """Whitespace, number and date reading: no judgement involved."""
    name, kind = F.col("column"), F.col("inferred_type")
    spaces = profile.where((kind == "text") & (F.col("whitespace_issues") > 0)).select(*_proposal(
        F.concat(F.lit("whitespace:"), name), "normalize_whitespace", name,
        F.concat(F.lit("Trim whitespace in "), F.col("source_header")), {"column": name}, "high",
        F.col("whitespace_issues")))
    numbers = profile.where((kind == "number") & (F.size(F.coalesce("number_styles", F.array())) > 0)).select(*_proposal(
        F.concat(F.lit("number:"), name), "coerce_number", name,
        F.concat(F.lit("Read "), F.col("source_header"), F.lit(" as a number")),
        {"column": name, "styles": F.col("number_styles")}, "high", F.col("non_null"),
        evidence={"styles": F.col("number_styles"), "total": F.col("total"), "negatives": F.col("negative_count")}))
    dates = profile.where((kind == "date") & F.col("date_order").isNotNull()).select(*_proposal(
        F.concat(F.lit("date:"), name), "normalize_date", name,
        F.concat(F.lit("Write "), F.col("source_header"), F.lit(" as ISO dates")),
        {"column": name, "order": F.col("date_order")}, "high", F.col("non_null"),
        evidence={"earliest": F.col("earliest"), "latest": F.col("latest")}))
    return spaces.unionByName(numbers).unionByName(dates)


def duplicates(summary: DataFrame) -> DataFrame:
    return summary.where("duplicate_rows > 0").select(*_proposal(
        F.lit("duplicates:exact"), "drop_duplicate_rows", None,
        F.concat(F.lit("Remove "), F.col("duplicate_rows"), F.lit(" exact duplicate row(s)")),
        {"keep": F.lit("first")}, "medium", F.col("duplicate_rows"), F.col("materiality"),
        {"group_count": F.col("group_count")}))


def conflicts(summary: DataFrame, key: str) -> DataFrame:
    return summary.where("group_count > 0").select(*_proposal(
        F.lit("duplicates:key_conflict"), "review_key_conflicts", F.lit(key),
        F.concat(F.col("group_count"), F.lit(" identifier(s) appear on rows that disagree")),
        {"column": F.lit(key)}, "medium", F.col("affected_rows"), F.col("materiality"),
        {"group_count": F.col("group_count")}))


def entity_merges(spellings: DataFrame, stakes: DataFrame, max_groups: int | None = None) -> DataFrame:
    """One merge per column.  The mapping itself stays a table (:func:`entity_mapping`):
    it can be larger than one row should hold.
    ``max_groups`` limits the groups that take part, first keys first.
    """
    used = entity_mapping(spellings, max_groups).join(stakes, ["column", "value"], "left")
    money = [c for c in stakes.columns if c.startswith("__m")]
    most = _largest([F.coalesce(F.sum(c), F.lit(0)) for c in money])
    per_column = used.groupBy("column").agg(
        F.count_distinct("key").alias("groups"), F.count(F.lit(1)).alias("spellings"),
        F.sum("n").alias("affected"), most.alias("materiality"))
    return per_column.select(*_proposal(
        F.concat(F.lit("entity:"), F.col("column")), "map_values", F.col("column"),
        F.concat(F.lit("Merge "), F.col("groups"), F.lit(" spelling group(s) in "), F.col("column")),
        {"column": F.col("column")}, "medium", F.col("affected"), F.col("materiality"),
        {"groups": F.col("groups"), "spellings": F.col("spellings")}))


def entity_mapping(spellings: DataFrame, max_groups: int | None = None) -> DataFrame:
    """value -> suggested for every spelling that would change."""
    if max_groups is not None:
        heads = spellings.groupBy("column", "key").agg(F.min("first_row").alias("head"))
        order = Window.partitionBy("column").orderBy("head", "key")
        heads = heads.withColumn("g", F.row_number().over(order)).where(F.col("g") <= max_groups)
        spellings = spellings.join(heads.select("column", "key"), ["column", "key"], "left_semi")
    return spellings.where(F.col("value") != F.col("suggested"))


def _largest(sums: list[Column]) -> Column:
    if not sums:
        return F.lit(None).cast("double")
    return units(F.nullif(sums[0] if len(sums) == 1 else F.greatest(*sums), F.lit(0)))


def money_at_stake(df: DataFrame, group: list[Column], money: list[str] | None = None) -> DataFrame:
    """Per group of rows: the sum of absolute money, for the column where that is largest."""
    money = D.money_columns(df) if money is None else money
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("affected_rows"),
        _largest([F.coalesce(F.sum(F.abs(cents(F.col(c)))), F.lit(0)) for c in money]).alias("materiality"))


def _value_stakes(df: DataFrame, text: list[str]) -> DataFrame:
    """Absolute money per (column, value), unpivoted so one pass serves all text columns."""
    money = D.money_columns(df)
    wide = df.select(*[F.col(c).cast("string").alias(c) for c in text],
                     *[F.abs(cents(F.col(c))).alias(f"__m{i}") for i, c in enumerate(money)])
    sums = [f"__m{i}" for i in range(len(money))]
    long = wide.unpivot(sums, text, "column", "value")
    return long.groupBy("column", "value").agg(*([F.sum(m).alias(m) for m in sums] or [F.lit(0).alias("z")]))


def stray_dates(df: DataFrame, date: str, ambiguous: int, order: str | None) -> DataFrame:
    """Rows outside a month that dominates a column of day/month-ambiguous dates."""
    if not ambiguous:
        return df.sparkSession.createDataFrame([], SCHEMA)
    day = F.col(date).cast("date")
    months = money_at_stake(df.where(day.isNotNull()), [F.date_format(day, "yyyy-MM").alias("month")])
    lead = months.agg(
        F.max_by("month", F.struct("affected_rows", "month")).alias("dominant"),
        F.max("affected_rows").alias("dominant_rows"), F.count(F.lit(1)).alias("months"))
    outside = months.join(F.broadcast(lead), F.lit(True)).where(F.col("month") != F.col("dominant"))
    total = outside.groupBy("dominant", "dominant_rows", "months").agg(
        F.sum("affected_rows").alias("stray"), F.sum("materiality").alias("materiality"))
    usable = (F.col("months") >= 2) & (F.col("dominant_rows") >= 3) & (F.col("stray") <= F.col("dominant_rows") / 2)
    return total.where(usable).select(*_proposal(
        F.lit(f"date_ambiguity:{date}"), "review_ambiguous_dates", F.lit(date),
        F.concat(F.col("stray"), F.lit(" date(s) fall outside "), F.col("dominant"), F.lit(" and may be month-first")),
        {"column": F.lit(date), "assumed_order": F.lit(order), "dominant_period": F.col("dominant")},
        "medium", F.col("stray"), F.col("materiality")))


def stray_date_rows(df: DataFrame, date: str) -> DataFrame:
    """The suspect rows themselves, with the text they were read from when it was kept."""
    day = F.date_format(F.col(date).cast("date"), "yyyy-MM")
    lead = df.where(day.isNotNull()).groupBy(day.alias("m")).agg(F.count(F.lit(1)).alias("n")).agg(
        F.max_by("m", F.struct("n", "m")).alias("dominant"))
    raw = F.col(f"__raw_{date}") if f"__raw_{date}" in df.columns else F.lit(None).cast("string")
    return df.join(F.broadcast(lead), F.lit(True)).where(day != F.col("dominant")).select(
        F.col(D.SOURCE_ROW).alias("source_row"), raw.alias("raw"), F.col(date).cast("string").alias("read_as"))


def totals_mismatch(checks: DataFrame) -> DataFrame:
    bad = checks.where("not reconciles").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.abs("difference")).alias("most"),
        F.array_sort(F.collect_list(F.struct("column", "computed", "declared", "difference"))).alias("checks"))
    return bad.where("n > 0").select(*_proposal(
        F.lit("invariant:declared_totals"), "block_totals_mismatch", None,
        F.concat(F.lit("Totals do not reconcile in "), F.col("n"), F.lit(" column(s)")),
        {"checks": F.col("checks")}, "low", F.lit(0), F.round("most", 2)))


def rate_anomalies(df: DataFrame, net: str, tax: str, rates=fv.STANDARD_TAX_RATES) -> DataFrame:
    odd = money_at_stake(D.row_rates(df, net, tax, rates).where("not is_standard"), [], D.money_columns(df))
    return odd.where("affected_rows > 0").select(*_proposal(
        F.lit("vat:rate_anomaly"), "review_vat_rate", F.lit(tax),
        F.concat(F.col("affected_rows"), F.lit(" row(s) have a rate outside the standard bands")),
        {"net_column": F.lit(net), "vat_column": F.lit(tax)}, "medium", F.col("affected_rows"), F.col("materiality")))


def outliers(summary: DataFrame) -> DataFrame:
    return summary.where("outliers > 0").select(*_proposal(
        F.concat(F.lit("outlier:"), F.col("column")), "review_outliers", F.col("column"),
        F.concat(F.col("outliers"), F.lit(" unusually large value(s) in "), F.col("column")),
        {"column": F.col("column"), "low": F.col("low"), "high": F.col("high")}, "medium",
        F.col("outliers"), F.col("materiality")))


def rank(proposals: DataFrame) -> DataFrame:
    """Known operations only; blocks first, then money, then rows."""
    return proposals.where(F.get_json_object("operation", "$.op").isin(*OPERATIONS)).orderBy(
        F.expr(TIER_RANK), F.coalesce("materiality", F.lit(0.0)).desc(), F.desc("affected_rows"), "group_key")


def build_proposals(
    df: DataFrame, meta: DataFrame | None = None, checks: DataFrame | None = None,
    profile: DataFrame | None = None, rates=fv.STANDARD_TAX_RATES,
) -> DataFrame:
    """All proposals for one stored table.

    The profile (one row per column) is collected once: its facts choose which
    signals have to run.
    """
    types = D.stored_types(df)
    profile = profile if profile is not None else D.profile_columns(df, meta=meta, types=types)
    spark = df.sparkSession
    facts = profile.orderBy("position").collect()
    frozen = spark.createDataFrame(facts, profile.schema)
    parts = [automatic(frozen), duplicates(D.exact_duplicates(df))]

    key = next((r for r in facts if r.is_key and r.inferred_type in ("text", "number") and r.distinct_count > 1), None)
    if key:
        parts.append(conflicts(D.key_conflict_summary(df, key.column), key.column))
    text = [r.column for r in facts if r.inferred_type == "text" and r.non_null and r.distinct_count / r.non_null <= 0.9]
    if text:
        parts.append(entity_merges(D.entity_spellings(df, text), _value_stakes(df, text)))
    date = next((r for r in facts if r.inferred_type == "date" and r.non_null), None)
    if date:
        parts.append(stray_dates(df, date.column, date.ambiguous_dates, date.date_order))
    if checks is not None:
        parts.append(totals_mismatch(checks))
    numbers = [r.column for r in facts if r.inferred_type == "number"]
    net = next((c for c in numbers if any(h in c for h in fv.NET_HINTS) and "vat" not in c), None)
    tax = next((c for c in numbers if any(h in c for h in fv.TAX_HINTS)), None)
    if net and tax:
        parts.append(rate_anomalies(df, net, tax, rates))
    money = [r.column for r in facts if r.inferred_type == "number" and r.is_money]
    if money:
        parts.append(outliers(D.outlier_summary(df, money)))
    return rank(reduce(lambda a, b: a.unionByName(b), parts))


def summarise(proposals: DataFrame) -> DataFrame:
    tier = F.col("confidence")
    waiting = F.sum(F.when(tier != "high", F.coalesce(cents(F.col("materiality")), F.lit(0))).otherwise(0))
    total = F.count(F.lit(1))
    return proposals.agg(
        total.alias("total"), F.count_if(tier == "high").alias("auto"), F.count_if(tier == "medium").alias("review"),
        F.count_if(tier == "low").alias("blocking"),
        units(F.coalesce(waiting, F.lit(0))).alias("review_materiality"),
        F.coalesce(F.bool_or(tier == "low"), F.lit(False)).alias("blocked"),
        F.coalesce(F.round(F.count_if(tier == "high") / F.nullif(total, F.lit(0)), 3), F.lit(1.0)).alias("automation_rate"))


# ---------------------------------------------------------------- review state
# A stored proposal also has dataset_version, status, decided_by, decided_at, note.


def store_pending(proposals: DataFrame, version: Column) -> DataFrame:
    none = F.lit(None)
    return proposals.select(
        version.alias("dataset_version"), *[F.col(c) for c in proposals.columns if c != "dataset_version"],
        F.lit("pending").alias("status"), none.cast("string").alias("decided_by"),
        none.cast("timestamp").alias("decided_at"), none.cast("string").alias("note"))


def supersede_and_insert(stored: DataFrame, fresh: DataFrame, now: Column) -> DataFrame:
    """A new analysis of a version retires what was still pending for it."""
    redone = fresh.select("dataset_version").distinct().withColumn("__redone", F.lit(True))
    retire = F.col("__redone").isNotNull() & (F.col("status") == "pending")
    old = stored.join(redone, "dataset_version", "left").withColumns({
        "decided_at": F.when(retire, now).otherwise(F.col("decided_at")),
        "note": F.when(retire, "superseded by a newer analysis").otherwise(F.col("note")),
        "status": F.when(retire, "superseded").otherwise(F.col("status")),
    }).drop("__redone")
    return old.unionByName(fresh)


def append_pending(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    return stored.unionByName(fresh)


def decide(stored: DataFrame, decisions: DataFrame, automatic_note: str | None = None) -> DataFrame:
    """Apply ``decisions(dataset_version, group_key, approve, decided_by, decided_at, note)``.

    With ``automatic_note`` the approvals come from the system: they carry that
    note, name nobody, and never pass a blocking finding.
    """
    d = decisions.select(
        "dataset_version", "group_key", "approve", F.col("decided_by").alias("__by"),
        F.col("decided_at").alias("__at"), F.col("note").alias("__note"))
    hit = (F.col("status") == "pending") & F.col("approve").isNotNull()
    by, note = F.col("__by"), F.col("__note")
    if automatic_note is not None:
        if not automatic_note.strip():
            raise ValueError("an automatic approval must record why it was automatic")
        hit = hit & F.col("approve") & (F.col("confidence") != "low")
        by, note = F.lit(None).cast("string"), F.lit(automatic_note)
    verdict = F.when(F.col("approve"), "approved").otherwise("rejected")
    joined = stored.join(d, ["dataset_version", "group_key"], "left").withColumn("__hit", hit)
    return joined.select(*[
        {"status": F.when(F.col("__hit"), verdict).otherwise(F.col("status")),
         "decided_by": F.when(F.col("__hit"), by).otherwise(F.col("decided_by")),
         "decided_at": F.when(F.col("__hit"), F.col("__at")).otherwise(F.col("decided_at")),
         "note": F.when(F.col("__hit"), note).otherwise(F.col("note"))}.get(c, F.col(c)).alias(c)
        for c in stored.columns
    ])


def mark_applied(stored: DataFrame, keys: DataFrame) -> DataFrame:
    done = keys.select("dataset_version", "group_key").distinct().withColumn("__done", F.lit(True))
    joined = stored.join(done, ["dataset_version", "group_key"], "left")
    applied = F.col("__done").isNotNull() & (F.col("status") == "approved")
    return joined.withColumn("status", F.when(applied, "applied").otherwise(F.col("status"))).select(*stored.columns)


def apply_gate(stored: DataFrame) -> DataFrame:
    """Per version: may the approved changes run, and do they move any data?"""
    advisory = F.col("step_type").isin(*fv.ADVISORY_OPERATIONS)
    approved = F.col("status") == "approved"
    gate = stored.groupBy("dataset_version").agg(
        F.count_if((F.col("status") == "pending") & (F.col("confidence") == "low")).alias("open_blocks"),
        F.count_if(approved & ~advisory).alias("transforms"),
        F.count_if(approved & advisory).alias("advisories"))
    return gate.withColumn(
        "outcome",
        F.when(F.col("open_blocks") > 0, "refused").when(F.col("transforms") > 0, "write_version")
        .when(F.col("advisories") > 0, "acknowledge").otherwise("nothing_approved"))


def review_order(stored: DataFrame) -> DataFrame:
    return stored.orderBy(F.expr(TIER_RANK), F.abs(F.coalesce("materiality", F.lit(0.0))).desc(), "group_key")


def pending_money(stored: DataFrame) -> DataFrame:
    return stored.where("status = 'pending'").groupBy("dataset_version").agg(
        F.count(F.lit(1)).alias("pending"), units(F.coalesce(F.sum(F.abs(cents(F.col("materiality")))), F.lit(0))).alias("at_stake"))
