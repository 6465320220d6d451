"""Recipes: approved steps kept, replayed on the next file, reporting only what deviates."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from reckonry.functions import fixed_values as fv
from reckonry.functions.scalars import entity_key, token
from reckonry.operators.clean import Cleaned, apply_operations
from reckonry.operators.profile import business_columns
from reckonry.operators.similar import closest_spelling
from reckonry.plans.staging import stage
from reckonry.plans.sums import cents, units

DEVIATIONS = (
    "type string, severity string, group_key string, title string, column_name string, "
    "source_value string, suggested_value string, affected_rows long, materiality double"
)


# ---------------------------------------------------------------- capture


def capture_steps(applied: DataFrame, tables: DataFrame) -> DataFrame:
    """Applied proposals(order_no, operation, confidence, group_key) -> numbered recipe steps.

    Where a column has a mapping table, the step points at it and drops its inline mapping.
    """
    op = F.get_json_object("operation", "$.op")
    numbered = applied.withColumn("n", F.row_number().over(Window.orderBy("order_no")))  # a recipe's few steps
    known = numbered.where(op.isNotNull()).withColumn("column", F.get_json_object("operation", "$.column"))
    joined = known.join(F.broadcast(tables), "column", "left")
    table = F.when(op == "map_values", F.col("mapping_table_id"))
    params = F.map_filter(
        F.from_json("operation", "map<string,string>"),
        lambda k, _: (k != "op") & ~((k == "mapping") & table.isNotNull()))
    tier = F.when(F.col("confidence") == "high", "auto").when(F.col("confidence") == "low", "block").otherwise("review")
    return joined.select(
        F.concat(F.lit("step_"), F.lpad(F.col("n").cast("string"), 2, "0")).alias("id"), op.alias("op"),
        F.to_json(params).alias("params"), table.alias("mapping_table_id"), tier.alias("confidence_tier"),
        F.lit("review").alias("on_ambiguous"), F.lit(True).alias("enabled"), "group_key")


def build_vocabulary(values: DataFrame, merges: DataFrame | None = None) -> DataFrame:
    """Confirmed merges(value, canonical) first, then every surviving value(value, first_row) as itself."""
    own = values.where(F.trim("value") != "").select(
        F.lit(1).alias("priority"), F.col("first_row").alias("seq"), F.col("value").alias("source_value"),
        F.col("value").alias("canonical_value"))
    if merges is not None:
        own = merges.select(
            F.lit(0).alias("priority"), F.lit(0).cast("long").alias("seq"), F.col("value").alias("source_value"),
            F.col("canonical").alias("canonical_value")).unionByName(own)
    keyed = own.withColumn("source_key", token(F.col("source_value"))).where("source_key <> ''")
    first = keyed.groupBy("source_key").agg(
        F.min(F.struct("priority", "seq", "source_value", "canonical_value")).alias("e"))
    return first.select("source_key", "e.source_value", "e.canonical_value", (F.col("e.priority") == 0).alias("confirmed"))


def upsert_mapping(table: DataFrame, entries: DataFrame) -> DataFrame:
    """New keys join; a known key keeps its canonical value and only gains a missing confirmation.

    ``table(source_key, source_value, canonical_value, confirmed_by, hit_count)``.
    """
    filled = entries.where((F.trim("source_key") != "") & (F.trim("canonical_value") != ""))
    fresh = filled.groupBy(F.lower(F.trim("source_key")).alias("source_key")).agg(
        F.min(F.struct("source_value", "canonical_value", "confirmed_by")).alias("n"))
    both = table.join(fresh, "source_key", "full_outer")
    is_new = F.col("canonical_value").isNull()
    return both.select(
        "source_key",
        F.when(is_new, F.col("n.source_value")).otherwise(F.col("source_value")).alias("source_value"),
        F.coalesce("canonical_value", F.col("n.canonical_value")).alias("canonical_value"),
        F.coalesce("confirmed_by", F.col("n.confirmed_by")).alias("confirmed_by"),
        F.coalesce("hit_count", F.lit(0).cast("long")).alias("hit_count"))


def record_hits(table: DataFrame, keys: DataFrame) -> DataFrame:
    hit = keys.select("source_key").distinct().withColumn("hit", F.lit(1))
    return table.join(hit, "source_key", "left").withColumn(
        "hit_count", F.col("hit_count") + F.coalesce("hit", F.lit(0))).select(*table.columns)


def match_recipes(arrivals: DataFrame, recipes: DataFrame, versions: DataFrame, runs: DataFrame) -> DataFrame:
    """The enabled recipe of each arriving (workspace_id, source_signature), with its run count; the first by id of several.

    An arrival without such a recipe has no row. Arrivals that repeat count once.
    """
    keys = ["workspace_id", "source_signature"]
    first = arrivals.select(*keys).distinct().join(recipes.where("enabled").drop("enabled"), keys).groupBy(*keys).agg(
        F.min(F.struct("recipe_id", "recipe_name", "current_version_id")).alias("r")).select(*keys, "r.*")
    current = first.join(versions.drop("recipe_id"), F.col("current_version_id") == F.col("recipe_version_id"))
    counts = runs.groupBy("recipe_version_id").agg(F.count(F.lit(1)).alias("run_count"))
    return current.join(counts, "recipe_version_id", "left").select(
        *keys, "recipe_id", "recipe_name", "recipe_version_id", "version_no", "steps", "invariants",
        F.coalesce("run_count", F.lit(0)).alias("run_count"))


def capture_versions(versions: DataFrame, captured: DataFrame) -> DataFrame:
    """Rows to append: captured(recipe_id, steps, invariants) whose steps differ from the latest version."""
    latest = versions.groupBy("recipe_id").agg(
        F.max("version_no").alias("last_no"), F.max_by("steps", "version_no").alias("last_steps"))
    joined = captured.join(latest, "recipe_id", "left")
    return joined.where(~F.col("steps").eqNullSafe(F.col("last_steps"))).select(
        "recipe_id", (F.coalesce("last_no", F.lit(0)) + 1).alias("version_no"), "steps", "invariants")


def edit_versions(versions: DataFrame, edited: DataFrame) -> DataFrame:
    """A manual edit(recipe_id, steps) is always a new version and carries the invariants over."""
    latest = versions.groupBy("recipe_id").agg(
        F.max("version_no").alias("last_no"), F.max_by("invariants", "version_no").alias("invariants"))
    return edited.join(latest, "recipe_id").select(
        "recipe_id", (F.col("last_no") + 1).alias("version_no"), "steps", "invariants")


# ---------------------------------------------------------------- mapping resolution


def resolve_values(
    df: DataFrame, column: str, vocabulary: DataFrame, known: DataFrame | None = None, money: str | None = None
) -> DataFrame:
    """Each distinct value of a column with how it resolves.

    Order: inline mapping, vocabulary key, already canonical, same entity key,
    close spelling, new.  ``vocabulary(source_key, canonical_value)``.
    """
    stake = F.sum(F.abs(cents(F.col(money)))) if money else F.lit(None).cast("long")
    c = F.col(column)
    values = df.where(c.isNotNull() & (c != "")).groupBy(c.alias("value")).agg(
        F.count(F.lit(1)).alias("rows"), stake.alias("stake_cents"))
    values = values.withColumns({"key": token(F.col("value")), "folded": entity_key(F.col("value"))})

    empty = "value string, canonical string"
    known = known if known is not None else df.sparkSession.createDataFrame([], empty)
    inline = known.groupBy("value").agg(F.min("canonical").alias("inline_to"))
    words = vocabulary.groupBy(F.col("source_key").alias("key")).agg(F.min("canonical_value").alias("vocabulary_to"))
    canonical = vocabulary.select(F.col("canonical_value").alias("candidate")).union(
        known.select("canonical")).where("candidate is not null").distinct()
    by_key = canonical.withColumn("folded", entity_key(F.col("candidate"))).groupBy("folded").agg(
        F.max("candidate").alias("folded_to"))

    joined = (
        values.join(inline, "value", "left").join(words, "key", "left")
        .join(canonical.select(F.col("candidate").alias("value"), F.lit(True).alias("is_canonical")), "value", "left")
        .join(by_key, "folded", "left"))
    open_values = joined.where(
        "inline_to is null and vocabulary_to is null and is_canonical is null and folded_to is null")
    close = closest_spelling(open_values.select(F.col("value").alias("word")), canonical)
    joined = joined.join(close.select(F.col("word").alias("value"), F.col("suggestion").alias("close_to")), "value", "left")
    outcome = (
        F.when(F.col("inline_to").isNotNull(), "inline").when(F.col("vocabulary_to").isNotNull(), "vocabulary")
        .when(F.col("is_canonical").isNotNull(), "canonical")
        .when(F.coalesce("folded_to", "close_to").isNotNull(), "ambiguous_match").otherwise("unmapped_value"))
    return joined.select(
        "value", "key", "rows", outcome.alias("outcome"),
        F.coalesce("inline_to", "vocabulary_to").alias("resolved"),
        F.when(outcome == "ambiguous_match", F.coalesce("folded_to", "close_to")).alias("suggestion"),
        units(F.nullif(F.col("stake_cents"), F.lit(0))).alias("materiality"))


def value_deviations(resolved: DataFrame, column: str) -> DataFrame:
    kind = F.col("outcome")
    short = F.when(kind == "ambiguous_match", "ambiguous").otherwise("unmapped")
    title = F.when(
        kind == "ambiguous_match", F.concat("value", F.lit(" looks like "), "suggestion")
    ).otherwise(F.concat("value", F.lit(f" is new in {column}")))
    return resolved.where(kind.isin("ambiguous_match", "unmapped_value")).select(
        kind.alias("type"), F.lit("review").alias("severity"),
        F.concat(short, F.lit(f":{column}:"), "key").alias("group_key"), title.alias("title"),
        F.lit(column).alias("column_name"), F.col("value").alias("source_value"),
        F.col("suggestion").alias("suggested_value"), F.col("rows").alias("affected_rows"), "materiality")


# ---------------------------------------------------------------- replay


@dataclass
class Replay:
    cleaned: Cleaned
    deviations: DataFrame
    hits: dict[str, DataFrame]
    rows_in: DataFrame

    def summary(self) -> DataFrame:
        return replay_summary(self.rows_in, self.deviations, self.cleaned.log)


def _fixed_deviations(spark, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, DEVIATIONS)


def schema_deviations(df: DataFrame, steps: list[dict], expected: list[str] | None) -> DataFrame:
    """Columns a step needs and lacks block; columns never seen before get one review line."""
    rows, seen = [], set()
    for step in steps:
        column = (step.get("params") or {}).get("column")
        live = step.get("enabled", True) and step["op"] not in fv.ADVISORY_OPERATIONS
        if live and column and column not in df.columns and column not in seen:
            seen.add(column)
            rows.append(("missing_column", "block", f"missing_column:{column}",
                         f"The file no longer has a {column} column", column, None, None, 0, None))
    extra = sorted(set(business_columns(df)) - set(expected)) if expected else []
    if extra:
        rows.append(("new_column", "review", "new_column", f"New column(s): {', '.join(extra)}", None, None, None, 0, None))
    return _fixed_deviations(df.sparkSession, rows)


def replay(
    df: DataFrame, steps: list[dict], mappings: dict[str, DataFrame] | None = None,
    money: str | None = None, expected: list[str] | None = None,
) -> Replay:
    """Run a recipe on a new table. Steps are ``{id, op, params, enabled}`` dictionaries."""
    mappings, spark = mappings or {}, df.sparkSession
    found, operations, hits = [schema_deviations(df, steps, expected)], [], {}
    for step in steps:
        params = dict(step.get("params") or {})
        column = params.get("column")
        if not step.get("enabled", True) or step["op"] in fv.ADVISORY_OPERATIONS:
            continue
        if column and column not in df.columns:
            continue
        if step["op"] != "map_values":
            operations.append({"op": step["op"], **params})
            continue
        table = params.get("mapping_table_id")
        vocabulary = mappings.get(table)
        if vocabulary is None:
            vocabulary = spark.createDataFrame([], "source_key string, canonical_value string")
        inline = params.get("mapping")
        known = None
        if inline is not None:
            known = inline if isinstance(inline, DataFrame) else (
                spark.createDataFrame(list(inline.items()), "value string, canonical string") if inline else None)
        resolved = stage(resolve_values(df, column, vocabulary, known, money), "resolved")  # read three times below
        found.append(value_deviations(resolved, column))
        if table:
            fresh = resolved.where("outcome = 'vocabulary'").select(F.col("key").alias("source_key"))
            hits[table] = hits[table].union(fresh) if table in hits else fresh
        operations.append({
            "op": "map_values", "column": column,
            "mapping": resolved.where("resolved is not null").select("value", F.col("resolved").alias("canonical"))})
    cleaned = apply_operations(df, operations)
    warned = cleaned.log.where("warning is not null").select(
        F.lit("step_failed").alias("type"), F.lit("review").alias("severity"),
        F.concat(F.lit("step_warning:"), "op").alias("group_key"), F.concat("op", F.lit(": "), "warning").alias("title"),
        F.col("column").alias("column_name"), F.lit(None).cast("string").alias("source_value"),
        F.lit(None).cast("string").alias("suggested_value"), F.lit(0).cast("long").alias("affected_rows"),
        F.lit(None).cast("double").alias("materiality"))
    deviations = reduce(lambda a, b: a.unionByName(b), [*found, warned])
    return Replay(cleaned, deviations, {k: v.distinct() for k, v in hits.items()}, df)


def replay_summary(rows_in: DataFrame, deviations: DataFrame, log: DataFrame) -> DataFrame:
    open_ = F.col("severity") != "auto"
    d = deviations.agg(
        F.count(F.lit(1)).alias("deviations"),
        F.count_if(F.col("severity") == "block").alias("block"), F.count_if(F.col("severity") == "review").alias("review"),
        F.coalesce(F.sum(F.when(open_, F.col("affected_rows"))), F.lit(0)).alias("touched"),
        units(F.coalesce(F.sum(F.when(open_, cents(F.col("materiality")))), F.lit(0))).alias("review_materiality"))
    n = rows_in.agg(F.count(F.lit(1)).alias("rows_processed"))
    c = log.agg(F.coalesce(F.sum(F.col("rows_changed") + F.col("rows_removed")), F.lit(0)).alias("auto_corrections"))
    both = n.join(F.broadcast(d), F.lit(True)).join(F.broadcast(c), F.lit(True))
    rows, touched = F.col("rows_processed"), F.col("touched")
    return both.select(
        "rows_processed", F.greatest(F.lit(0), rows - touched).alias("rows_matched"), "auto_corrections",
        "deviations", "block", "review", "review_materiality",
        F.when(rows == 0, 1.0).otherwise(F.round(F.greatest(F.lit(0.0), 1 - touched / rows), 4)).alias("automation_rate"))


# ---------------------------------------------------------------- invariants

INVARIANTS = (
    "id string, type string, column string, columns array<string>, baseline double, "
    "tolerance_pct double, expected string, severity string"
)


def default_invariants(profile: DataFrame) -> DataFrame:
    """What the learned month says about the next one, as tolerances."""
    none = F.lit(None)

    def line(id_, kind, column=none, columns=none, baseline=none, tolerance=none, expected=none, severity="review"):
        return F.struct(
            id_.alias("id"), F.lit(kind).alias("type"), column.cast("string").alias("column"),
            columns.cast("array<string>").alias("columns"), baseline.cast("double").alias("baseline"),
            tolerance.cast("double").alias("tolerance_pct"), expected.cast("string").alias("expected"),
            F.lit(severity).alias("severity"))

    filled = (F.col("inferred_type") != "empty") & (F.col("non_null") > 0)
    whole = profile.agg(
        F.max("row_count").alias("n"),
        F.transform(F.array_sort(F.collect_list(F.when(filled, F.struct("position", "column")))), lambda s: s["column"]).alias("names"))
    table = whole.select(F.inline(F.array(
        line(F.lit("row_count"), "row_count_within", baseline=F.col("n"), tolerance=F.lit(60)),
        line(F.lit("required_columns"), "columns_present", columns=F.col("names"), severity="block"))))
    name = F.col("column")
    money = profile.where("is_money and total is not null").select(F.inline(F.array(line(
        F.concat(F.lit("total_"), name), "total_within", name, baseline=F.col("total"), tolerance=F.lit(200)))))
    typed = profile.where(F.col("inferred_type").isin("number", "date")).select(F.inline(F.array(line(
        F.concat(F.lit("type_"), name), "column_type", name, expected=F.col("inferred_type"), severity="block"))))
    return table.unionByName(money).unionByName(typed)


def _type_holds(df: DataFrame, column: str, expected: str) -> Column:
    kind = df.schema[column].dataType
    if expected == "number":
        if isinstance(kind, T.NumericType):
            return F.lit(True)
        return F.every(F.col(column).cast("string").try_cast("double").isNotNull() | F.col(column).isNull())
    if expected == "date":
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return F.lit(True)
        return F.every(F.col(column).cast("string").rlike("^....-.....$") | F.col(column).isNull())
    return F.lit(True)


def check_invariants(df: DataFrame, invariants: list) -> DataFrame:
    """All checks from one aggregate over the cleaned table (the list is one row per column at most)."""
    present = set(business_columns(df))
    parts, lines = [F.count(F.lit(1)).alias("rows")], []
    for i, inv in enumerate(invariants):
        kind, column = inv["type"], inv["column"]
        actual, passed, missing = F.lit(None).cast("double"), F.lit(True), []
        base = float(inv["baseline"] or 0)
        if kind == "row_count_within":
            actual = F.col("rows").cast("double")
            share = float(inv["tolerance_pct"] or 50) / 100
            if base > 0:
                passed = actual.between(base * (1 - share), base * (1 + share))
        elif kind == "columns_present":
            missing = sorted(set(inv["columns"] or []) - present)
            passed = F.lit(not missing)
        elif kind == "total_within":
            share = float(inv["tolerance_pct"] or 100) / 100
            if column in df.columns:
                parts.append(units(F.coalesce(F.sum(cents(F.col(column).try_cast("double"))), F.lit(0))).alias(f"t{i}"))
                actual = F.col(f"t{i}")
            else:
                actual = F.lit(0.0)
            if base:
                low, high = sorted((base * (1 - share), base * (1 + share)))
                passed = actual.between(low, high)
        elif kind == "column_type" and column in df.columns:
            parts.append(F.coalesce(F.first(F.lit(True)) & _type_holds(df, column, inv["expected"]), F.lit(True)).alias(f"t{i}"))
            passed = F.col(f"t{i}")
        lines.append(F.struct(
            F.lit(inv["id"]).alias("id"), F.lit(kind).alias("type"), F.lit(column).cast("string").alias("column"),
            F.lit(inv["baseline"]).cast("double").alias("baseline"), actual.alias("actual"),
            F.lit(", ".join(missing) or None).cast("string").alias("missing"), passed.alias("passed"),
            F.lit(inv["severity"] or "review").alias("severity")))
    return df.agg(*parts).select(F.inline(F.array(*lines)))


def invariant_deviations(outcomes: DataFrame) -> DataFrame:
    kind, column = F.col("type"), F.col("column")
    group = (
        F.when(kind == "row_count_within", "invariant:row_count").when(kind == "columns_present", "invariant:columns_present")
        .when(kind == "total_within", F.concat(F.lit("invariant:total:"), column))
        .otherwise(F.concat(F.lit("invariant:type:"), column)))
    named = F.when(kind == "columns_present", "missing_column").when(kind == "column_type", "type_drift").otherwise("invariant_failure")
    return outcomes.where("not passed").select(
        named.alias("type"), "severity", group.alias("group_key"),
        F.concat(F.lit("Check failed: "), "id").alias("title"), F.when(kind.isin("total_within", "column_type"), column).alias("column_name"),
        F.lit(None).cast("string").alias("source_value"), F.lit(None).cast("string").alias("suggested_value"),
        F.lit(0).cast("long").alias("affected_rows"),
        F.when(kind == "total_within", F.round(F.abs(F.col("actual") - F.col("baseline")), 2)).alias("materiality"))


def invariant_status(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(F.concat_ws("/", F.count_if("passed").cast("string"), F.count(F.lit(1)).cast("string")).alias("status"))


def run_verdicts(deviations: DataFrame, runs: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Per run(run_id, input_version): what is still open after earlier decisions on the same input."""
    settled = resolutions.where("resolution <> 'pending'").select("input_version", "group_key").distinct()
    placed = deviations.join(runs.select("run_id", "input_version"), "run_id")
    open_ = placed.join(settled, ["input_version", "group_key"], "left_anti").groupBy("run_id").agg(
        F.count(F.lit(1)).alias("outstanding"),
        F.bool_or(F.col("severity") == "block").alias("blocks"), F.bool_or(F.col("severity") == "review").alias("reviews"))
    status = F.when(F.col("blocks"), "blocked").when(F.col("reviews"), "needs_review").otherwise("succeeded")
    return runs.join(open_, "run_id", "left").select(
        "run_id", "input_version", F.coalesce("outstanding", F.lit(0)).alias("outstanding"), status.alias("status"),
        (status == "succeeded").alias("writes_version"))


def resolve_deviations(deviations: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions(group_key, resolution, resolved_value, resolved_by): fill in the pending ones."""
    d = decisions.where("resolution <> 'pending'").select(
        "group_key", F.col("resolution").alias("__r"), F.nullif(F.trim("resolved_value"), F.lit("")).alias("__v"), F.col("resolved_by").alias("__by"))
    usable = d.where((F.col("__r") != "mapped") | F.col("__v").isNotNull())
    return deviations.join(usable, "group_key", "left").select(
        *[c for c in deviations.columns], F.coalesce("__r", F.lit("pending")).alias("resolution"),
        F.col("__v").alias("resolved_value"), F.col("__by").alias("resolved_by"))


def write_back(table: DataFrame, resolved: DataFrame) -> DataFrame:
    """Mapped deviations teach the vocabulary, keyed the way lookups read it."""
    taught = resolved.where("resolution = 'mapped' and source_value is not null").withColumn(
        "source_key", token(F.col("source_value"))).select(
        "source_key", "source_value", F.col("resolved_value").alias("canonical_value"), F.col("resolved_by").alias("confirmed_by"))
    return upsert_mapping(table, taught)
