"""Approved cleaning steps: DataFrame in, cleaned DataFrame and change log out.

A step is a dictionary ``{"op": ..., "column": ..., ...}``.  What can be judged
from the schema (unknown step, missing column, empty mapping) is judged before
any plan is built; such a step is skipped with a warning and the rest go on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from reckonry.functions import fixed_values as fv
from reckonry.functions.scalars import normalize_text, parse_date, parse_number, token
from reckonry.operators.profile import SOURCE_ROW, business_columns
from reckonry.plans.skew import lookup

LOG_SCHEMA = (
    "step int, op string, column string, rows_changed long, rows_removed long, rows_unmatched long, "
    "row_count long, warning string"
)


class StepSkipped(ValueError):
    """The step cannot run on this table; the message becomes its warning."""


@dataclass
class Cleaned:
    rows: DataFrame
    log: DataFrame
    steps: list = field(default_factory=list)

    def samples(self, step: int, n: int = 5) -> DataFrame:
        """Before and after values for the first rows one step changed."""
        done = self.steps[step]
        if done.tracked is None:
            return self.rows.sparkSession.createDataFrame([], "source_row long, before string, after string")
        return done.tracked.where(F.col(done.changed)).orderBy(SOURCE_ROW).limit(n).select(
            F.col(SOURCE_ROW).alias("source_row"),
            F.col(done.before).cast("string").alias("before") if done.before else F.lit(None).cast("string").alias("before"),
            F.col(done.after).cast("string").alias("after"))


@dataclass
class Step:
    number: int
    op: str
    column: str | None
    warning: str | None = None
    changed: str | None = None
    unmatched: str | None = None
    removed: DataFrame | None = None
    before: str | None = None
    after: str | None = None
    tracked: DataFrame | None = None


def _need(df: DataFrame, column: str | None) -> str:
    if not column or column not in df.columns:
        raise StepSkipped(f"column {column!r} is not present; step skipped")
    return column


def _is_text(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.StringType)


def mapping_frame(df: DataFrame, mapping) -> DataFrame:
    """A mapping given as dict or DataFrame(value, canonical), one row per value."""
    if isinstance(mapping, DataFrame):
        return mapping.groupBy("value").agg(F.min("canonical").alias("canonical"))
    return df.sparkSession.createDataFrame(list(mapping.items()), "value string, canonical string")


# Each transform gets the tracked table and the step, and returns the table with
# the new value in place plus boolean columns saying which rows changed.


def _replace(df: DataFrame, step: Step, column: str, after: Column, unmatched: Column | None = None) -> DataFrame:
    before, flag, miss = f"__b{step.number}", f"__c{step.number}", f"__u{step.number}"
    df = df.withColumn(before, F.col(column)).withColumn(column, after)
    flags = {flag: ~F.col(column).eqNullSafe(F.col(before))}
    if unmatched is not None:
        flags[miss] = unmatched
        step.unmatched = miss
    step.changed, step.before, step.after = flag, before, column
    return df.withColumns(flags)


def _whitespace(df: DataFrame, step: Step, p: dict) -> DataFrame:
    column = _need(df, p.get("column"))
    if not _is_text(df, column):
        return df
    return _replace(df, step, column, normalize_text(F.col(column)))


def _case(df: DataFrame, step: Step, p: dict) -> DataFrame:
    column = _need(df, p.get("column"))
    if not _is_text(df, column):
        return df
    style = {"upper": F.upper, "lower": F.lower}.get(p.get("style", "title"), F.initcap)
    return _replace(df, step, column, style(F.col(column)))


def _map_values(df: DataFrame, step: Step, p: dict) -> DataFrame:
    column = _need(df, p.get("column"))
    mapping = p.get("mapping")
    if mapping is None or (isinstance(mapping, dict) and not mapping):
        raise StepSkipped("mapping is empty; step skipped")
    if not _is_text(df, column):
        return df
    targets = mapping_frame(df, mapping).select(F.col("value").alias(column), F.col("canonical").alias("__canonical"))
    joined = lookup(df, targets, [column]).select(*df.columns, "__canonical")
    return _replace(joined, step, column, F.coalesce("__canonical", column)).drop("__canonical")


def _decided(df: DataFrame, step: Step, column: str, targets: dict[str, Column], decisions: DataFrame) -> DataFrame:
    flag, miss = f"__c{step.number}", f"__u{step.number}"
    keyed = df.withColumn("__key", F.coalesce(token(F.col(column)), F.lit("")))
    joined = lookup(keyed, decisions, ["__key"]).withColumns(targets)
    step.changed, step.unmatched, step.after = flag, miss, next(iter(targets))
    return joined.withColumns({
        flag: F.col("__hit").isNotNull(), miss: F.col("__hit").isNull(),
    }).select(*df.columns, *targets, flag, miss)


def _assign_category(df: DataFrame, step: Step, p: dict) -> DataFrame:
    column = _need(df, p.get("column"))
    target = p.get("target") or f"{column}_category"
    mapping = p.get("mapping")
    step.column = target
    if mapping is None or (isinstance(mapping, dict) and not mapping):
        raise StepSkipped("no categories were approved; step skipped")
    if target in df.columns:
        raise StepSkipped(f"column {target!r} already exists; step skipped")
    decisions = mapping_frame(df, mapping).select(
        F.col("value").alias("__key"), F.col("canonical").alias("__category"), F.lit(True).alias("__hit"))
    fallback = p.get("fallback", fv.UNCATEGORISED)
    return _decided(df, step, column, {target: F.coalesce("__category", F.lit(fallback))}, decisions)


def _assign_tax(df: DataFrame, step: Step, p: dict) -> DataFrame:
    """Three columns from one decision table ``decisions(key, <target columns>)``."""
    column = _need(df, p.get("column"))
    decisions, targets = p.get("decisions"), list(p.get("targets") or [])
    fallback = p.get("fallback") or {}
    if decisions is None or (isinstance(decisions, dict) and not decisions):
        raise StepSkipped("no categories were approved; step skipped")
    if not targets:
        raise StepSkipped("no output columns were named; step skipped")
    taken = [t for t in targets if t in df.columns]
    if taken:
        raise StepSkipped(f"column(s) {', '.join(map(repr, taken))} already exist; step skipped")
    if isinstance(decisions, dict):
        rows = [(k, *[v.get(t) for t in targets]) for k, v in decisions.items()]
        fields = [T.StructField(n, T.StringType()) for n in ("key", *targets)]
        decisions = df.sparkSession.createDataFrame(rows, T.StructType(fields))
    by_key = decisions.groupBy("key").agg(F.min(F.struct(*[F.col(f"`{t}`") for t in targets])).alias("__d")).select(
        F.col("key").alias("__key"), "__d", F.lit(True).alias("__hit"))

    def value(t: str) -> Column:
        known = F.coalesce(F.col("__d")[t], F.lit(""))
        return F.when(F.col("__hit").isNotNull(), known).otherwise(F.lit(str(fallback.get(t, "") or "")))

    return _decided(df, step, column, {t: value(t) for t in targets}, by_key)


def _coerce_number(df: DataFrame, step: Step, p: dict) -> DataFrame:
    column = _need(df, p.get("column"))
    if not _is_text(df, column):
        return df
    number = f"__n{step.number}"
    df = df.withColumn(number, parse_number(F.col(column))["value"])
    out = _replace(df, step, column, F.col(number), F.col(column).isNotNull() & F.col(number).isNull())
    raw = F.col(step.before)
    return out.withColumns({
        step.changed: raw.isNotNull() & F.col(number).isNotNull(),
        step.unmatched: raw.isNotNull() & F.col(number).isNull(),
    }).drop(number)


def _normalize_date(df: DataFrame, step: Step, p: dict) -> DataFrame:
    column = _need(df, p.get("column"))
    if not _is_text(df, column):
        return df
    order = p.get("order") if p.get("order") in ("dmy", "mdy") else "dmy"
    c = F.col(column)
    iso = c.rlike("^....-..-..$")
    df = df.withColumn(f"__d{step.number}", F.when(~iso, parse_date(c, order)["value"].cast("string")))
    parsed = F.col(f"__d{step.number}")
    out = _replace(df, step, column, F.coalesce(parsed, c), c.isNotNull() & parsed.isNull())
    raw = F.col(step.before)
    return out.withColumns({
        step.changed: parsed.isNotNull(),
        step.unmatched: raw.isNotNull() & ~raw.rlike("^....-..-..$") & parsed.isNull(),
    }).drop(f"__d{step.number}")


def drop_duplicate_rows(
    df: DataFrame, columns: list[str] | None = None, keep: str = "first", row: str = SOURCE_ROW
) -> DataFrame:
    """One row per distinct key, nulls equal.

    Spark limits each partition to one row per key before the shuffle, so a
    key held by a third of the table still sends one row per partition.
    """
    keys = columns or [c for c in business_columns(df) if c != row]
    order = F.col(row).desc() if keep == "last" else F.col(row).asc()
    ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return ranked.where("__n = 1").drop("__n")


_TRANSFORMS: dict[str, Callable[[DataFrame, Step, dict], DataFrame]] = {
    "normalize_whitespace": _whitespace,
    "normalize_case": _case,
    "map_values": _map_values,
    "assign_category": _assign_category,
    "assign_hmrc_categories": _assign_tax,
    "coerce_number": _coerce_number,
    "normalize_date": _normalize_date,
}
_MISS_TEXT = {
    "assign_category": "row(s) had no approved category and took the fallback",
    "assign_hmrc_categories": "row(s) had no approved category and were left for review",
    "coerce_number": "value(s) could not be read as a number and are now empty",
    "normalize_date": "value(s) could not be read as a date and were left as-is",
}


def _segment_log(tracked: DataFrame, steps: list[Step]) -> DataFrame:
    """Counters for a run of row-wise steps from one pass over their result."""
    parts = [F.count(F.lit(1)).alias("row_count")]
    for s in steps:
        if s.changed:
            parts.append(F.count_if(s.changed).alias(f"changed{s.number}"))
        if s.unmatched:
            parts.append(F.count_if(s.unmatched).alias(f"missed{s.number}"))
    lines = []
    for s in steps:
        changed = F.col(f"changed{s.number}") if s.changed else F.lit(0)
        missed = F.col(f"missed{s.number}") if s.unmatched else F.lit(0)
        bulk = F.lit(s.op == "map_values") & (changed > F.col("row_count") * fv.BULK_CHANGE_RATIO)
        warning = (
            F.when(F.lit(s.warning is not None), F.lit(s.warning))
            .when(bulk, F.concat(F.lit("this mapping rewrote "), changed, F.lit(" of "), F.col("row_count"), F.lit(" rows")))
            .when(missed > 0, F.concat(missed, F.lit(" " + _MISS_TEXT.get(s.op, "row(s) were not matched"))))
        )
        lines.append(F.struct(
            F.lit(s.number).alias("step"), F.lit(s.op).alias("op"), F.lit(s.column).cast("string").alias("column"),
            changed.cast("long").alias("rows_changed"), F.lit(0).cast("long").alias("rows_removed"),
            missed.cast("long").alias("rows_unmatched"), F.col("row_count").alias("row_count"),
            warning.alias("warning")))
    return tracked.agg(*parts).select(F.inline(F.array(*lines)))


def apply_operations(df: DataFrame, operations: list[dict]) -> Cleaned:
    """Run the steps in the given order."""
    visible = df.columns
    tracked, segment, logs, done = df, [], [], []

    def close_segment():
        if segment:
            for s in segment:
                s.tracked = tracked if s.changed and SOURCE_ROW in tracked.columns else None
            logs.append(_segment_log(tracked, list(segment)))
            segment.clear()

    for number, op in enumerate(operations):
        name, step = op.get("op"), Step(number, op.get("op") or "unknown", op.get("column"))
        done.append(step)
        try:
            if name in fv.ADVISORY_OPERATIONS:
                pass
            elif name == "drop_duplicate_rows":
                asked = op.get("columns")
                keys = [c for c in asked or business_columns(tracked.select(*visible)) if c in visible]
                if not keys:
                    raise StepSkipped("no usable columns; step skipped")
                gone = [c for c in asked or [] if c not in visible]
                if gone:
                    step.warning = f"columns not present, ignored: {', '.join(gone)}"
                close_segment()
                before = tracked.select(*visible)
                groups = before.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
                logs.append(groups.agg(
                    F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("removed"),
                    F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
                ).select(
                    F.lit(number).alias("step"), F.lit(name).alias("op"), F.lit(None).cast("string").alias("column"),
                    F.lit(0).cast("long").alias("rows_changed"), F.col("removed").alias("rows_removed"),
                    F.lit(0).cast("long").alias("rows_unmatched"), F.col("total").alias("row_count"),
                    F.lit(step.warning).cast("string").alias("warning")))
                tracked = drop_duplicate_rows(before, keys, op.get("keep", "first"))
                continue
            elif name in _TRANSFORMS:
                tracked = _TRANSFORMS[name](tracked, step, op)
                visible = [c for c in tracked.columns if not (c[:3] in ("__b", "__c", "__u") and c[3:].isdigit())]
            else:
                raise StepSkipped(f"unknown operation {name!r}; skipped")
        except StepSkipped as skipped:
            step.warning = str(skipped)
        segment.append(step)
    close_segment()
    log = (
        reduce(lambda a, b: a.unionByName(b), logs) if logs
        else df.sparkSession.createDataFrame([], LOG_SCHEMA)
    )
    return Cleaned(tracked.select(*visible), log, done)
