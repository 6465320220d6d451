"""Column profiles and data-quality signals.

A table is read for the single-row aggregates, for value counts (unpivoted) and for exact medians.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from reckonry.functions import fixed_values as fv
from reckonry.functions.scalars import entity_key
from reckonry.functions.text import redact
from reckonry.operators.order_statistics import exact_quantiles
from reckonry.plans.sums import cents, money_sum_or_zero, units

SOURCE_ROW = "__source_row"
META_SCHEMA = (
    "column string, source_header string, type_confidence double, number_styles array<string>, "
    "date_order string, ambiguous_dates long, parse_failures long, failure_samples array<string>"
)


def business_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != SOURCE_ROW and not c.startswith("__raw_")]


def has_hint(name: Column, header: Column, hints) -> Column:
    haystack = F.lower(F.concat_ws(" ", name, header))
    return haystack.rlike("|".join(hints))


def money_columns(df: DataFrame) -> list[str]:
    numeric = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    return [c for c in business_columns(df) if c in numeric and any(h in c.lower() for h in fv.MONEY_HINTS)]


def stored_types(df: DataFrame) -> dict[str, str]:
    """Types from the stored schema; text of which every value is an ISO date counts as dates."""
    kinds, text = {}, []
    for f in df.schema:
        if f.name not in business_columns(df):
            continue
        if isinstance(f.dataType, T.NumericType):
            kinds[f.name] = "number"
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            kinds[f.name] = "date"
        elif isinstance(f.dataType, T.BooleanType):
            kinds[f.name] = "boolean"
        else:
            kinds[f.name] = "text"
            text.append(f.name)
    if text:
        whole = df.agg(*[F.coalesce(F.every(F.col(c).cast("string").rlike(r"^\d{4}-\d{2}-\d{2}$")), F.lit(False)).alias(f"d{i}") for i, c in enumerate(text)])
        kinds.update({c: "date" for c, iso in zip(text, whole.first()) if iso})  # one row
    return kinds


def value_counts(df: DataFrame, columns: list[str], row: str | None = SOURCE_ROW) -> DataFrame:
    """(column, value, n, first_row) for every distinct non-empty value, in one shuffle."""
    order = F.col(row) if row and row in df.columns else F.lit(0)
    wide = df.select(order.cast("long").alias("__r"), *[F.col(c).cast("string").alias(c) for c in columns])
    long = wide.unpivot(["__r"], columns, "column", "value")
    return (
        long.where(F.col("value").isNotNull() & (F.col("value") != ""))
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"), F.min("__r").alias("first_row"))
    )


def _exact_cents(d: Column) -> Column:
    return d.try_cast("decimal(30, 8)") * 100


def _single_row(df: DataFrame, types: dict[str, str]) -> DataFrame:
    parts, rows = [F.count(F.lit(1)).alias("row_count")], []
    for i, (name, kind) in enumerate(types.items()):
        c, as_text = F.col(name), F.col(name).cast("string")
        filled = as_text.isNotNull() & (as_text != "")
        parts.append(F.count_if(filled).alias(f"filled{i}"))
        fields = {"non_null": F.col(f"filled{i}")}
        if kind == "number":
            d = c.cast("double")
            parts += [
                F.min(d).alias(f"min{i}"), F.max(d).alias(f"max{i}"), F.when(F.count(d) == F.count(_exact_cents(d)), F.try_sum(_exact_cents(d))).alias(f"sum{i}"), F.sum(d).alias(f"rough{i}"),
                F.count_if(d < 0).alias(f"neg{i}"), F.count_if(d == 0).alias(f"zero{i}"),
            ]
            fields |= {
                "minimum": F.round(f"min{i}", 2), "maximum": F.round(f"max{i}", 2),
                # exact in any task order; beyond what a decimal holds, a sum of doubles
                "total": F.coalesce(units(F.col(f"sum{i}")), F.round(f"rough{i}", 2)),
                "mean": F.round(F.coalesce(F.col(f"sum{i}").cast("double") / 100, F.col(f"rough{i}")) / F.nullif(F.col(f"filled{i}"), F.lit(0)), 4),
                "negative_count": F.col(f"neg{i}"), "zero_count": F.col(f"zero{i}"),
            }
        elif kind == "date":
            day = F.when(filled, F.substring(as_text, 1, 10))
            parts += [F.min(day).alias(f"min{i}"), F.max(day).alias(f"max{i}")]
            fields |= {"earliest": F.col(f"min{i}"), "latest": F.col(f"max{i}")}
        else:
            untrimmed = (as_text != F.trim(as_text)) | as_text.contains("  ")
            parts.append(F.count_if(filled & untrimmed).alias(f"ws{i}"))
            fields["whitespace_issues"] = F.col(f"ws{i}")
        shape = [
            ("non_null", "bigint"), ("minimum", "double"), ("maximum", "double"), ("total", "double"),
            ("mean", "double"), ("negative_count", "bigint"), ("zero_count", "bigint"),
            ("earliest", "string"), ("latest", "string"), ("whitespace_issues", "bigint"),
        ]
        rows.append(F.struct(
            F.lit(i).alias("position"), F.lit(name).alias("column"), F.lit(kind).alias("inferred_type"),
            *[fields.get(f, F.lit(None)).cast(ty).alias(f) for f, ty in shape],
        ))
    return df.agg(*parts).select("row_count", F.inline(F.array(*rows)))


def _medians(df: DataFrame, numbers: list[str]) -> DataFrame:
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in numbers])
    long = wide.unpivot([], numbers, "column", "value")
    return exact_quantiles(long, ["column"], "value", {"median": 0.5}).select(
        "column", F.round("median", 4).alias("median"))


def profile_columns(
    df: DataFrame, row: str | None = SOURCE_ROW, meta: DataFrame | None = None,
    types: dict[str, str] | None = None, approximate: bool = False,
) -> DataFrame:
    """One row per business column.

    ``meta`` carries parse-time facts and joins by column *name*.
    ``approximate`` replaces exact distinct counts of non-text columns.
    """
    types = types or stored_types(df)
    base = _single_row(df, types)
    text = [c for c, k in types.items() if k in ("text", "boolean")]
    counted = [c for c in types if not approximate or c in text]
    numbers = [c for c, k in types.items() if k == "number"]

    counts = value_counts(df, counted, row)
    distinct = counts.groupBy("column").agg(F.count(F.lit(1)).alias("distinct_count"))
    if approximate and len(counted) < len(types):
        rest = [c for c in types if c not in counted]
        rough = df.agg(*[F.approx_count_distinct(c).alias(c) for c in rest])
        distinct = distinct.unionByName(rough.unpivot([], rest, "column", "distinct_count"))
    out = base.join(F.broadcast(distinct), "column", "left")

    if text:
        words = counts.where(F.col("column").isin(text))
        best = Window.partitionBy("column").orderBy(F.desc("n"), "first_row", "value")
        top = (
            words.withColumn("rank", F.row_number().over(best)).where("rank <= 5")
            .groupBy("column").agg(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))).alias("t"))
            .select("column", F.transform("t", lambda s: F.struct(s["value"].alias("value"), s["n"].alias("count"))).alias("top_values"))
        )
        keys = words.withColumn("key", entity_key(F.col("value"))).groupBy("column", "key").agg(F.count(F.lit(1)).alias("spellings"))
        folds = keys.groupBy("column").agg((F.sum("spellings") - F.count(F.lit(1))).alias("case_variants"))
        out = out.join(F.broadcast(top), "column", "left").join(F.broadcast(folds), "column", "left")
    else:
        out = out.withColumns({
            "top_values": F.lit(None).cast("array<struct<value:string,count:bigint>>"),
            "case_variants": F.lit(None).cast("bigint"),
        })
    if numbers:
        out = out.join(F.broadcast(_medians(df, numbers)), "column", "left")
    else:
        out = out.withColumn("median", F.lit(None).cast("double"))
    if meta is None:
        meta = df.sparkSession.createDataFrame([], META_SCHEMA)
    out = out.join(F.broadcast(meta.drop("position", "inferred_type", "non_null")), "column", "left")
    header = F.coalesce("source_header", "column")
    return out.select(
        "position", "column", header.alias("source_header"), "inferred_type",
        F.coalesce("type_confidence", F.lit(1.0)).alias("type_confidence"),
        "row_count", "non_null", (F.col("row_count") - F.col("non_null")).alias("null_count"),
        F.coalesce("distinct_count", F.lit(0)).alias("distinct_count"),
        has_hint(F.col("column"), header, fv.MONEY_HINTS).alias("is_money"),
        has_hint(F.col("column"), header, fv.KEY_HINTS).alias("is_key"),
        "minimum", "maximum", "total", "mean", "median",
        F.coalesce("negative_count", F.lit(0)).alias("negative_count"),
        F.coalesce("zero_count", F.lit(0)).alias("zero_count"),
        "earliest", "latest", "top_values",
        F.coalesce("whitespace_issues", F.lit(0)).alias("whitespace_issues"),
        F.coalesce("case_variants", F.lit(0)).alias("case_variants"),
        "number_styles", "date_order",
        F.coalesce("ambiguous_dates", F.lit(0)).alias("ambiguous_dates"),
        F.coalesce("parse_failures", F.lit(0)).alias("parse_failures"),
    )


def column_roles(profile: DataFrame, money_hints=fv.MONEY_HINTS, key_hints=fv.KEY_HINTS) -> DataFrame:
    return profile.select(
        "column",
        has_hint(F.col("column"), F.col("source_header"), money_hints).alias("is_money"),
        has_hint(F.col("column"), F.col("source_header"), key_hints).alias("is_key"),
    )


def money_totals(profile: DataFrame) -> DataFrame:
    return profile.where("is_money and total is not null").select(
        "column", "total", F.col("negative_count").alias("negatives"))


# ---------------------------------------------------------------- signals


def _money_at(columns: list[str], weight: Column) -> Column:
    """Largest per-column sum of absolute money over the rows at hand; null when nothing is at stake."""
    if not columns:
        return F.lit(None).cast("double")
    sums = [F.coalesce(F.sum(F.abs(cents(F.col(c))) * weight), F.lit(0)) for c in columns]
    most = sums[0] if len(sums) == 1 else F.greatest(*sums)
    return units(F.nullif(most, F.lit(0)))


def _counted_rows(df: DataFrame, row: str) -> DataFrame:
    """Distinct business rows with how often and where first they occur."""
    return df.groupBy(*business_columns(df.drop(row))).agg(
        F.count(F.lit(1)).alias("__n"), F.min(row).alias("__first"))


def exact_duplicates(df: DataFrame, row: str = SOURCE_ROW) -> DataFrame:
    """One row: groups, surplus rows and the money those surplus rows carry."""
    repeated = _counted_rows(df, row).where("__n > 1")
    return repeated.agg(
        F.count(F.lit(1)).alias("group_count"),
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows"),
        _money_at(money_columns(df), F.col("__n") - 1).alias("materiality"),
    )


def duplicate_examples(df: DataFrame, row: str = SOURCE_ROW, n: int = 5) -> DataFrame:
    return _counted_rows(df, row).where("__n > 1").orderBy("__first").limit(n).select(
        F.col("__first").alias("first_row"), F.col("__n").alias("copies"),
        *business_columns(df.drop(row)))


def key_conflicts(df: DataFrame, key: str, row: str = SOURCE_ROW) -> DataFrame:
    """Key values that appear on rows which differ elsewhere."""
    counted = _counted_rows(df, row).where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    money = money_columns(df)
    sums = [F.coalesce(F.sum(F.abs(cents(F.col(c))) * F.col("__n")), F.lit(0)).alias(f"__m{i}") for i, c in enumerate(money)]
    return counted.groupBy(key).agg(
        F.sum("__n").alias("row_count"), F.count(F.lit(1)).alias("versions"),
        F.min("__first").alias("first_row"), *sums,
    ).where("versions > 1")


def key_conflict_summary(df: DataFrame, key: str, row: str = SOURCE_ROW) -> DataFrame:
    found = key_conflicts(df, key, row)
    sums = [F.coalesce(F.sum(c), F.lit(0)) for c in found.columns if c.startswith("__m")]
    most = F.lit(None).cast("double")
    if sums:
        most = units(F.nullif(sums[0] if len(sums) == 1 else F.greatest(*sums), F.lit(0)))
    return found.agg(
        F.count(F.lit(1)).alias("group_count"),
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("affected_rows"),
        most.alias("materiality"),
    )


def chosen_key(profile: DataFrame) -> DataFrame:
    usable = (F.col("is_key")) & F.col("inferred_type").isin("text", "number") & (F.col("distinct_count") > 1)
    return profile.where(usable).orderBy("position").limit(1).select("column")


def entity_spellings(df: DataFrame, text: list[str], row: str | None = SOURCE_ROW) -> DataFrame:
    """(column, key, value, n, suggested) for values that fold together in a repeating column."""
    counts = value_counts(df, text, row)
    per_column = counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("filled"))
    repeating = per_column.where(F.col("kinds") / F.col("filled") <= 0.9).select("column")
    keyed = counts.join(F.broadcast(repeating), "column").withColumn("key", entity_key(F.col("value")))
    groups = keyed.groupBy("column", "key").agg(
        F.count(F.lit(1)).alias("spellings"),
        F.max_by("value", F.struct(F.col("n"), -F.col("first_row"), "value")).alias("suggested"),
    ).where("spellings > 1")
    return keyed.join(groups, ["column", "key"]).select(
        "column", "key", "value", "n", "first_row", "suggested")


def entity_variants(spellings: DataFrame) -> DataFrame:
    return spellings.groupBy("column").agg(
        F.count_distinct("key").alias("group_count"),
        F.sum("n").alias("affected_rows"),
        F.count_if(F.col("value") != F.col("suggested")).alias("respelled"),
    )


def declared_totals(totals: DataFrame, declared: DataFrame) -> DataFrame:
    """Totals the file states against totals of its rows.

    ``totals(column, computed)`` and ``declared(column, declared, source_row)``
    meet by column.
    """
    checks = totals.join(declared, "column").withColumn(
        "difference", F.round(F.col("computed") - F.col("declared"), 2))
    return checks.withColumn("reconciles", F.abs("difference") < 0.01)


def rate_column_pair(profile: DataFrame) -> tuple[str, str] | None:
    """(net, tax): the first number column for each, read from the small profile."""
    numbers = [r["column"] for r in profile.where("inferred_type = 'number'").orderBy("position").select("column").collect()]
    net = next((c for c in numbers if any(h in c for h in fv.NET_HINTS) and "vat" not in c), None)
    tax = next((c for c in numbers if any(h in c for h in fv.TAX_HINTS)), None)
    return (net, tax) if net and tax else None


def row_rates(df: DataFrame, net: str, tax: str, rates=fv.STANDARD_TAX_RATES) -> DataFrame:
    """Rate per row (four places) and whether an allowed rate is within half a point."""
    allowed = F.array(*[F.lit(float(r)) for r in rates])
    rate = F.round(F.col(tax) / F.col(net), 4)
    nearest = F.array_min(F.transform(allowed, lambda r: F.abs(F.col("rate") - r)))
    return (
        df.where(F.col(net).isNotNull() & F.col(tax).isNotNull() & (F.col(net) != 0))
        .withColumn("rate", rate)
        .withColumn("is_standard", nearest < fv.TAX_RATE_TOLERANCE)
    )


def rate_distribution(df: DataFrame, net: str, tax: str, rates=fv.STANDARD_TAX_RATES, n: int | None = 5) -> DataFrame:
    out = row_rates(df, net, tax, rates).groupBy("rate").agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(~F.col("is_standard")).alias("anomalies"))
    return out.orderBy(F.desc("row_count"), "rate").limit(n) if n else out


def date_months(df: DataFrame, date: str) -> DataFrame:
    return (
        df.where(F.col(date).isNotNull())
        .groupBy(F.date_format(F.col(date).cast("date"), "yyyy-MM").alias("month"))
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


def date_coverage(df: DataFrame, date: str) -> DataFrame:
    day = F.col(date).cast("date")
    return df.where(day.isNotNull()).agg(
        F.min(day).cast("string").alias("earliest"), F.max(day).cast("string").alias("latest"),
        F.count_distinct(F.date_format(day, "yyyy-MM")).alias("distinct_months"),
    ).withColumn("spans_multiple_months", F.col("distinct_months") > 1)


def outlier_bounds(df: DataFrame, money: list[str]) -> DataFrame:
    """Per column: n, exclusive quartiles and the fence three ranges out."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in money]).unpivot([], money, "column", "value")
    q = exact_quantiles(long, ["column"], "value", {"q1": 0.25, "q3": 0.75}, exclusive=True)
    spread = F.col("q3") - F.col("q1")
    return q.where((F.col("n") >= 8) & (spread != 0)).withColumns({
        "low": F.col("q1") - 3 * spread, "high": F.col("q3") + 3 * spread})


def outlier_rows(df: DataFrame, money: list[str], row: str = SOURCE_ROW) -> DataFrame:
    long = df.select(F.col(row).alias("source_row"), *[F.col(c).cast("double").alias(c) for c in money]).unpivot(
        ["source_row"], money, "column", "value").where("value is not null")
    bounds = outlier_bounds(df, money).select("column", "low", "high")
    return long.join(F.broadcast(bounds), "column").where(
        (F.col("value") < F.col("low")) | (F.col("value") > F.col("high")))


def outlier_summary(df: DataFrame, money: list[str], row: str = SOURCE_ROW) -> DataFrame:
    return outlier_rows(df, money, row).groupBy("column").agg(
        F.count(F.lit(1)).alias("outliers"),
        F.round(F.first("low"), 2).alias("low"), F.round(F.first("high"), 2).alias("high"),
        money_sum_or_zero(F.abs("value")).alias("materiality"),
    )


def redacted_context(profile: DataFrame) -> DataFrame:
    """What may leave the system: counts, ranges and masked frequent values, never rows."""
    masked = F.transform(
        F.slice(F.coalesce("top_values", F.array()), 1, 5),
        lambda s: F.struct(redact(s["value"]).alias("value"), s["count"].alias("count")),
    )
    number, date = F.col("inferred_type") == "number", F.col("inferred_type") == "date"
    return profile.select(
        "position", "column", F.col("source_header").alias("header"), F.col("inferred_type").alias("type"),
        "type_confidence", "non_null", F.col("null_count").alias("nulls"), F.col("distinct_count").alias("distinct"),
        *[F.when(number, F.col(c)).alias(c) for c in ("minimum", "maximum", "total", "mean", "median", "is_money")],
        F.when(number, F.col("negative_count")).alias("negatives"),
        F.when(number, F.col("number_styles")).alias("formats_seen"),
        *[F.when(date, F.col(c)).alias(c) for c in ("earliest", "latest", "date_order")],
        F.when(date, F.col("ambiguous_dates")).alias("ambiguous"),
        F.when(~number & ~date, masked).alias("frequent_values"),
        F.when(~number & ~date, F.col("whitespace_issues")).alias("whitespace_issues"),
        F.nullif(F.col("parse_failures"), F.lit(0)).alias("parse_failures"),
    )
