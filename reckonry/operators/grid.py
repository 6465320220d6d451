"""Find the real table inside sheets, many sheets per job.

Input is a ``cells`` table: file, sheet, source_row (1-based, every grid row
present), cells array<string> and optionally kinds array<string> for typed
sources ('n' number, 'd' date, anything else text).  Header search looks at a
sheet's first rows only, so it never depends on how long a sheet is; the rest
is row-wise work and small per-sheet aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reckonry.functions import fixed_values as fv
from reckonry.functions import scalars as S
from reckonry.plans.staging import stage

SHEET = ["file", "sheet"]
HEAD_ROWS = fv.HEADER_SEARCH_ROWS + fv.WIDTH_BODY_ROWS + 1
SHAPES = ("number", "date", "short_text", "long_text")


def _null_word(norm: Column) -> Column:
    return F.coalesce(F.lower(norm).isin(*fv.NULL_TOKENS), F.lit(True))


def prepare(cells: DataFrame) -> DataFrame:
    """Adds normalised text per cell and, where missing, the kinds."""
    if "kinds" not in cells.columns:
        cells = cells.withColumn("kinds", F.transform("cells", lambda _: F.lit("s")))
    return cells.withColumn("norm", F.transform("cells", S.normalize_text))


def fill_merged(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """Spread the top-left value of each merged range over its cells.

    ``ranges(file, sheet, first_row, last_row, first_col, last_col)``, columns
    0-based.  Each range opens into its rows, so rows and ranges meet by equality.
    """
    opened = ranges.withColumn("source_row", F.explode(F.sequence("first_row", "last_row")))
    heads = ranges.join(cells.select(*SHEET, F.col("source_row").alias("first_row"), "cells"), [*SHEET, "first_row"]).select(
        *SHEET, "first_row", "first_col", F.try_element_at("cells", F.col("first_col") + 1).alias("fill"))
    per_row = opened.join(heads, [*SHEET, "first_row", "first_col"]).groupBy(*SHEET, "source_row").agg(
        F.collect_list(F.struct("first_col", "last_col", "fill")).alias("spans"))
    joined = cells.join(per_row, [*SHEET, "source_row"], "left")
    width = F.greatest(F.size("cells"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["last_col"])) + 1, F.lit(0)))
    padded = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.struct(i.alias("i"), F.try_element_at("cells", i + 1).alias("v")))

    def filled(p: Column) -> Column:
        hit = F.filter("spans", lambda s: p["i"].between(s["first_col"], s["last_col"]))
        return F.when(F.size(hit) > 0, F.coalesce(p["v"], hit[0]["fill"])).otherwise(p["v"])

    return joined.withColumn("cells", F.when(F.col("spans").isNull(), F.col("cells")).otherwise(F.transform(padded, filled))).select(*cells.columns)


def explode_cells(prepared: DataFrame, *keep: str) -> DataFrame:
    return prepared.select(*SHEET, "source_row", *keep, F.posexplode(F.arrays_zip("norm", "kinds")).alias("col", "c")).select(
        *SHEET, "source_row", *keep, "col", F.col("c.norm").alias("text"), F.coalesce("c.kinds", F.lit("s")).alias("kind"))


def read_values(cell: DataFrame, prefer: Column | str = "dmy") -> DataFrame:
    """Adds populated, number (struct) and date (struct) for exploded cells."""
    text, kind = F.col("text"), F.col("kind")
    filled = ~_null_word(text)
    number = F.when(kind == "d", None).otherwise(S.number_struct(text))
    typed_date = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.struct(
        F.substring(text, 1, 10).try_cast("date").alias("value"), F.lit(False).alias("ambiguous"), F.lit("excel").alias("order")))
    date = F.when(kind == "n", S.serial_date_struct(text)).when(kind == "d", typed_date).otherwise(S.date_struct(text, prefer))
    return cell.withColumn("populated", filled).withColumns({
        "number": F.when(F.col("populated"), number), "date": F.when(F.col("populated"), date)})


def classify_cells(cell: DataFrame) -> DataFrame:
    """Adds shape and header_like to read cells."""
    is_number, is_date = F.col("number").isNotNull(), F.col("date").isNotNull()
    length = F.length("text")
    shape = (
        F.when(~F.col("populated"), None).when(is_number, "number").when(is_date, "date")
        .when(length <= fv.SHORT_TEXT_MAX_CHARS, "short_text").otherwise("long_text"))
    like = (
        F.col("populated") & (F.col("kind") != "n") & (length <= fv.HEADER_CELL_MAX_CHARS)
        & ~is_number & ~is_date & F.col("text").rlike("[A-Za-z]"))
    return cell.withColumns({"shape": shape, "header_like": like})


# ---------------------------------------------------------------- header search


def header_scores(cells: DataFrame) -> DataFrame:
    """Every candidate header row with the parts of its score.

    A sheet's first rows meet in one exchange; all that follows keeps that placing. What lies beneath a cell is
    read from running counts down its column, one reading at the end of each reach less one at the cell itself.
    """
    head = prepare(cells.where(F.col("source_row") <= HEAD_ROWS)).select(*SHEET, F.col("source_row").cast("int").alias("source_row"), "norm", "kinds")
    filled = F.size(F.filter("norm", lambda v: ~_null_word(v)))
    sheet = Window.partitionBy(*SHEET)
    down = sheet.orderBy("source_row").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = head.repartition(*SHEET).withColumn("filled", filled).withColumns({
        "heights": F.collect_list(F.struct("source_row", "filled")).over(down),  # HEAD_ROWS at most
        "columns": F.max(F.size("norm")).over(down)})

    def beneath(reach: int, test) -> Column:
        return F.filter("heights", lambda r: r["source_row"].between(F.col("source_row") + 1, F.col("source_row") + reach) & test(r["filled"]))

    rows = rows.withColumns({
        "wide": F.transform(beneath(fv.WIDTH_BODY_ROWS, lambda n: n > 1), lambda r: r["filled"]),
        "rows_beneath": F.size(beneath(fv.SCORE_BODY_ROWS, lambda n: n > 0))}).drop("heights")
    # of equally common widths the first one beneath
    common_width = F.array_max(F.transform(F.array_distinct("wide"), lambda w, i: F.struct(
        F.size(F.filter("wide", lambda x: x == w)).alias("n"), (-i).alias("first"), w.alias("width"))))["width"]
    fill = F.array_repeat(F.lit(None).cast("string"), F.col("columns") - F.size("norm"))
    rows = rows.withColumns({"body_width": common_width, "wide_rows": F.size("wide"), "norm": F.concat("norm", fill)}).drop("wide", "columns")
    kept = ("filled", "body_width", "wide_rows", "rows_beneath")
    cell = classify_cells(read_values(explode_cells(rows, *kept))).select(
        *SHEET, "source_row", "col", *kept, "populated", "header_like", "shape", F.lower("text").alias("label"))

    column = Window.partitionBy(*SHEET, "col")
    one = lambda test: F.when(test, 1).otherwise(0)

    def below(test: Column, reach: int) -> Column:
        until = lambda k: F.sum(one(test)).over(column.orderBy("source_row").rangeBetween(Window.unboundedPreceding, k))
        return until(reach) - until(0)

    populated, upwards = F.col("populated"), column.orderBy(F.col("source_row").desc()).rowsBetween(Window.unboundedPreceding, -1)
    counts = {"used": below(populated & (F.col("filled") > 1), fv.WIDTH_BODY_ROWS), "near_cells": below(populated, fv.SCORE_BODY_ROWS),
              "near_typed": below(F.col("shape").isin("number", "date"), fv.SCORE_BODY_ROWS)}
    counts |= {f"n_{s}": below(F.col("shape") == s, fv.CONTRAST_ROWS) for s in SHAPES}
    counts |= {f"f_{s}": F.last(F.when(F.col("shape") == s, F.col("source_row")), ignorenulls=True).over(upwards) for s in SHAPES}
    common = F.array_max(F.array(*[
        F.struct(F.col(f"n_{s}").alias("n"), (-F.coalesce(f"f_{s}", F.lit(1 << 30))).alias("f"), F.lit(s).alias("s")) for s in SHAPES]))["s"]
    both = cell.withColumns(counts).where(F.col("source_row") <= fv.HEADER_SEARCH_ROWS).withColumns({
        "common": common, "seen": sum((F.col(f"n_{s}") for s in SHAPES), F.lit(0))}).withColumnsRenamed({"source_row": "row", "shape": "own_shape"})
    mine = F.col("populated")
    in_body = F.col("used") >= F.greatest(F.lit(1), F.floor(F.col("wide_rows") / 5))
    judged = mine & (F.col("seen") >= 3)
    parts = both.groupBy(*SHEET, "row").agg(
        F.count_if(mine).alias("cells"), F.count_if("header_like").alias("like"),
        F.count_distinct(F.when(mine, F.col("label"))).alias("labels"),
        F.count_if(in_body).alias("body_cols"), F.count_if(in_body & mine).alias("covered"), F.count_if(mine & ~in_body).alias("surplus"),
        F.sum("near_cells").alias("near_cells"), F.sum("near_typed").alias("near_typed"),
        F.count_if(judged).alias("judged"), F.count_if(judged & (F.col("own_shape") != F.col("common"))).alias("differing"),
        F.max("body_width").alias("body_width"), F.max("rows_beneath").alias("rows_beneath"))
    scored = parts.where((F.col("cells") >= 2) & (F.col("body_width") >= 2) & (F.col("rows_beneath") > 0))  # so no last row
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    width = F.when(
        F.col("body_cols") > 0,
        F.col("covered") / F.col("body_cols") * (1 - F.lit(0.3) * (F.col("surplus") / F.col("cells"))),
    ).otherwise(1 - F.least(F.lit(1.0), F.abs(F.col("cells") - F.col("body_width")) / F.col("body_width")))
    scored = scored.withColumns({
        "header_ratio": ratio("like", "cells"), "distinct_ratio": ratio("labels", "cells"), "width_match": width,
        "typed_contrast": ratio("near_typed", "near_cells"), "column_contrast": ratio("differing", "judged")})
    raw = (
        0.25 * F.col("header_ratio") + 0.15 * F.col("distinct_ratio") + 0.20 * F.col("width_match")
        + 0.15 * F.least(F.lit(1.0), F.col("typed_contrast") * 1.5) + 0.25 * F.col("column_contrast"))
    title = (F.col("typed_contrast") < 0.05) & (F.col("header_ratio") > 0.9) & (F.col("column_contrast") < 0.5)
    return scored.withColumn("score", F.when(title, raw * 0.4).otherwise(raw)).select(
        *SHEET, F.col("row").alias("header_row"), "header_ratio", "distinct_ratio", "width_match", "typed_contrast", "column_contrast", "score")


def find_headers(cells: DataFrame) -> DataFrame:
    """One row per sheet that has a header: best score, earliest row on ties."""
    best = header_scores(cells).where("score > 0").groupBy(*SHEET).agg(
        F.max_by("header_row", F.struct(F.col("score"), -F.col("header_row"))).alias("header_row"), F.max("score").alias("score"))
    heads = prepare(cells.where(F.col("source_row") <= fv.HEADER_SEARCH_ROWS)).select(
        *SHEET, F.col("source_row").alias("header_row"), "norm")
    at = F.filter(F.transform("norm", lambda v, i: F.when(~_null_word(v), i)), lambda i: i.isNotNull())
    bounds = best.join(heads, [*SHEET, "header_row"]).withColumns({"first_col": F.array_min(at), "last_col": F.array_max(at)})
    return bounds.select(
        *SHEET, "header_row", "score", "first_col", "last_col",
        F.slice("norm", F.col("first_col") + 1, F.col("last_col") - F.col("first_col") + 1).alias("headers"))


# ---------------------------------------------------------------- rows


def classify_rows(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Every row of every sheet with a header, with its kind and its slice of the table."""
    width = F.col("last_col") - F.col("first_col") + 1
    rows = prepare(cells).join(headers.select(*SHEET, "header_row", "first_col", "last_col"), SHEET)
    rows = rows.withColumns({
        "values": F.slice("norm", F.col("first_col") + 1, width), "value_kinds": F.slice("kinds", F.col("first_col") + 1, width),
        "anything": F.exists("norm", lambda v: ~_null_word(v))}).drop("cells", "kinds")
    filled = F.size(F.filter("values", lambda v: ~_null_word(v)))
    lead_total = F.exists(F.slice("values", 1, 3), S.subtotal_label)
    rows = rows.withColumns({
        "base": F.when(filled == 0, "blank").when(lead_total, "subtotal").when((filled == 1) & (width >= 3), "sparse").otherwise("data"),
        "any_total": F.exists("values", S.subtotal_label), "below": F.col("source_row") > F.col("header_row")})

    blank = rows.where("below and base = 'blank'")
    runs = blank.select(*SHEET, F.explode(F.array(*[F.col("source_row") + i for i in range(fv.BLANK_ROWS_END_TABLE)])).alias("end_row"))
    ended = runs.groupBy(*SHEET, "end_row").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == fv.BLANK_ROWS_END_TABLE)
    ends = ended.groupBy(*SHEET).agg(F.min("end_row").alias("end_row"))
    rows = rows.join(ends, SHEET, "left").withColumn("after", F.coalesce(F.col("source_row") > F.col("end_row"), F.lit(False)))

    inside = F.col("below") & ~F.col("after") & (F.col("base") == "data")
    last = rows.where(inside & ~F.col("any_total")).groupBy(*SHEET).agg(F.max("source_row").alias("last_data"))
    rows = rows.join(last, SHEET, "left")
    kind = (
        F.when(F.col("source_row") == F.col("header_row"), "header")
        .when(~F.col("anything"), "blank").when(~F.col("below"), "above_header").when(F.col("after"), "footnote")
        .when(F.col("base") == "blank", "blank").when(F.col("base") == "subtotal", "subtotal").when(F.col("base") == "sparse", "footnote")
        .when(F.col("source_row") > F.coalesce("last_data", F.lit(0)), "subtotal").otherwise("data"))
    return rows.select(*SHEET, "source_row", kind.alias("kind"), "values", "value_kinds")


def skipped_rows(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("kind").isin("above_header", "footnote", "subtotal")).select(*SHEET, "source_row", F.col("kind").alias("reason"), "values")


# ---------------------------------------------------------------- columns


def column_names(headers: DataFrame) -> DataFrame:
    """(file, sheet, position, source_header, column): stable machine names, repeats numbered."""
    def base(h: Column, i: Column) -> Column:
        word = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(h, F.lit(""))), r"(?U)[^\w]+", "_"), r"_{2,}", "_")
        word = F.regexp_replace(word, "^_+|_+$", "")
        return F.when(word == "", F.concat(F.lit("col_"), (i + 1).cast("string"))).when(
            word.rlike(r"(?U)^\d"), F.concat(F.lit("c_"), word)).otherwise(word)

    def place(taken: Column, name: Column) -> Column:
        numbered = F.filter(
            F.transform(F.sequence(F.lit(2), F.size(taken) + 2), lambda n: F.concat(name, F.lit("_"), n.cast("string"))),
            lambda c: ~F.array_contains(taken, c))
        return F.concat(taken, F.array(F.when(F.array_contains(taken, name), numbered[0]).otherwise(name)))

    bases = F.transform("headers", base)
    named = headers.withColumn("names", F.aggregate(bases, F.array().cast("array<string>"), place))
    return named.select(*SHEET, F.posexplode(F.arrays_zip("headers", "names")).alias("position", "c")).select(
        *SHEET, "position", F.coalesce("c.headers", F.lit("")).alias("source_header"), F.col("c.names").alias("column"))


def infer_columns(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Type vote per column over the data rows, with the evidence behind it."""
    data = rows.where("kind = 'data'").select(
        *SHEET, "source_row", F.posexplode(F.arrays_zip("values", "value_kinds")).alias("position", "c")).select(
        *SHEET, "source_row", "position", F.col("c.values").alias("text"), F.coalesce("c.value_kinds", F.lit("s")).alias("kind"))
    read = read_values(data).where("populated")
    is_number, is_date = F.col("number").isNotNull(), F.col("date").isNotNull()
    order, ambiguous = F.col("date.order"), F.coalesce("date.ambiguous", F.lit(False))
    word = F.lower("text").isin(*fv.BOOLEAN_VOTE_WORDS)
    styles = ("plain", "parentheses", "currency", "thousands", "percent", "credit_suffix")
    votes = read.groupBy(*SHEET, "position").agg(
        F.count(F.lit(1)).alias("non_null"), F.count_if(is_number).alias("numbers"), F.count_if(is_date).alias("dates"),
        F.count_if(is_date & (F.col("kind") == "n")).alias("serials"), F.count_if(word).alias("booleans"),
        F.count_if(ambiguous).alias("ambiguous_dates"),
        *[F.count_if(order == o).alias(o) for o in ("dmy", "mdy")],
        *[F.count_if((order == o) & ~ambiguous).alias(f"sure_{o}") for o in ("dmy", "mdy")],
        *[F.count_if(F.array_contains("number.styles", s)).alias(f"style_{s}") for s in styles])
    names = column_names(headers)
    joined = names.join(votes, [*SHEET, "position"], "left").fillna(0)
    n = F.nullif(F.col("non_null"), F.lit(0))
    number, date, boolean = F.col("numbers") / n, F.col("dates") / n, F.col("booleans") / n
    hinted = F.lower("source_header").rlike("|".join(fv.DATE_HEADER_WORDS))
    masquerade = (F.col("dates") > 0) & (F.col("serials") == F.col("dates")) & (number >= 0.7) & ~hinted
    kind = (
        F.when(F.col("non_null") == 0, "empty").when(masquerade, "number").when((date >= 0.7) & (date >= number), "date")
        .when(number >= 0.7, "number").when(boolean >= 0.9, "boolean").otherwise("text"))
    typed = joined.withColumn("inferred_type", kind)
    confidence = (
        F.when(F.col("inferred_type") == "empty", 1.0).when(F.col("inferred_type") == "number", number)
        .when(F.col("inferred_type") == "date", date).when(F.col("inferred_type") == "boolean", boolean)
        .otherwise(1 - F.greatest(number, date)))
    failures = F.when(F.col("inferred_type") == "number", F.col("non_null") - F.col("numbers")).when(
        F.col("inferred_type") == "date", F.col("non_null") - F.col("dates")).otherwise(0)
    chosen = (
        F.when(F.col("sure_dmy") + F.col("sure_mdy") > 0, F.when(F.col("sure_mdy") > F.col("sure_dmy"), "mdy").otherwise("dmy"))
        .when(F.col("mdy") > F.col("dmy"), "mdy").otherwise("dmy"))
    return typed.select(
        *SHEET, "position", "source_header", "column", "inferred_type", F.round(confidence, 3).alias("type_confidence"),
        "non_null", failures.alias("parse_failures"), F.when(F.col("inferred_type") == "date", chosen).alias("date_order"),
        F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"style_{s}") > 0, F.lit(s)) for s in styles]))).alias("number_styles"),
        "ambiguous_dates")


def table_summary(rows: DataFrame, headers: DataFrame, columns: DataFrame) -> DataFrame:
    """Per sheet: rows, confidence and shape fingerprint."""
    counts = rows.where("kind = 'data'").groupBy(*SHEET).agg(
        F.count(F.lit(1)).alias("data_rows"), F.min("source_row").alias("first_data_row"), F.max("source_row").alias("last_data_row"))
    typed = F.col("inferred_type").isin("date", "number", "boolean")
    facts = columns.groupBy(*SHEET).agg(
        F.coalesce(F.avg(F.when(typed, F.col("type_confidence"))), F.lit(0.5)).alias("type_confidence"),
        F.array_sort(F.collect_list(F.struct("position", F.concat_ws(":", "column", "inferred_type").alias("part")))).alias("parts"),
        F.array_sort(F.collect_list("column")).alias("names"))
    joined = headers.join(counts, SHEET).join(facts, SHEET)
    confidence = 0.45 * F.col("score") + 0.40 * F.col("type_confidence") + 0.15 * F.least(F.lit(1.0), F.col("data_rows") / 20)
    shape = F.concat_ws(
        "|", F.concat(F.lit("header@"), "header_row"), F.concat(F.lit("cols="), F.col("last_col") - F.col("first_col") + 1),
        F.concat_ws("|", F.transform("parts", lambda p: p["part"])))
    return joined.select(
        *SHEET, "header_row", "first_data_row", "last_data_row", "data_rows", F.round(confidence, 3).alias("confidence"),
        F.substring(F.sha2(shape, 256), 1, 32).alias("source_signature"),
        F.substring(F.sha2(F.concat_ws("|", "names"), 256), 1, 32).alias("column_hash"))


def outcomes(cells: DataFrame, headers: DataFrame, summary: DataFrame) -> DataFrame:
    """One row for every sheet: its header row and data rows, or why no table was found in it."""
    sheets = cells.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("rows"))
    known = sheets.join(headers.select(*SHEET, "header_row"), SHEET, "left").join(summary.select(*SHEET, "data_rows"), SHEET, "left")
    reason = F.when(F.col("header_row").isNull(), f"none of the first {fv.HEADER_SEARCH_ROWS} rows reads as a header").when(
        F.col("data_rows").isNull(), "no data below the header")
    return known.select(*SHEET, "rows", "header_row", F.coalesce("data_rows", F.lit(0)).alias("data_rows"), reason.alias("reason"))


def primary_tables(summary: DataFrame) -> DataFrame:
    """The sheet with most rows per file, then the more confident one."""
    return summary.groupBy("file").agg(F.max(F.struct("data_rows", "confidence", "sheet")).alias("p")).select("file", F.col("p.sheet").alias("sheet"))


def parse_warnings(columns: DataFrame) -> DataFrame:
    low = columns.where(F.col("inferred_type").isin("date", "number") & (F.col("type_confidence") < 0.8)).select(
        *SHEET, "column", F.concat("inferred_type", F.lit(" inferred at low confidence")).alias("warning"))
    vague = columns.where("ambiguous_dates > 0").select(
        *SHEET, "column", F.concat(F.col("ambiguous_dates"), F.lit(" date(s) could be day-first or month-first; read as "), F.coalesce("date_order", F.lit("dmy"))).alias("warning"))
    return low.unionByName(vague)


def build_table(rows: DataFrame, columns: list, keep_sheet: bool = False) -> DataFrame:
    """Typed table for sheets that share one shape.

    ``columns`` are collected rows of :func:`infer_columns` for that shape, one per column. Each
    sheet's own order of day and month rides with its rows in the map ``date_orders`` (position to
    order). Numbers and dates keep their text beside them as ``__raw_``.
    """
    out = [F.col("source_row").alias("__source_row")]
    if keep_sheet:
        out += [F.col(c) for c in SHEET]
    staged, parsed = rows.where("kind = 'data'"), {}
    for c in columns:
        name, i = c["column"], c["position"]
        text = F.try_element_at("values", F.lit(i + 1))
        kind = F.coalesce(F.try_element_at("value_kinds", F.lit(i + 1)), F.lit("s"))
        value = F.when(~_null_word(text), text)
        if c["inferred_type"] == "number":
            parsed[f"__p{i}"] = S.number_struct(value)["value"]
        elif c["inferred_type"] == "date":
            own = F.try_element_at("date_orders", F.lit(i))
            order = F.when(own.isin("dmy", "mdy"), own).otherwise("dmy")
            parsed[f"__p{i}"] = F.when(kind == "n", S.serial_date_struct(value)["value"]).when(
                kind == "d", F.substring(value, 1, 10).try_cast("date")).otherwise(S.date_struct(value, order)["value"])
        elif c["inferred_type"] == "boolean":
            parsed[f"__p{i}"] = F.when(value.isNotNull(), F.lower(value).isin(*fv.TRUE_WORDS))
        else:
            parsed[f"__p{i}"] = value
        out.append(F.col(f"__p{i}").alias(name))
        if c["inferred_type"] in ("number", "date"):
            out.append(value.alias(f"__raw_{name}"))
    return staged.withColumns(parsed).select(*out)


def declared_figures(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Figures on the last summary row of each sheet, matched to number columns by place."""
    last = rows.where("kind = 'subtotal'").groupBy(*SHEET).agg(F.max(F.struct("source_row", "values")).alias("t"))
    cells = last.select(*SHEET, F.col("t.source_row").alias("source_row"), F.posexplode("t.values").alias("position", "text"))
    read = cells.withColumn("declared", S.number_struct(F.col("text"))["value"]).where("declared is not null")
    numbers = columns.where("inferred_type = 'number'").select(*SHEET, "position", "column")
    return read.join(numbers, [*SHEET, "position"]).select(*SHEET, "column", "declared", "source_row")


class Workbooks:
    """The stages for one cells table, each a DataFrame written once to the checkpoint folder."""

    def __init__(self, cells: DataFrame):
        self.cells = cells
        self.headers = stage(find_headers(cells), "headers")
        self.rows = stage(classify_rows(cells, self.headers), "rows")
        self.columns = stage(infer_columns(self.rows, self.headers), "columns")
        self.summary = table_summary(self.rows, self.headers, self.columns)
        self.outcomes = outcomes(cells, self.headers, self.summary)

    def shapes(self) -> list[str]:
        """The distinct shapes of all sheets, in order; a shape is one typed table."""
        return [r[0] for r in self.summary.select("source_signature").distinct().orderBy("source_signature").collect()]

    def table(self, file: str | None = None, sheet: str | None = None, signature: str | None = None) -> DataFrame:
        """One sheet's table, or all sheets of one shape (``signature``) as one table."""
        wanted = self.summary
        for name, value in (("file", file), ("sheet", sheet), ("source_signature", signature)):
            if value is not None:
                wanted = wanted.where(F.col(name) == value)
        wanted = wanted.select(*SHEET)
        one = self.columns.join(wanted.orderBy(*SHEET).limit(1), SHEET).orderBy("position").collect()
        orders = self.columns.where("inferred_type = 'date'").groupBy(*SHEET).agg(
            F.map_from_entries(F.collect_list(F.struct("position", "date_order"))).alias("date_orders"))
        facts = wanted.join(orders, SHEET, "left")  # one row a sheet
        return stage(build_table(self.rows.join(facts, SHEET), one, keep_sheet=signature is not None), "table")
