"""Free-text column builders: redaction, statement lines, question signatures, ages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reckonry.functions import fixed_values as fv
from reckonry.functions.scalars import NON_ASCII, bind, token


def redact(c: Column) -> Column:
    for kind, pattern in fv.REDACTIONS:
        c = F.regexp_replace(c, "(?U)" + pattern, f"[{kind}]")
    return c


def redaction_report(df: DataFrame, column: str) -> DataFrame:
    """Rows and hits per kind; a kind only sees what earlier kinds left behind."""
    staged, text = df.select(F.col(column).alias("t")), "t"
    counts = []
    for i, (kind, pattern) in enumerate(fv.REDACTIONS):
        staged = staged.withColumns({
            f"n{i}": F.regexp_count(F.col(text), F.lit("(?U)" + pattern)),
            f"t{i}": F.regexp_replace(text, "(?U)" + pattern, f"[{kind}]"),
        })
        text = f"t{i}"
        counts += [
            F.sum(f"n{i}").alias(f"hits_{i}"),
            F.count_if(F.col(f"n{i}") > 0).alias(f"rows_{i}"),
        ]
    totals = staged.agg(*counts)
    kinds = F.array(*[
        F.struct(
            F.lit(kind).alias("kind"),
            F.coalesce(F.col(f"hits_{i}"), F.lit(0)).alias("hits"),
            F.col(f"rows_{i}").alias("rows"),
        )
        for i, (kind, _) in enumerate(fv.REDACTIONS)
    ])
    return totals.select(F.inline(kinds))


def words_of(c: Column, word: str) -> Column:
    """The words of a text with one space between; a class of what to keep is read several times as fast as one of what to leave out."""
    return F.array_join(F.regexp_extract_all(c, F.lit(word), F.lit(0)), " ")


#: Matches where one of the noise patterns does, each of which begins at a word boundary.
_ANY_NOISE = r"\b(?:" + "|".join(p.removeprefix(r"\b") for p in fv.LINE_NOISE) + ")"


def statement_line(c: Column) -> Column:
    """The part of a bank line that names the merchant.

    One pattern finds lines without noise, which the others leave alone. Patterns read Unicode classes only
    where a line has characters beyond ASCII; on ASCII both kinds of classes are the same.
    """
    def quiet(line: Column, classes: str) -> Column:
        clean = line
        for pattern in fv.LINE_NOISE:
            clean = F.regexp_replace(clean, classes + pattern, " ")
        return F.when(line.rlike(classes + _ANY_NOISE), clean).otherwise(line)

    def named(text: Column, classes: str) -> Column:
        return bind(F.regexp_replace(text, classes + fv.PAYMENT_PREFIX, ""), lambda line: quiet(line, classes))

    line = bind(token(c), lambda text: F.when(text.rlike(NON_ASCII), named(text, "(?U)")).otherwise(named(text, "")))
    return words_of(line, "[a-z0-9&]+")


def question_signature(c: Column) -> Column:
    flat = F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), r"(?U)\s+", " ")
    return F.regexp_replace(flat, r"(?U)[?.!\s]+$", "")


def age_bucket(ts: Column, now: Column) -> Column:
    days = F.datediff(F.to_date(now), F.to_date(ts))
    return (
        F.when(days <= 0, "today")
        .when(days == 1, "yesterday")
        .when(days < 7, "week")
        .when(days < 31, "month")
        .otherwise("earlier")
    )
