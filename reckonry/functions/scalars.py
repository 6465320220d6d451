"""Column builders that read what people type into sheets.

Each takes a string column and returns a column, so one call covers a whole
table.  The compatibility fold runs in the JVM through Spark's ``reflect``
function, which Spark treats as non-deterministic: put the result in a column
(``withColumn``) before aggregating over it or joining on it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F

from reckonry.functions import fixed_values as fv

NON_ASCII = r"[^\x00-\x7F]"
GROUP_MARK = "\u0001"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def one_of(words) -> str:
    return "(?:" + "|".join(re.escape(w).replace(r"\ ", " ") for w in words) + ")"


def fold_compat(c: Column) -> Column:
    """NFKC fold; plain ASCII values never reach the normaliser."""
    text = c.cast("string")
    folded = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.when(text.rlike(NON_ASCII), folded).otherwise(text)


def tidy(c: Column) -> Column:
    """Collapse whitespace runs and trim; no compatibility fold."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "​", ""), r"(?U)[\s ]+", " "))


UNTIDY = r"[^\x20-\x7E]|^ | $|  "


def normalize_text(c: Column) -> Column:
    """Compatibility fold, then whitespace; one test lets values already clean pass through."""
    text = c.cast("string")
    return F.when(text.rlike(UNTIDY), tidy(fold_compat(text))).otherwise(text)


def groups_of(c: Column, pattern: str, n: int) -> Column:
    """All capture groups of a whole-value pattern from one match; null when it does not match."""
    marked = F.regexp_replace(c, pattern, GROUP_MARK.join(f"${i}" for i in range(1, n + 1)))
    return bind(F.split(marked, GROUP_MARK), lambda parts: F.when(F.size(parts) == n, parts))


def token(c: Column) -> Column:
    """Lower-case normalised text: the key mapping tables are read by."""
    return F.lower(normalize_text(c))


def _is_null_word(normalised: Column) -> Column:
    return F.coalesce(F.lower(normalised).isin(*fv.NULL_TOKENS), F.lit(True))


def is_null_token(c: Column) -> Column:
    return _is_null_word(normalize_text(c))


def _subtotal_pattern() -> str:
    tail = f"(?: (?:{one_of(fv.PERIOD_WORDS)}|[0-9]+))*"
    pairs = [w for w in fv.SUBTOTAL_TOKENS if len(w.split()) == 2]
    return (
        f"^(?:{one_of(fv.SUBTOTAL_TOKENS)}"
        f"|(?:{one_of(fv.SUBTOTAL_LEADING_WORDS)}|{one_of(pairs)}){tail})$"
    )


SUBTOTAL_PATTERN = _subtotal_pattern()


def subtotal_label(normalised: Column) -> Column:
    bare = F.regexp_replace(F.lower(normalised), r"^[ :.*-]+|[ :.*-]+$", "")
    return F.coalesce(bare.rlike(SUBTOTAL_PATTERN), F.lit(False))


def is_subtotal_label(c: Column) -> Column:
    return subtotal_label(normalize_text(c))


# ---------------------------------------------------------------- numbers

_SYMBOLS = f"[{fv.CURRENCY_SYMBOLS}]"
_NUMBER_SHAPE = (
    r"(?i)^(\()?\s*([0-9.,' +%" + fv.CURRENCY_SYMBOLS + r"-]*[0-9][0-9.,' +%"
    + fv.CURRENCY_SYMBOLS + r"-]*?)\s*(\))?\s*(crdr|credit|cr|dr|debit)?$"
)
_SIGNED_BODY = r"^\s*(\+)?\s*(-)?\s*([0-9.,'][0-9.,' ]*?)\s*(-)?\s*(%)?\s*$"


def _ungroup(digits: Column) -> Column:
    """(plain digits, grouped?) for one run of digits and separators."""
    comma, dot = digits.contains(","), digits.contains(".")
    no_comma, no_dot = F.replace(digits, F.lit(",")), F.replace(digits, F.lit("."))

    def pick(text: Column | None, grouped: bool) -> Column:
        value = F.lit(None).cast("string") if text is None else text
        return F.struct(value.alias("text"), F.lit(grouped).alias("grouped"))

    return (
        F.when(comma & dot & digits.rlike(r",[^.]*$"), pick(F.translate(no_dot, ",", "."), True))
        .when(comma & dot, pick(no_comma, True))
        .when(digits.rlike(r"^[^,]*,[^,]{1,2}$"), pick(F.translate(digits, ",", "."), False))
        .when(digits.rlike(r"^[^,]*(?:,[^,]{3})+$"), pick(no_comma, True))
        .when(comma, pick(None, False))
        .when(digits.rlike("[' ]"), pick(F.regexp_replace(digits, "[' ]", ""), True))
        .when(digits.rlike(r"^[^.]*(?:\.[^.]{3}){2,}$"), pick(no_dot, True))
        .otherwise(pick(digits, False))
    )


_PLAIN_NUMBER = r"^-?[0-9]+(?:\.[0-9]+)?$"


def number_struct(normalised: Column) -> Column:
    """struct<value double, styles array<string>> from normalised text; null when not a number."""
    no_styles = F.array().cast("array<string>")

    def result(value: Column, styles: Column) -> Column:
        return F.struct(value.alias("value"), styles.alias("styles"))

    def outer(t: Column) -> Column:
        def from_shape(s: Column) -> Column:
            opened, body, closed = s[0] != "", s[1], s[2] != ""
            suffix = F.lower(s[3])

            def from_body(p: Column) -> Column:
                minus_before, minus_after, percent = p[1] != "", p[3] != "", p[4] != ""

                def finish(g: Column) -> Column:
                    negatives = (
                        suffix.isin("cr", "crdr", "credit").cast("int") + opened.cast("int")
                        + minus_before.cast("int") + minus_after.cast("int")
                    )
                    text = F.when(percent, F.concat(g["text"], F.lit("E-2"))).otherwise(g["text"])
                    styles = F.array_compact(F.array(
                        F.when(suffix != "", F.lit("credit_suffix")),
                        F.when(opened, F.lit("parentheses")),
                        F.when(percent, F.lit("percent")),
                        F.when(body.rlike(_SYMBOLS), F.lit("currency")),
                        F.when(g["grouped"], F.lit("thousands")),
                    ))
                    return bind(text.try_cast("double"), lambda v: F.when(
                        v.isNotNull(), result(F.when(negatives % 2 == 1, -v).otherwise(v), styles)))

                bad = (percent & ~body.rlike(r"%\s*$")) | (minus_before & minus_after)
                return F.when(p.isNotNull() & ~bad, bind(_ungroup(F.trim(p[2])), finish))

            bare = F.trim(F.regexp_replace(body, _SYMBOLS, ""))
            return F.when(s.isNotNull() & (opened == closed), bind(groups_of(bare, _SIGNED_BODY, 5), from_body))

        return F.when(
            t.rlike(_PLAIN_NUMBER), result(t.try_cast("double"), no_styles)
        ).otherwise(
            F.when(t.rlike("[0-9]") & ~_is_null_word(t), bind(groups_of(t, _NUMBER_SHAPE, 4), from_shape))
        )

    return bind(normalised, outer)


def parse_number(c: Column) -> Column:
    """Accounting number in any of the accepted spellings, with the styles it used."""
    return number_struct(normalize_text(c))


# ---------------------------------------------------------------- dates

_NAMED_DATE = r"(?i)^(\d{1,2})[\s-]*(" + "|".join(fv.MONTHS) + r")[a-z]*[\s-]*(\d{2,4})$"
_YMD = r"^(\d{4})([-/])(\d{1,2})\2(\d{1,2})$"
_DMY = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d{2})$"
_DATE_STRUCT = "struct<value:date,ambiguous:boolean,order:string>"


def _full_year(year: Column) -> Column:
    n = year.try_cast("int")
    century = F.when(n < fv.TWO_DIGIT_YEAR_PIVOT, 2000).otherwise(1900)
    return F.lpad(F.when(n < 100, n + century).otherwise(n).cast("string"), 4, "0")


def _date_struct(year: Column, month: Column, day: Column, ambiguous: Column, order: Column) -> Column:
    value = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")).try_cast("date")
    return F.when(
        value.isNotNull(),
        F.struct(value.alias("value"), ambiguous.alias("ambiguous"), order.alias("order")),
    )


def date_struct(normalised: Column, prefer: Column | str = "dmy") -> Column:
    """struct<value, ambiguous, order> from normalised text; null when not a date."""
    prefer = F.lit(prefer) if isinstance(prefer, str) else prefer
    months = F.array(*[F.lit(m) for m in fv.MONTHS])

    def named(p: Column) -> Column:
        month = F.array_position(months, F.lower(F.substring(p[1], 1, 3))).cast("string")
        return F.when(p.isNotNull(), _date_struct(_full_year(p[2]), month, p[0], F.lit(False), F.lit("dmy")))

    def year_first(p: Column) -> Column:
        return F.when(p.isNotNull(), _date_struct(p[0], p[2], p[3], F.lit(False), F.lit("ymd")))

    def year_last(p: Column) -> Column:
        first, second = p[0].try_cast("int"), p[1].try_cast("int")
        month_first = (first <= 12) & ((second > 12) | (prefer == "mdy"))
        return F.when(p.isNotNull(), _date_struct(
            F.when(F.length(p[2]) == 2, _full_year(p[2])).otherwise(p[2]),
            F.when(month_first, p[0]).otherwise(p[1]),
            F.when(month_first, p[1]).otherwise(p[0]),
            (first <= 12) & (second <= 12),
            F.when(month_first, F.lit("mdy")).otherwise(F.lit("dmy")),
        ))

    def read(t: Column) -> Column:
        return F.when(
            t.rlike(r"^\d"),
            F.when(t.rlike("[A-Za-z]"), bind(groups_of(t, _NAMED_DATE, 3), named))
            .when(t.rlike(r"^\d{4}[-/]"), bind(groups_of(t, _YMD, 4), year_first))
            .otherwise(bind(groups_of(t, _DMY, 3), year_last)),
        )

    without_clock = F.regexp_replace(normalised, r"^(\S+)\s+\d{1,2}:\d{2}.*$", "$1")
    return bind(without_clock, read)


def serial_date_struct(number: Column) -> Column:
    """A bare spreadsheet serial as a date."""
    low, high = fv.EXCEL_SERIAL_RANGE
    serial = number.try_cast("double").cast("int")
    return F.when(
        serial.between(low, high),
        F.struct(
            F.date_add(F.lit("1899-12-30").cast("date"), serial).alias("value"),
            F.lit(False).alias("ambiguous"),
            F.lit("excel").alias("order"),
        ),
    ).cast(_DATE_STRUCT)


def parse_date(c: Column, prefer: Column | str = "dmy") -> Column:
    return date_struct(normalize_text(c), prefer).cast(_DATE_STRUCT)


# ---------------------------------------------------------------- words and keys


def looks_like_boolean(c: Column) -> Column:
    word = token(c)
    return F.when(word.isin(*fv.TRUE_WORDS), True).when(word.isin(*fv.FALSE_WORDS), False)


_LEGAL_FORMS = r"(?U)\b(?:" + "|".join(fv.LEGAL_FORM_WORDS) + r")\b"


def entity_key_of(normalised: Column) -> Column:
    """Comparison key from text that is already normalised."""
    words = tidy(F.regexp_replace(F.lower(normalised), r"(?U)[^\w\s]", " "))
    return F.coalesce(F.nullif(tidy(F.regexp_replace(words, _LEGAL_FORMS, " ")), F.lit("")), words)


def entity_key(c: Column) -> Column:
    return entity_key_of(normalize_text(c))


def to_decimal(c: Column, scale: int = 2) -> Column:
    return F.trim(c.cast("string")).try_cast(f"decimal(18,{scale})")


def parse_iso_date(c: Column) -> Column:
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(text, 1, 10).try_cast("date"))
