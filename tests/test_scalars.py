import datetime as dt

import pytest
from pyspark.sql import functions as F

from reckonry.functions import scalars as S
from reckonry.functions import text as T


def one(spark, value, build):
    return spark.createDataFrame([(value,)], "v string").select(build(F.col("v")).alias("r")).first()["r"]


def many(spark, values, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["r"] for r in df.select("i", build(F.col("v")).alias("r")).orderBy("i").collect()]


def test_numbers(spark):
    good = [
        ("1,240.00", 1240.0), ("£880.50", 880.5), ("(150.00)", -150.0), ("-410.25", -410.25),
        ("1,200", 1200.0), ("1.234,56", 1234.56), ("1'234'567", 1234567.0), ("120.00 CR", -120.0),
        ("120.00 DR", 120.0), ("15%", 0.15), ("100-", -100.0), ("12,5", 12.5), ("1 234 567", 1234567.0),
        ("1.234.567", 1234567.0), ("(£1,000) CR", 1000.0), ("+5", 5.0), ("- £20", -20.0), ("£-20", -20.0),
        ("12.3%", 0.123), ("１２３", 123.0), ("$3.08 CR", -3.08), ("5.", 5.0), (".5", 0.5),
    ]
    bad = ["", "-", "n/a", "#REF!", "TBC", "not a number", "12abc", "1,23,4", "--5", "(5", "5)", "%", "2026-08-01", None, "..", "1.2.3"]
    got = many(spark, [g for g, _ in good] + bad, lambda c: S.parse_number(c)["value"])
    assert got[: len(good)] == [v for _, v in good]
    assert got[len(good):] == [None] * len(bad)


def test_number_styles(spark):
    got = many(spark, ["(150.00)", "£880.50", "1,240.00", "7", "(£1,000) CR"], lambda c: S.parse_number(c)["styles"])
    assert got == [["parentheses"], ["currency"], ["thousands"], [],
                   ["credit_suffix", "parentheses", "currency", "thousands"]]


@pytest.mark.parametrize("prefer", ["dmy", "mdy"])
def test_dates(spark, prefer):
    raw = ["01/08/2026", "31/01/2026", "2026-08-01", "9 Aug 2026", "01/31/2026", "3-4-69", "3-4-70", "2026/8/1",
           "30/02/2026", "42000", "x", "2026-08-17 19:51:17", "9-August-26", "n/a"]
    got = many(spark, raw, lambda c: S.parse_date(c, prefer))
    d = dt.date
    swap = prefer == "mdy"
    expect = [d(2026, 1, 8) if swap else d(2026, 8, 1), d(2026, 1, 31), d(2026, 8, 1), d(2026, 8, 9),
              d(2026, 1, 31), d(2069, 3, 4) if swap else d(2069, 4, 3), d(1970, 3, 4) if swap else d(1970, 4, 3),
              d(2026, 8, 1), None, None, None, d(2026, 8, 17), d(2026, 8, 9), None]
    assert [g and g["value"] for g in got] == expect
    assert got[0]["ambiguous"] and not got[1]["ambiguous"] and got[1]["order"] == "dmy" and got[4]["order"] == "mdy"


def test_serial(spark):
    assert one(spark, "42000", S.serial_date_struct)["value"] == dt.date(2014, 12, 27)
    assert one(spark, "60", S.serial_date_struct) is None


def test_summary_labels(spark):
    yes = ["Subtotal", "TOTAL", "Grand Total", "Total August 2026", "Subtotal Q3", "Sub-total", "Total:", "c/f", "grand total for the year"]
    no = ["Total Fitness Ltd", "Totally Awesome Widgets", "Sum Services Ltd", "Balance Recruitment", "INV-1007", "", None]
    got = many(spark, yes + no, S.is_subtotal_label)
    assert got == [True] * len(yes) + [False] * len(no)


def test_text_and_keys(spark):
    assert many(spark, ["Fabrikam  Ltd", "  spaced   out  ", "a​b", "ﬁne"], S.normalize_text) == [
        "Fabrikam Ltd", "spaced out", "ab", "fine"]
    keys = many(spark, ["Northwind Supplies Ltd", "northwind supplies", "Contoso Ltd.", "CONTOSO LIMITED",
                        "Smith Ltd", "Smith Holdings Ltd", "Ltd", "O'Neil & Co"], S.entity_key)
    assert keys == ["northwind supplies", "northwind supplies", "contoso", "contoso", "smith",
                    "smith holdings", "ltd", "o neil"]


def test_null_tokens_and_booleans(spark):
    assert many(spark, ["N/A", " - ", "x", None], S.is_null_token) == [True, True, False, True]
    assert many(spark, ["Yes", "0", "maybe"], S.looks_like_boolean) == [True, False, None]


def test_decimal_and_iso(spark):
    assert [str(v) for v in many(spark, [" 12.5 ", "x"], S.to_decimal)] == ["12.50", "None"]
    assert many(spark, ["2026-08-01T10:00", "2026-13-01", "01/02/2026"], S.parse_iso_date) == [dt.date(2026, 8, 1), None, None]


def test_statement_lines(spark):
    assert one(spark, "CARD PAYMENT TO SCREWFIX DIRECT 08/06/26 CARD 4417", T.statement_line) == "screwfix direct"
    assert many(spark, ["What  changed?", " what changed ", "What changed!?"], T.question_signature) == ["what changed"] * 3


def test_redact(spark):
    text = "mail a.b@c.co card 4111 1111 1111 1111 sort 12-34-56 acc 12345678 phone +44 20 7946 0958 at SW1A 1AA"
    assert one(spark, text, T.redact) == (
        "mail [email] card [card]sort [sort-code] acc [account-no] phone [phone] at [postcode]")
