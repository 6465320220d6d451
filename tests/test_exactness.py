"""Brute-force checks of the operators that avoid the direct route for scale."""

import datetime as dt
import difflib
import random
import statistics
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from reckonry.operators import analytics as A
from reckonry.operators import ledger as E
from reckonry.operators import ops as O
from reckonry.operators import retail as P
from reckonry.operators.order_statistics import exact_quantiles
from reckonry.operators.query import QueryError, answer
from reckonry.operators.similar import asked_keys, candidate_pairs, closest_spelling, known_keys


def _edited(rng, value, letters, most):
    w = list(value)
    for _ in range(rng.randint(0, most)):
        at = rng.randrange(len(w) + 1)
        if rng.random() < 0.5 and w:
            del w[min(at, len(w) - 1)]
        else:
            w.insert(at, rng.choice(letters))
    return "".join(w)


def test_close_spellings_always_share_a_key():
    rng, close = random.Random(2), 0
    for _ in range(6000):
        letters = rng.choice(["ab", "abcd", "abcdefghij"])
        known = "".join(rng.choice(letters) for _ in range(rng.randint(1, 45)))
        word = _edited(rng, known, letters, int(len(known) * 0.3) + 1)
        if word and difflib.SequenceMatcher(None, known, word).ratio() >= 0.86:
            close += 1
            assert known_keys(known, 0.86) & asked_keys(word, 0.86), (known, word)
    assert close > 2500


def test_candidates_stay_flat_as_names_grow(spark):
    """Names of five syllables out of fifty: common pieces, few true neighbours."""
    rng = random.Random(8)
    syllables = [a + b for a in "bdfgklmnrt" for b in "aeiou"]
    names = sorted({"".join(rng.choice(syllables) for _ in range(5)) for _ in range(8200)})
    rng.shuffle(names)
    words = [_edited(rng, n, "bdfgklmnrtaeiou", 1) for n in names[:1000]]
    asked = spark.createDataFrame([(w,) for w in sorted(set(words))], "word string")
    found = {n: candidate_pairs(asked, spark.createDataFrame([(k,) for k in names[:n]], "candidate string")).count() for n in (1000, 8000)}
    assert found[1000] <= 2 * 1000 and found[8000] <= 3 * found[1000], found


def test_closest_spelling_equals_brute_force(spark):
    rng = random.Random(3)
    known = sorted({"".join(rng.choice("abcde ") for _ in range(rng.randint(2, 18))) for _ in range(150)})
    words = set()
    for k in known:
        for _ in range(4):
            w = list(k)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(w) + 1)
                if rng.random() < 0.5 and w:
                    del w[min(at, len(w) - 1)]
                else:
                    w.insert(at, rng.choice("abcdexyz"))
            words.add("".join(w))
    words = sorted(w for w in words if w)
    expect = {}
    for w in words:
        best = difflib.get_close_matches(w, known, n=1, cutoff=0.86)
        if best and len(w) >= 2:
            expect[w] = best[0]
    got = closest_spelling(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(k,) for k in known], "candidate string"))
    assert {r.word: r.suggestion for r in got.collect()} == expect


def test_quantiles_equal_statistics(spark):
    rng = random.Random(5)
    groups = {"hot": [rng.lognormvariate(3, 3) for _ in range(3001)], "same": [7.0] * 50, "few": [1.0, 2.0], None: [float(i) for i in range(20)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", {"m": 0.5}).collect()}
    assert {g: got[g].m for g in groups} == {g: statistics.median(vs) for g, vs in groups.items()}
    q = {r.g: r for r in exact_quantiles(df, ["g"], "v", {"a": 0.25, "b": 0.75}, exclusive=True).collect()}
    for g in ("hot", "same", None):
        a, _, b = statistics.quantiles(groups[g], n=4)
        assert q[g].a == pytest.approx(a) and q[g].b == pytest.approx(b)


def test_reconcile_equals_all_pairs(spark):
    rng = random.Random(7)
    side = lambda: [(rng.choice(["k1", "k1", "k1", "k2", "k3", None]), rng.choice([None, 10.0, 10.01, 10.02, 25.5, -3.0])) for _ in range(120)]
    a, b = side() + [("onlya", 5.0)], side() + [("onlyb", 6.0), ("onlyb", None)]
    frame = lambda rows: spark.createDataFrame(rows, "k string, v double")
    got = A.reconcile_summary(frame(a), frame(b), ["k"], "v", 0.015).first()
    pairs = [(x, y) for kx, x in a for ky, y in b if kx is not None and kx == ky]
    diff = [0.0 if x is None or y is None else x - y for x, y in pairs]
    far = [d for d in diff if abs(d) > 0.015]
    assert (got.matched, got.matched_with_difference) == (len(diff) - len(far), len(far))
    assert got.difference_total == pytest.approx(sum(far), abs=1e-6)
    assert (got.only_in_a, got.only_in_b) == (sum(k in (None, "onlya") for k, _ in a), sum(k in (None, "onlyb") for k, _ in b))
    listed = A.reconcile_matched(frame(a), frame(b), ["k"], "v").agg(F.sum("pairs")).first()[0]
    assert listed == len(pairs)


def test_rolling_usage_equals_brute_force(spark):
    rng = random.Random(11)
    start = dt.datetime(2026, 1, 1)
    events = [(rng.choice("aab"), start + dt.timedelta(microseconds=rng.choice([0, 1, 300_000_000, rng.randrange(1_500_000_000)]))) for _ in range(400)]
    got = O.rolling_usage(spark.createDataFrame(events, "u string, ts timestamp"), "u", "ts", allowed=30).collect()
    for r in got:
        inside = [t for u, t in events if u == r.u and r.ts - dt.timedelta(seconds=300) < t <= r.ts]
        assert r.used == len(inside) and r.oldest == min(inside)
        assert (r.retry_after == 0) == (len(inside) < 30)


def test_query_errors(spark):
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    for spec in ({}, {"select": ["x"]}, {"select": [3]}, {"select": ["n"], "limit": -1}, {"select": ["n"], "limit": "lots"},
                 {"select": [{"column": "n", "agg": "mode"}]}, {"select": ["n"], "group_by": ["s"]},
                 {"select": ["n"], "filters": [{"column": "n", "op": "near"}]}, {"select": ["n"], "order_by": ["zzz"]}):
        with pytest.raises(QueryError):
            answer(df, spec)
    assert answer(df, {"select": ["n"], "limit": 0}).rows.count() == 0


def ledger_rows(spark, rows):
    df = spark.createDataFrame(rows, "occurred_on string, kind string, category string, amount string, product string, classified_by string")
    full = E.to_ledger(df.withColumn("occurred_on", F.col("occurred_on").cast("date")))
    return E.convert(full.fillna({"currency": "USD"}), spark.createDataFrame([], "currency string, rate double"))


def test_two_months_of_profit(spark):
    m = "matched"
    base = ledger_rows(spark, [
        ("2026-07-05", "revenue", "sales", "4000", "rice", m), ("2026-07-06", "cogs", "purchases", "2400", "", m), ("2026-07-08", "expense", "rent", "600", "", m),
        ("2026-08-05", "revenue", "sales", "4000", "rice", m), ("2026-08-06", "cogs", "purchases", "2900", "", m), ("2026-08-08", "expense", "rent", "600", "", m),
        ("2026-08-09", "expense", "electricity", "300", "", m)])
    periods = P.build_periods(P.daily_cube(base), "monthly")
    july, august = periods.orderBy("period_start").collect()
    assert (august.revenue, august.cogs, august.gross_profit, august.expenses, august.net_profit) == (4000, 2900, 1100, 900, 200)
    assert july.net_profit == 1000
    moved = {r.metric: r for r in P.movements(periods).collect()}
    assert moved["cogs"].difference == 500 and (moved["net_profit"].previous, moved["net_profit"].current) == (1000, 200)
    codes = {r.code for r in P.find_insights(base, "monthly").collect()}
    assert {"profitable", "margin_down", "new_expense", "product_concentration", "quiet_days"} <= codes


def test_sheet_shapes(spark):
    two = spark.createDataFrame([(2, "2026-08-01", "Cash sales", 300.0, None), (3, "2026-08-01", "Transport", None, 40.0), (4, "2026-08-02", "Cash sales", 250.0, 15.0), (5, None, "x", 1.0, None)],
                                "__source_row long, date string, description string, income double, expenses double")
    entries, skipped = E.entries_from_sheet(two, {"date": "date", "description": "description", "income": "income", "expense": "expenses"})
    sums = {r.kind: r.s for r in entries.groupBy("kind").agg(F.sum("amount").alias("s")).collect()}
    assert entries.count() == 4 and sums == {"revenue": Decimal("550"), "expense": Decimal("55")} and skipped.count() == 1
    typed = spark.createDataFrame([(2, "2026-08-01", "Iib", 1800.0), (3, "2026-08-02", "Iibsi", 1100.0)], "__source_row long, taariikh string, nooca string, qiimaha double")
    got, _ = E.entries_from_sheet(typed, {"date": "taariikh", "type": "nooca", "amount": "qiimaha"})
    assert {r.kind: r.amount for r in got.collect()} == {"revenue": Decimal("1800"), "cogs": Decimal("1100")}
    signed = spark.createDataFrame([(2, "2026-08-01", "Iibka", 300.0), (3, "2026-08-01", "Kirada", -150.0)], "__source_row long, d string, n string, q double")
    got, _ = E.entries_from_sheet(signed, {"date": "d", "description": "n", "amount": "q"})
    assert {(r.category, r.kind, r.amount) for r in got.collect()} == {("sales", "revenue", Decimal("300")), ("rent", "expense", Decimal("150"))}


def test_newer_batch_replaces(spark):
    rows = spark.createDataFrame([("a", 1, 300), ("b", 1, 10), ("", 1, 5), ("a", 2, 250), ("", 2, 5)], "source_ref string, batch_no int, amount int")
    assert sorted((r.source_ref, r.amount) for r in E.merge_batches(rows).collect()) == [("", 5), ("", 5), ("a", 250), ("b", 10)]


def test_reporting_window():
    assert P.reporting_window("monthly", dt.date(2026, 9, 1)) == (dt.date(2026, 7, 1), dt.date(2026, 8, 31))
    assert P.reporting_window("weekly", dt.date(2026, 8, 15)) == (dt.date(2026, 8, 1), dt.date(2026, 8, 14))
