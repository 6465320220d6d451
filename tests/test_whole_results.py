"""Nothing is cut, rounded early or overflows; one case for each way in which it once did."""

import numpy as np
from pyspark.sql import functions as F

from reckonry.operators import analytics as A, grid as G, ledger as E, ops as O, profile as D
from reckonry.operators import order_statistics as Q
from reckonry.operators.query import answer
from reckonry.sources import versions as V
from reckonry.sources.delimited import read_cells
from reckonry.streaming import streams as ST


def test_parts_of_a_cent_add_up(spark):
    df = spark.range(1000).selectExpr("0.004D as amount", "date'2026-01-05' as day", "'x' as who")
    assert A.compare_totals(df, "day", "amount", ("2026-01-01", "2026-01-31"), ("2026-02-01", "2026-02-28")).first().total_a == 4.0
    assert A.compare_drivers(df, "day", "amount", ("2026-01-01", "2026-01-31"), ("2026-02-01", "2026-02-28"), "who").first().total_a == 4.0
    assert A.money_kpis(df, ["amount"]).first().total == 4.0


def test_large_keys_do_not_overflow(spark):
    side = spark.range(2000).selectExpr("1 as k", "1e11D + id as v")
    got = A.reconcile_summary(side, side, ["k"], "v").first()
    assert got.matched + got.matched_with_difference == 4_000_000 and got.difference_total == 0.0


def test_a_question_returns_all_its_groups(spark):
    df = spark.range(3000).selectExpr("id as __source_row", "id % 1500 as g", "1.5D as v")
    got = answer(df, {"select": [{"column": "v", "agg": "sum"}], "group_by": ["g"]})
    assert got.rows.count() == 1500 and got.refs.count() == 3000
    record = got.run_record(spark).first()
    assert (record.row_count, record.ref_count) == (1500, 3000) and spark.read.parquet(record.result_path).count() == 1500


def test_types_follow_from_whole_columns(spark):
    df = spark.range(1000).selectExpr("if(id < 20, '2026-01-02', concat('note ', id)) as mixed", "'2026-01-02' as day")
    assert D.stored_types(df) == {"mixed": "text", "day": "date"}


def test_long_cells(spark, tmp_path):
    (tmp_path / "long.csv").write_text("a,b\n1," + "x" * 140_000 + "\n")
    cells = {r.source_row: r.cells for r in read_cells(spark, str(tmp_path)).collect()}
    assert [len(c) for c in cells[2]] == [1, 140_000]


def test_long_chains(spark):
    rows = [(f"v{i}", i, f"v{i - 1}" if i else None, "u0" if i == 0 else None, "cleaned") for i in range(150)]
    rows += [("a", 0, "b", None, "cleaned"), ("b", 0, "a", None, "cleaned"), ("lone", 0, None, None, "cleaned")]
    manifest = spark.createDataFrame(rows, "version_id string, version_no int, parent_version_id string, upload_id string, kind string")
    origin = {r.version_id: r.source_upload for r in V.source_uploads(manifest).collect()}
    assert len(origin) == 153 and all(origin[f"v{i}"] == "u0" for i in range(150)) and origin["a"] is origin["lone"] is None
    up = {(r.version_id, r.ancestor): r.steps for r in V.ancestry(manifest).collect()}
    assert up["v149", "v0"] == 149 and up["v5", "v5"] == 0 and up["a", "b"] == 1 and len(up) == 150 * 151 // 2 + 5


def test_each_sheet_keeps_its_own_date_order(spark):
    def sheet(name, dates):
        rows = [["Date", "Supplier", "Net"]] + [[d, f"Firm {i}", str(10 + i)] for i, d in enumerate(dates)]
        return [(name, "Sheet1", n, cells) for n, cells in enumerate(rows, 1)]

    cells = sheet("day.csv", ["05/02/2026", "25/02/2026", "26/02/2026", "27/02/2026"]) + sheet("month.csv", ["05/02/2026", "05/25/2026", "05/26/2026", "05/27/2026"])
    books = G.Workbooks(spark.createDataFrame(cells, "file string, sheet string, source_row long, cells array<string>"))
    signatures = {r.source_signature for r in books.summary.collect()}
    assert len(signatures) == 1
    table = books.table(signature=signatures.pop())
    first = {r["file"]: str(r["date"]) for r in table.where("__source_row = 2").collect()}
    assert first == {"day.csv": "2026-02-05", "month.csv": "2026-05-02"}


def test_ledger_sync_in_any_order(spark, tmp_path):
    schema = "source_ref string, reading int, amount int"
    for name, rows in (("b", [("x", 2, 250), ("y", 2, 9)]), ("a", [("x", 1, 300), ("", 1, 5)]), ("c", [("y", 1, 8), ("", 2, 5)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def sync():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        return sorted(map(tuple, ST.sync_ledger(stream, f"{tmp_path}/ledger", "reading").collect()))

    want = [("", 1, 5), ("", 2, 5), ("x", 2, 250), ("y", 2, 9)]
    assert sync() == want and sync() == want  # and again with nothing new
    figures = ST.sync_figures(spark, f"{tmp_path}/ledger", spark.createDataFrame([], schema).schema).first()
    assert (figures.readings, figures.kept, figures.replaced) == (6, 4, 2)


def test_roles_of_many_sheets(spark):
    meta = spark.createDataFrame([
        (1, "a", "Date", "date", 0), (1, "b", "Total sales", "number", 1), (1, "c", "Cost of goods", "number", 2), (1, "d", "Memo", "text", 3),
        (2, "a", "When", "date", 0), (2, "b", "Figure", "number", 1), (2, "c", "Qty", "number", 2)], "sheet int, column string, source_header string, inferred_type string, position int")
    got = {}
    for r in E.column_roles(meta, ["sheet"]).collect():
        got.setdefault(r.sheet, {})[r.role] = r.column
    assert got == {1: {"date": "a", "income": "b", "expense": "c", "description": "d"}, 2: {"date": "a", "quantity": "c", "amount": "b"}}
    assert E.detect_columns(meta.where("sheet = 2"), {"amount": "c"}) == {"amount": "c", "date": "a"}


def test_quantiles_of_a_heavy_tail(spark, monkeypatch):
    monkeypatch.setattr(Q, "KINDS", 50)
    values = [1.0 + k / 7 for k in range(3000)] + [10.0 ** k for k in range(30)] + [5.5] * 400
    df = spark.createDataFrame([(v,) for v in values], "v double")
    want = sorted(values)
    got = Q.exact_quantiles(df, [], "v", {"m": 0.5, "q": 0.9}).first()
    assert got.n == len(values) and got.m == (want[len(want) // 2 - 1] + want[len(want) // 2]) / 2
    at = (len(want) - 1) * 0.9
    assert abs(got.q - (want[int(at)] + (want[int(at) + 1] - want[int(at)]) * (at - int(at)))) < 1e-9


def test_examples_show_keys_whose_totals_cancel(spark):
    a, b = (spark.createDataFrame([("k", v) for v in vs] + [("same", 5.0)], "k string, v double") for vs in ((1.0, 9.0), (2.0, 8.0)))
    assert A.reconcile_summary(a, b, ["k"], "v").first().matched_with_difference == 4
    assert [r.k for r in A.reconcile_examples(a, b, ["k"], "v").where("bucket = 'differing'").collect()] == ["k"]


def test_buckets_of_one_wide_key_equal_all_pairs(spark):
    """10,000 amounts a side in one key, most pairs near; differences that fall on the tolerance count as doubles have them."""
    draw = np.random.default_rng(4)
    a, b = (np.round(draw.integers(-400_000, 400_000, 10_000) / 100, 2) for _ in range(2))
    for tolerance in (1500.05, 0.05, 0.0, 0.1 + 0.2):
        gap = [x - b for x in a]
        near = sum(int((np.abs(g) <= tolerance).sum()) for g in gap)
        far = sum(float(g[np.abs(g) > tolerance].sum()) for g in gap)
        frames = [spark.createDataFrame([("k", float(v)) for v in x] + [(f"own{k}", 1.0) for k in range(9)], "k string, v double").repartition(6) for x in (a, b)]
        got = A.reconcile_summary(*frames, ["k"], "v", tolerance).first()
        assert (got.matched, got.matched_with_difference) == (near + 9, 10**8 - near), tolerance
        assert abs(got.difference_total - far) < 1e-3 * max(1, abs(far) * 1e-9)


def test_wide_key_with_every_pair_near(spark):
    side = spark.range(200_000).select(F.lit("k").alias("k"), F.col("id").cast("double").alias("v"))
    got = A.reconcile_summary(side, side, ["k"], "v", 1e9).first()  # 40,000,000,000 pairs, none of them made
    assert (got.matched, got.matched_with_difference, got.difference_total) == (40_000_000_000, 0, 0.0)


def test_odd_amounts_in_buckets(spark):
    side = spark.createDataFrame([("k", v) for v in (None, 0.0, -0.0, 5.0, 1e-9)], "k string, v double")
    got = A.reconcile_summary(side, side, ["k"], "v", 0.0).first()
    pairs = [0.0 if x is None or y is None else abs(x - y) for x in (None, 0.0, -0.0, 5.0, 1e-9) for y in (None, 0.0, -0.0, 5.0, 1e-9)]
    assert got.matched == sum(d <= 0 for d in pairs) and got.matched_with_difference == sum(d > 0 for d in pairs)
    empty = side.limit(0)
    assert A.reconcile_summary(empty, side, ["k"], "v").first().matched == 0


def test_lines_of_a_heavy_key_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(A, "LINES_A_PART", 50)
    a = spark.createDataFrame([("k", float(v % 30)) for v in range(90)] + [("one", 1.0), (None, 2.0)], "k string, v double")
    b = spark.createDataFrame([("k", float(v % 20)) for v in range(40)] + [("one", 1.0), ("one", 3.0), (None, 2.0)], "k string, v double")
    lines = A.reconcile_matched(a, b, ["k"], "v").collect()
    assert len(lines) == 30 * 20 + 2 and sum(r.pairs for r in lines) == 90 * 40 + 2
    assert {(r.amount_a, r.amount_b) for r in lines if r.k == "k"} == {(float(x), float(y)) for x in range(30) for y in range(20)}
    assert {r.pairs for r in lines if r.many_to_many} == {6}
    assert A.reconcile_matched(a, b, ["k"], "v", totals=True).where("many_to_many").count() == 1


def test_quantiles_over_hundreds_of_decades_take_six_rounds_at_most(spark, monkeypatch):
    draw = np.random.default_rng(6)
    values = np.concatenate([10.0 ** draw.uniform(-300, 300, 15_000) * draw.choice([-1, 1], 15_000), np.zeros(500), [np.inf] * 30, [-np.inf] * 40])
    rounds, narrow = [], Q._narrow
    monkeypatch.setattr(Q, "_narrow", lambda *a: rounds.append(1) or narrow(*a))
    monkeypatch.setattr(Q, "KINDS", 2)
    df = spark.createDataFrame([(float(v), "g") for v in values], "v double, g string")
    want = np.sort(values)
    got = Q.exact_quantiles(df, ["g"], "v", {"first": 0.0, "low": 0.25, "m": 0.5, "last": 1.0}).first()
    assert len(rounds) <= 6 and got.n == len(values)
    assert (got.first, got["last"]) == (-np.inf, np.inf)
    for q, found in ((0.25, got.low), (0.5, got.m)):
        at = (len(want) - 1) * q
        low, high = want[int(at)], want[min(int(at) + 1, len(want) - 1)]
        assert found == low + (high - low) * (at - int(at))


def test_nan_sorts_after_all_others(spark):
    df = spark.createDataFrame([(v,) for v in [float("nan")] * 3 + [1.0, 2.0, -0.0, 0.0]], "v double")
    got = Q.exact_quantiles(df, [], "v", {"m": 0.5, "top": 1.0}).first()
    assert got.n == 7 and got.m == 2.0 and got.top != got.top


def test_medians_of_several_columns_in_one_pass(spark):
    rows = [(k % 3 or None, float(k), None if k % 3 == 1 else float(-k)) for k in range(60)]
    df = spark.createDataFrame(rows, "g int, a double, b double")
    got = {r.g: (r.x, r.y) for r in Q.exact_medians(df, ["g"], {"x": "a", "y": "b"}).collect()}
    assert got == {None: (28.5, -28.5), 1: (29.5, None), 2: (30.5, -30.5)}
    assert tuple(Q.exact_medians(df, [], {"x": "a", "y": "b"}).first()) == (29.5, -29.5)


def test_health_names_all_models_and_workers(spark):
    rows = [("a", "query_dataset", "succeeded", f"w{i % 300}", i, f'{{"model_used":"m{i % 2}"}}') for i in range(600)]
    rows += [("b", "generate_report", "succeeded", None, 9, "{}"), ("c", "propose_cleaning", "failed", "w9", 9, None), ("d", "store_sync", "failed", "z", 9, "{}")]
    jobs = spark.createDataFrame(rows, "job_id string, kind string, status string, claimed_by string, s long, result string").selectExpr(
        "*", "timestamp_seconds(s) created_at", "timestamp_seconds(s) started_at", "timestamp_seconds(s + 2) finished_at")
    got = {r.kind: r for r in O.model_health(jobs).collect()}
    assert set(got) == {"query_dataset", "generate_report", "propose_cleaning"}
    assert got["query_dataset"].models_seen == ["m0", "m1"] and got["query_dataset"].workers_seen == sorted(f"w{i}" for i in range(300))
    assert (got["query_dataset"].models, got["query_dataset"].workers) == (2, 300)
    assert (got["generate_report"].models_seen, got["generate_report"].workers_seen, got["generate_report"].workers) == ([], [], 0)
    assert (got["propose_cleaning"].models_seen, got["propose_cleaning"].workers_seen, got["propose_cleaning"].models) == ([], ["w9"], 0)
