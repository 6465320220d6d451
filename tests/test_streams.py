"""Days drained over several batches and restarts; late rows are kept and counted."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from reckonry.plans import streams as plans
from reckonry.plans.catalog import REGISTRY
from reckonry.streaming import streams as ST

SCHEMA = "ts timestamp, who string, cents long"


def _drained(spark, folder, root):
    stream = spark.readStream.schema(SCHEMA).parquet(folder)
    ST.drain_days(stream, root, "ts", ["who"], {"cents": F.col("cents")})
    return {(str(r.period_start), r.who): (r.n, r.cents, r.closed) for r in ST.period_totals(spark, root, "monthly", ["who"], ["cents"]).collect()}


def test_late_rows_are_kept_beside_the_totals(spark, tmp_path):
    folder, root = str(tmp_path / "in"), str(tmp_path / "out")
    at = lambda m, d: dt.datetime(2026, m, d, 12)

    def arrive(*rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        return _drained(spark, folder, root)

    first = arrive((at(1, 5), "a", 10), (at(1, 30), "a", 5), (at(1, 30), "b", 1))
    assert first == {("2026-01-01", "a"): (2, 15, False), ("2026-01-01", "b"): (1, 1, False)}
    # the watermark is 23 January noon: the 23rd is open, the 22nd has ended
    second = arrive((at(1, 23), "a", 100), (at(1, 22), "a", 1000), (None, "a", 7), (at(3, 1), "b", 2))
    assert second == {("2026-01-01", "a"): (3, 115, True), ("2026-01-01", "b"): (1, 1, True), ("2026-03-01", "b"): (1, 2, False)}
    third = arrive((at(1, 24), "a", 9), (at(2, 28), "b", 3))
    assert third[("2026-02-01", "b")] == (1, 3, False) and third[("2026-01-01", "a")] == (3, 115, True)
    late = sorted((r.reason, r.cents, r.batch) for r in ST.late_rows(spark, root).collect())
    assert late == [("late", 9, 2), ("late", 1000, 1), ("no time", 7, 1)]
    assert _drained(spark, folder, root) == third  # a restart without new rows
    assert sum(n for n, *_ in third.values()) + len(late) == 9
    years = ST.period_totals(spark, root, "yearly", [], ["cents"]).collect()
    assert [(str(r.period_start), r.n, r.cents, r.closed) for r in years] == [("2026-01-01", 6, 121, False)]


def test_months_have_no_window(spark):
    with pytest.raises(ValueError):
        ST.tumbling_periods(spark.createDataFrame([], SCHEMA), "ts", "monthly", [], F.count(F.lit(1)))
    with pytest.raises(ValueError):
        ST.period_totals(spark, "/tmp/no-such-folder-here", "yearly", [], ["cents"])


def test_a_long_history_of_syncs_takes_few_batches(spark, tmp_path, monkeypatch):
    """One event to a sync, 301 syncs, dealt to three users; 151 batches when each sync had a file of its own."""
    spark.range(301).selectExpr("id * 1000 as event_id", "id % 3 as user_id").write.parquet(f"{tmp_path}/events.parquet")
    paths = iter((f"{tmp_path}/files", f"{tmp_path}/ledger"))
    monkeypatch.setattr(plans, "_path", lambda t: next(paths))
    got = REGISTRY["stream_ledger_sync"].run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [("user:0", 300_000, 300), ("user:1", 298_000, 298), ("user:2", 299_000, 299)]
    batches = [name for name in os.listdir(f"{tmp_path}/ledger/readings") if name.startswith("batch=")]
    assert 10 < len(batches) <= plans.FILES / 2
