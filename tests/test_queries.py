"""A few registered queries of each kind against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_points
from reckonry.plans.catalog import REGISTRY
from reckonry.plans.check import compare, sql_connection

FOLDER = "/root/testdata/sf0.001"
SOME = (
    "structured_every_filter", "structured_row_refs", "period_drivers", "kpi_money_columns", "reconcile_buckets", "entity_keys",
    "duplicate_documents", "invoice_key_conflicts", "drop_duplicates_first", "cleaning_change_log", "decided_proposals", "mapping_upsert",
    "run_verdicts", "guidance_changes", "merged_batches", "profit_monthly", "history_counts", "rolling_usage", "version_registration", "stream_daily")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return sql_connection(FOLDER)


@pytest.mark.parametrize("name", SOME)
def test_matches_sql(spark, con, name):
    assert compare(spark, con, REGISTRY[name], FOLDER)[0] == "ok"


def test_entry_points():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
