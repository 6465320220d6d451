"""Document feeds: an entry for each line kept, or one of the total, from one reading of the documents."""

import json

from pyspark.sql import functions as F

from reckonry.operators import ledger as E
from reckonry.sources import feeds


def _documents(spark, *docs):
    return feeds.parse_documents(spark.createDataFrame([(entity, d if isinstance(d, str) else json.dumps(d)) for entity, d in docs], "entity string, json string"))


def test_lines_and_totals(spark):
    rent = {"Id": "1", "Amount": "50", "DetailType": "AccountBasedExpenseLineDetail", "Description": "May", "AccountBasedExpenseLineDetail": {"AccountRef": {"name": "Shop rent"}}}
    box = {"Amount": "2.5", "DetailType": "ItemBasedExpenseLineDetail", "ItemBasedExpenseLineDetail": {"ItemRef": {"name": "Box"}, "Qty": "4"}}
    total = {"Id": "2", "Amount": "52.5", "DetailType": "SubTotalLineDetail"}
    day = "2026-05-01"
    entries, skipped = E.entries_from_documents(_documents(
        spark, ("Bill", {"Id": "1", "TxnDate": day, "TotalAmt": "52.5", "Line": [total, rent, box, None]}),
        ("VendorCredit", {"Id": "2", "TxnDate": day, "TotalAmt": "9", "DocNumber": "n7", "VendorRef": {"name": "Ali"}, "Line": [total | {"Amount": "0"}]}),
        ("Invoice", {"Id": "3", "TxnDate": day, "TotalAmt": "0", "Line": [rent | {"Amount": "0"}]}), ("Invoice", {"Id": "4", "TotalAmt": "5", "Line": [rent]}),
        ("Invoice", {"Id": "5", "TxnDate": day, "TotalAmt": "7"}), ("Other", {"Id": "6"}), ("Bill", "not json")))
    assert sorted(skipped.collect()) == [("malformed_document", "Bill"), ("no_dated_lines", "Invoice 3"), ("no_dated_lines", "Invoice 4"), ("unknown_entity", "Other")]
    got = {r.source_ref: (r.kind, r.category, r.classified_by, float(r.amount), r.account, r.description, r["product"], r.counterparty, r.quantity) for r in entries.collect()}
    assert got == {
        "qb:Bill:1:1": ("expense", "rent", "matched", 50.0, "Shop rent", "May", "", "", None),
        "qb:Bill:1:2": ("cogs", "purchases", "unmatched", 2.5, "Box", "", "Box", "", 4),
        "qb:VendorCredit:2:total": ("expense", "other_expense", "unmatched", -9.0, "VendorCredit", "VendorCredit n7", "", "Ali", None),
        "qb:Invoice:5:total": ("revenue", "sales", "matched", 7.0, "Invoice", "Invoice", "", "", None)}


def test_documents_are_read_once(spark, tmp_path):
    body = json.dumps({"Id": "1", "TxnDate": "2026-05-01", "TotalAmt": "5"})
    spark.range(3).select(F.lit("Invoice").alias("entity"), F.lit(body).alias("json")).write.parquet(f"{tmp_path}/docs")
    entries = E.entries_from_documents(feeds.parse_documents(spark.read.parquet(f"{tmp_path}/docs")))[0]
    assert entries._jdf.queryExecution().sparkPlan().toString().count("FileScan parquet") == 1
    assert entries.count() == 3
