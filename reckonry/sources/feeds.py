"""Accounting feeds: nested JSON documents and posted ledger lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reckonry.operators.ledger import DOCUMENT_SCHEMA


def parse_documents(lines: DataFrame) -> DataFrame:
    """``(entity, json)`` -> ``(entity, document, malformed)``; bad JSON is kept and flagged."""
    parsed = F.from_json("json", DOCUMENT_SCHEMA, {"mode": "PERMISSIVE"})
    is_object = F.coalesce(F.trim("json").startswith("{"), F.lit(False)) & F.try_parse_json("json").isNotNull()
    return lines.select("entity", parsed.alias("document"), (~is_object).alias("malformed"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Files of ``{"entity": [document, ...]}`` objects, one object per line."""
    text = spark.read.text(path)
    by_entity = F.from_json("value", "map<string,array<string>>")
    pairs = text.select(F.explode(by_entity).alias("entity", "docs"))
    return parse_documents(pairs.select("entity", F.explode("docs").alias("json")))


def posted_lines(lines: DataFrame, start: str, end: str) -> DataFrame:
    """Only posted lines dated inside the inclusive window."""
    day = F.substring("date", 1, 10)
    return lines.where((F.col("parent_state") == "posted") & day.between(start, end))


def read_posted_lines(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    pair = "array<string>"
    schema = (
        f"id long, date string, name string, debit string, credit string, balance string, account_id {pair}, "
        f"partner_id {pair}, product_id {pair}, journal_id {pair}, quantity string, company_currency_id {pair}, parent_state string")
    return posted_lines(spark.read.schema(schema).json(path), start, end)
