"""Queries of this package and their SQL, by name; the entry module adds them to the others."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = (
    "op01_pieces", "op02_decontaminate", "op03_urls", "op04_quality", "op05_shards", "op06_licenses", "op07_neardup", "op08_secrets",
    "op09_token_files", "op10_html", "op11_warc", "op12_conversations", "op13_negatives",
)


def _loaded():
    return [import_module(f"reckonry.llm.{name}") for name in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {m.QUERY.__name__: m.QUERY for m in _loaded()}


def oracle_sql() -> dict[str, str]:
    return {m.QUERY.__name__: m.SQL for m in _loaded() if m.SQL is not None}
