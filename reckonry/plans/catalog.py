"""Registry of runnable queries, each with equivalent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from reckonry.plans.staging import spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


class Tables:
    """The given tables of one folder, read on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """The table dealt out over all cores, for costly row work on a small file."""
        return spread(getattr(self, name))


@dataclass(frozen=True)
class Entry:
    name: str
    covers: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(covers: str, sql: str | None = None):
    """Register a function of :class:`Tables` under its own name."""

    def add(build: Callable[[Tables], DataFrame]):
        name = build.__name__
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Entry(
            name, tuple(covers.split()), lambda spark, folder: build(Tables(spark, folder)), sql
        )
        return build

    return add
