"""Key tables that meet whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reckonry.plans.staging import stage

#: Keys that a task may hold: some 20 MB.
BROADCAST_KEYS = 500_000


def written_keys(keys: DataFrame, name: str, limit: int = BROADCAST_KEYS) -> DataFrame:
    """``keys`` written and counted: up to ``limit`` they go to every task, so that texts stay where they
    are; beyond it both sides are shuffled."""
    written = stage(keys, name)
    return F.broadcast(written) if written.count() <= limit else written
