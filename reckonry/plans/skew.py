"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SALTS = 16


def lookup(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", row: str | None = None) -> DataFrame:
    """Join rows to a one-row-per-key table with each key spread over several tasks.

    The salt follows from the row's own identity, the column ``row`` if given, so a
    recomputed task places it the same way.
    ``small`` is repeated once per salt; when it is small enough Spark
    broadcasts it and the salt costs nothing.
    """
    plain = [row] if row else [c for c, t in big.dtypes if "map<" not in t]
    salted = big.withColumn("__salt", F.pmod(F.xxhash64(*plain), F.lit(SALTS)))
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, [*keys, "__salt"], how).drop("__salt")
