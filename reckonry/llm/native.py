"""Column expressions for words and 5-word shingles that stay inside Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SPACED = r"[\x20\x09-\x0D]+"


def words(text: Column, apart: str = SPACED) -> Column:
    """Lower-case words of the whole text; none for a null or blank one."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), apart), lambda w: w != "")


def with_shingles(df: DataFrame, column: str, text: str = "text", size: int = 5, apart: str = SPACED) -> DataFrame:
    """``df`` with 64-bit hashes of each run of ``size`` words of ``text``, in order, as ``column``.

    A shorter text is one shingle as a whole, a blank one none. Words and their hashes are columns of
    their own, so that they are worked out once a text and not once a shingle.
    """
    hashed = df.withColumn("__w", words(F.col(text), apart)).withColumn("__w", F.transform("__w", lambda w: F.xxhash64(w)))
    runs = F.transform(F.sequence(F.lit(0), F.size("__w") - size), lambda i: F.xxhash64(*(F.get("__w", i + k) for k in range(size))))
    return hashed.withColumn(column, F.when(F.size("__w") >= size, runs).when(F.size("__w") > 0, F.array(F.xxhash64("__w"))).otherwise(
        F.array().cast("array<long>"))).drop("__w")
