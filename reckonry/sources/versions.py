"""Immutable Parquet versions, their manifest and their lineage.

A manifest row: version_id, dataset, version_no, parent_version_id, upload_id,
kind, path, row_count, column_hash, created_at.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reckonry.operators.profile import SOURCE_ROW, business_columns
from reckonry.plans.staging import stage


class VersionMissing(LookupError):
    """The manifest names a path that holds no data."""


def read_version(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        raise VersionMissing(f"no stored data at {path}") from error


def write_version(df: DataFrame, root: str, dataset: str, version_no: int) -> str:
    """Source row first, zstd, and never over an existing version."""
    rest = [c for c in df.columns if c != SOURCE_ROW]
    ordered = df.select(*([SOURCE_ROW] if SOURCE_ROW in df.columns else []), *rest)
    path = f"{root}/dataset={dataset}/v={version_no}"
    ordered.write.option("compression", "zstd").mode("errorifexists").parquet(path)
    return path


def column_hash(names: Column) -> Column:
    """First half of the digest of the sorted names."""
    return F.substring(F.sha2(F.concat_ws("|", F.array_sort(names)), 256), 1, 32)


def register_versions(manifest: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows to append for fresh(version_id, dataset, parent_version_id, ...), one per dataset.

    Numbers follow the highest known; a missing parent is the latest version.
    """
    known = manifest.groupBy("dataset").agg(
        F.max("version_no").alias("__no"), F.max_by("version_id", "version_no").alias("__last"))
    joined = fresh.join(known, "dataset", "left")
    return joined.withColumns({
        "version_no": F.coalesce(F.col("__no") + 1, F.lit(0)),
        "parent_version_id": F.coalesce("parent_version_id", "__last")}).drop("__no", "__last")


def source_uploads(manifest: DataFrame) -> DataFrame:
    """(version_id, source_upload): the upload at or above each version; null when the chain has none.

    Each round doubles how far up every version can see, so a chain of n
    versions takes log2(n) joins, and a cycle simply never resolves.
    """
    look = manifest.select("version_id", F.when(F.col("upload_id").isNull(), F.col("parent_version_id")).alias("up"), "upload_id")
    settled = "upload_id is not null or up is null"
    done = [stage(look.where(settled).select("version_id", "upload_id"), "lineage-settled")]
    left = stage(look.where(f"not ({settled})"), "lineage-open")
    for _ in range(max(1, math.ceil(math.log2(manifest.count() + 1)))):
        if left.isEmpty():
            break
        # an open version looks at what its pointer sees: one that is settled, or one still open
        known = reduce(DataFrame.union, done).select(F.col("version_id").alias("up"), F.col("upload_id").alias("upload2"), F.lit(None).cast(left.schema["up"].dataType).alias("up2"), F.lit(True).alias("settled"))
        above = left.select(F.col("version_id").alias("up"), F.col("upload_id").alias("upload2"), F.col("up").alias("up2"), F.lit(False).alias("settled"))
        seen = stage(left.select("version_id", "up").join(known.union(above), "up", "left"), "lineage-round")
        ended = "coalesce(settled, true)"
        done.append(seen.where(ended).select("version_id", F.col("upload2").alias("upload_id")))
        left = seen.where(f"not {ended}").select("version_id", F.col("up2").alias("up"), F.lit(None).cast(look.schema["upload_id"].dataType).alias("upload_id"))
    lost = left.select("version_id", F.lit(None).cast(look.schema["upload_id"].dataType).alias("upload_id"))  # cycles
    return reduce(DataFrame.union, [*done, lost]).select("version_id", F.col("upload_id").alias("source_upload"))


def ancestry(manifest: DataFrame) -> DataFrame:
    """(version_id, ancestor, kind of the ancestor, steps) for every version, itself at 0 steps.

    Each round doubles how far the known part of every chain reaches, so chains of any length take
    log2 rounds. In a cycle each ancestor keeps its smallest distance.
    """
    node = manifest.select("version_id", "parent_version_id")
    reach = stage(node.select("version_id", F.col("version_id").alias("ancestor"), F.lit(0).cast("long").alias("steps")), "ancestry")
    jump, length, most = stage(node.where("parent_version_id is not null").select("version_id", F.col("parent_version_id").alias("to")), "ancestry-jump"), 1, manifest.count()
    while length <= most and not jump.isEmpty():
        further = jump.join(reach.withColumnRenamed("version_id", "to"), "to").select("version_id", "ancestor", (F.col("steps") + length).alias("steps"))
        reach = stage(reach.union(further).groupBy("version_id", "ancestor").agg(F.min("steps").alias("steps")), "ancestry")
        jump = stage(jump.join(jump.select(F.col("version_id").alias("to"), F.col("to").alias("next")), "to").select("version_id", F.col("next").alias("to")), "ancestry-jump")
        length *= 2
    kinds = manifest.select(F.col("version_id").alias("ancestor"), "kind")
    return reach.join(kinds, "ancestor").select("version_id", "ancestor", "kind", "steps")


def provenance(manifest: DataFrame, uploads: DataFrame, proposals: DataFrame) -> DataFrame:
    """Per version: its source file, when it was uploaded, its parent and what was applied to that parent.

    A version read straight from an upload is derived from nothing, whatever its parent pointer says.
    """
    origin = source_uploads(manifest)
    files = uploads.select(F.col("upload_id").alias("source_upload"), F.col("filename").alias("source_filename"), "uploaded_at")
    parent = manifest.select(F.col("version_id").alias("parent_version_id"), F.col("version_no").alias("parent_version_no"))
    applied = proposals.where("status = 'applied'").groupBy(F.col("dataset_version").alias("parent_version_id")).agg(
        F.count(F.lit(1)).alias("applied_changes"), F.sum("affected_rows").alias("applied_rows"))
    direct = F.col("upload_id").isNotNull()
    full = (
        manifest.join(origin, "version_id", "left").join(files, "source_upload", "left")
        .join(parent, "parent_version_id", "left").join(applied, "parent_version_id", "left"))
    return full.select(
        "version_id", "source_filename", "uploaded_at", direct.alias("parsed_directly"),
        *[F.when(~direct, F.col(c)).alias(c) for c in ("parent_version_no", "applied_changes", "applied_rows")])


def export_rows(df: DataFrame) -> DataFrame:
    """What leaves: no row numbers, no raw companions, same order."""
    return df.select(*business_columns(df))


def write_csv(df: DataFrame, path: str) -> None:
    export_rows(df).write.option("header", True).mode("errorifexists").csv(path)
