"""Incremental forms of the ledger sync and the windowed counts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from reckonry.functions import fixed_values as fv
from reckonry.operators.ledger import merge_batches
from reckonry.operators.retail import period_start

LATE = f"{fv.SYNC_OVERLAP_DAYS} days"


def tumbling_periods(events: DataFrame, ts: str, grain: str, keys: list[str], *aggs: Column, late: str = LATE) -> DataFrame:
    """Day and Saturday-week windows, whose state ends with the watermark; months and years roll up from days (:func:`drain_days`)."""
    marked = events.withWatermark(ts, late)
    if grain == "weekly":
        # Windows count from a Thursday; two days on is Saturday.
        when = F.window(ts, "7 days", "7 days", "2 days")
    elif grain == "daily":
        when = F.window(ts, "1 day")
    else:
        raise ValueError(f"no window of constant length is {grain}; drain_days and period_totals have months and years")
    return marked.groupBy(when.alias("w"), *keys).agg(*aggs).withColumn("period_start", F.to_date("w.start")).drop("w")


def drain_days(events: DataFrame, root: str, ts: str, keys: list[str], sums: dict[str, Column], late_days: int = fv.SYNC_OVERLAP_DAYS) -> None:
    """Drain a stream of events now into totals per day and keys: a count ``n`` and the given sums.

    A batch adds its own days' totals in a folder of its own and its latest time in another, so no state is kept between
    batches and one that is run again after a failure writes the same again. The watermark of a batch is the latest time of the
    batches before it less ``late_days``. Rows of days that ended before it, and rows without a time, are
    not counted but kept as they came, with the ``reason``: :func:`late_rows`. Every row is in one of the two.
    """
    spark = events.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            until = watermark(spark, root, late_days, number)
            day = F.to_date(ts)
            closed = F.lit(False) if until is None else F.date_add(day, 1).cast("timestamp") <= F.lit(until)
            reason = F.when(day.isNull(), "no time").when(closed, "late")
            held.where(reason.isNotNull()).withColumn("reason", reason).write.mode("overwrite").parquet(f"{root}/late/batch={number}")
            held.where(reason.isNull()).groupBy(day.alias("day"), *keys).agg(
                F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(name) for name, c in sums.items()]).write.mode("overwrite").parquet(f"{root}/days/batch={number}")
            held.agg(F.max(ts).cast("timestamp").alias("latest")).write.mode("overwrite").parquet(f"{root}/times/batch={number}")
        finally:
            held.unpersist()

    events.writeStream.option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def _batches(spark: SparkSession, root: str, kind: str) -> DataFrame | None:
    try:
        return spark.read.option("basePath", f"{root}/{kind}").parquet(f"{root}/{kind}")
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def watermark(spark: SparkSession, root: str, late_days: int = fv.SYNC_OVERLAP_DAYS, before: int | None = None):
    """The latest time of all batches, or those before one, less the days allowed; None before any."""
    times = _batches(spark, root, "times")
    if times is None:
        return None
    if before is not None:
        times = times.where(F.col("batch") < before)
    return times.agg(F.max("latest") - F.expr(f"interval {late_days} days")).first()[0]


def period_totals(spark: SparkSession, root: str, grain: str, keys: list[str], sums: list[str], late_days: int = fv.SYNC_OVERLAP_DAYS) -> DataFrame:
    """``n`` and the sums per period of any grain and some of the keys, from the drained days, and whether the period is ``closed``: no later row can change it."""
    days = _batches(spark, root, "days")
    if days is None:
        raise ValueError(f"nothing has been drained into {root}")
    until = watermark(spark, root, late_days)
    start = period_start(F.col("day"), grain)
    closed = F.lit(False) if until is None else F.col("period_start") < period_start(F.to_date(F.lit(until)), grain)
    return days.groupBy(start.alias("period_start"), *keys).agg(*[F.sum(v).alias(v) for v in ("n", *sums)]).withColumn("closed", closed)


def late_rows(spark: SparkSession, root: str) -> DataFrame | None:
    """Rows that came too late or have no time, as they came, with the reason and the batch; None before any batch."""
    return _batches(spark, root, "late")


def sliding_usage(events: DataFrame, ts: str, user: str, late: str = "10 minutes") -> DataFrame:
    """Events per user in every 300-second window, a new one each minute."""
    return events.withWatermark(ts, late).groupBy(
        F.window(ts, f"{fv.UPLOAD_WINDOW_SECONDS} seconds", "60 seconds").alias("w"), user).agg(F.count(F.lit(1)).alias("used")).select(
        F.col("w.end").alias("window_end"), user, "used")


def sliding_degradation(jobs: DataFrame, ts: str, late: str = "1 hour") -> DataFrame:
    """Jobs per kind that ran with and without a model, per 24 hours, each hour."""
    bare = (F.col("status") == "succeeded") & F.col("model").isNull()
    return jobs.withWatermark(ts, late).groupBy(
        F.window(ts, f"{fv.DEGRADATION_WINDOW_HOURS} hours", "1 hour").alias("w"), "kind").agg(
        F.count_if(bare).alias("degraded"), F.count_if((F.col("status") == "succeeded") & ~bare).alias("model_ran")).select(
        F.col("w.end").alias("window_end"), "kind", "degraded", "model_ran")


def run_updates(result: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Drain a streaming aggregate now; each batch lands in its own folder, the last update per key counts.

    A batch that is run again after a failure writes the same folder again.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={number}")

    done = result.writeStream.outputMode("update").option("checkpointLocation", f"{path}/progress").trigger(
        availableNow=True).foreachBatch(write).start()
    done.awaitTermination()
    written = result.sparkSession.read.option("basePath", f"{path}/data").parquet(f"{path}/data")
    rest = [c for c in written.columns if c not in (*keys, "batch")]
    return written.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("u")).select(*keys, *[F.col(f"u.{c}") for c in rest])


def sync_ledger(entries: DataFrame, root: str, order: str) -> DataFrame:
    """Drain a stream of ledger readings now; the newest reading of each source_ref by ``order`` counts.

    Each micro-batch lands in a folder of its own, so a batch costs what it brings, and one that is run
    again after a failure writes the same folder again. Readings may come in any order: ``order`` is the
    reading's own time or number. A restart without new data returns what is there.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/readings/batch={number}")

    run = entries.writeStream.option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).foreachBatch(write).start()
    run.awaitTermination()
    return synced_ledger(entries.sparkSession, root, order, entries.schema)


def synced_ledger(spark: SparkSession, root: str, order: str, schema: StructType) -> DataFrame:
    """The ledger that the readings under ``root`` add up to."""
    readings = _readings(spark, root, schema)
    return merge_batches(readings.withColumn("batch_no", F.struct(order, "batch"))).drop("batch_no", "batch")


def sync_figures(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """One row: readings that came, entries kept, and readings that a newer one replaced."""
    named = F.coalesce(F.col("source_ref"), F.lit("")) != ""
    per = _readings(spark, root, schema).groupBy(F.when(named, F.col("source_ref")).alias("ref")).agg(F.count("*").alias("n"))
    kept = F.coalesce(F.sum(F.expr("if(ref is null, n, 1)")), F.lit(0))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("readings"), kept.alias("kept")).withColumn("replaced", F.col("readings") - F.col("kept"))


def _readings(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    wide = StructType([*schema.fields, StructField("batch", LongType())])
    try:
        return spark.read.schema(wide).option("basePath", f"{root}/readings").parquet(f"{root}/readings")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], wide)
