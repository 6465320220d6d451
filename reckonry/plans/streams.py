"""Streaming forms run to the end of the given events, checked against batch SQL."""

import uuid

from pyspark.sql import functions as F

from reckonry.plans.catalog import Tables, query
from reckonry.plans.staging import checkpoint_folder
from reckonry.streaming import streams as ST

#: A micro-batch costs the same time however little it brings, so the files of a long history grow and not their number.
FILES = 100


def _path(t: Tables) -> str:
    return f"{checkpoint_folder(t.spark)}/stream-{uuid.uuid4().hex}"


def event_stream(t: Tables):
    events = t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/event[s].parquet")
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


@query("ST3 ST2", """
    select cast(cast(date_trunc('week', ts + interval 2 day) - interval 2 day as date) as varchar) as period_start, count(*) as n,
           cast(sum(cast(round(value * 100) as bigint)) as double) / 100 as total from events group by 1""")
def stream_weekly(t: Tables):
    weekly = ST.tumbling_periods(event_stream(t), "ts", "weekly", [], F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    done = ST.run_updates(weekly, _path(t), ["period_start"])
    return done.select(F.col("period_start").cast("string").alias("period_start"), "n", (F.col("cents") / 100.0).alias("total"))


@query("ST3", "select cast(cast(ts as date) as varchar) as period_start, event_type, count(*) as n from events group by 1, 2")
def stream_daily(t: Tables):
    daily = ST.tumbling_periods(event_stream(t), "ts", "daily", ["event_type"], F.count(F.lit(1)).alias("n"))
    return ST.run_updates(daily, _path(t), ["period_start", "event_type"]).withColumn("period_start", F.col("period_start").cast("string"))


@query("ST3 ST2", """
    select grain, period_start, event_type, count(*) as n, cast(sum(cast(round(value * 100) as bigint)) as bigint) as cents from (
      select 'monthly' as grain, strftime(ts, '%Y-%m-01') as period_start, event_type, value from events
      union all select 'yearly', strftime(ts, '%Y-01-01'), event_type, value from events) group by 1, 2, 3""")
def stream_monthly(t: Tables):
    """Months and years from the same drained days."""
    root = _path(t)
    ST.drain_days(event_stream(t), root, "ts", ["event_type"], {"cents": F.round(F.col("value") * 100).cast("long")})
    both = [ST.period_totals(t.spark, root, g, ["event_type"], ["cents"]).select(
        F.lit(g).alias("grain"), F.col("period_start").cast("string").alias("period_start"), "event_type", "n", "cents") for g in ("monthly", "yearly")]
    return both[0].unionByName(both[1])


@query("ST4", """
    with w as (select user_id, unnest(generate_series(0, 4)) as k, epoch_us(ts) as us from events)
    select user_id, ((us // 60000000) + 1 + k) * 60 as window_end, count(*) as used from w group by 1, 2""")
def stream_rolling_usage(t: Tables):
    done = ST.run_updates(ST.sliding_usage(event_stream(t), "ts", "user_id"), _path(t), ["window_end", "user_id"])
    return done.select("user_id", F.unix_seconds("window_end").alias("window_end"), "used")


@query("ST5", """
    with w as (select event_type as kind, event_id, unnest(generate_series(0, 23)) as k, epoch_us(ts) as us from events)
    select kind, ((us // 3600000000) + 1 + k) * 3600 as window_end, count(*) filter (where event_id % 7 <> 0 and event_id % 3 = 2) as degraded,
           count(*) filter (where event_id % 7 <> 0 and event_id % 3 <> 2) as model_ran from w group by 1, 2""")
def stream_degradation(t: Tables):
    k = F.col("event_id")
    jobs = event_stream(t).select("ts", F.col("event_type").alias("kind"), F.when(k % 7 == 0, "failed").otherwise("succeeded").alias("status"), F.when(k % 3 != 2, "m").alias("model"))
    done = ST.run_updates(ST.sliding_degradation(jobs, "ts"), _path(t), ["window_end", "kind"])
    return done.select("kind", F.unix_seconds("window_end").alias("window_end"), "degraded", "model_ran")


@query("ST1 ST2 E10", """
    select 'user:' || user_id as source_ref, max(event_id) as reading, max(event_id // 1000) as sync from events group by 1""")
def stream_ledger_sync(t: Tables):
    """Events as ledger readings per user and sync of a thousand ids, a sync to a file while they are few, neighbouring ones in a file
    beyond; files arrive in any order."""
    readings = t.events.select(
        F.concat(F.lit("user:"), "user_id").alias("source_ref"), F.col("event_id").alias("reading"), F.expr("event_id div 1000").alias("sync"))
    files = f"{_path(t)}/in"
    readings.groupBy("source_ref", "sync").agg(F.max("reading").alias("reading")).select("source_ref", "reading", "sync").repartitionByRange(
        FILES, F.col("sync")).write.parquet(files)
    stream = t.spark.readStream.schema("source_ref string, reading long, sync long").option("maxFilesPerTrigger", 2).parquet(files)
    return ST.sync_ledger(stream, _path(t), "sync")
