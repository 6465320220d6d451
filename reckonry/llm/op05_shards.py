"""Two-pass external shuffle of records into shards.

Pass one scatters records by a seeded hash of their number into buckets that fit in memory, so that equal
records part like any others. Pass two shuffles each
bucket by Fisher-Yates (Spark's ``shuffle``), and the buckets laid end to end give every record a
place: place modulo the shard count is its shard, the quotient its slot. So shards differ by one row at
most, and slots have no gaps. Records move once: the tasks that read the shuffled buckets write them into
the shards' folders. All steps are DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from reckonry.plans.staging import stage, stage_path

BUCKET_ROWS, BUCKET_BYTES, BUCKETS_A_TASK = 1 << 16, 32 << 20, 8
#: Buckets and shards hold the whole corpus each.
PACKED = "zstd"


def placed(records: DataFrame, shards: int, seed: int = 17, bytes_of: str | None = None) -> DataFrame:
    """``records`` with shard and slot added (columns of these names are replaced).

    Bucket counts follow from the rows and, if ``bytes_of`` names a column of record sizes, from the
    bytes, so a bucket fits in memory at any size of the input; only a record that is larger makes a larger one. Columns may be of any
    type. The same rows in the same order, from a table or a written stage, get the same places. An empty table stays empty.
    """
    kept = records.drop("shard", "slot")
    spark = records.sparkSession
    rows, size = kept.agg(F.count("*"), F.coalesce(F.sum(bytes_of) if bytes_of else F.lit(0), F.lit(0))).first()
    memory_sized = max(-(-rows // BUCKET_ROWS), -(-int(size) // BUCKET_BYTES), 1)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-memory_sized // BUCKETS_A_TASK))
    buckets = tasks * BUCKETS_A_TASK
    record = F.struct(*(F.col(f"`{c}`") for c in kept.columns))
    scattered = kept.select(record.alias("record"), F.xxhash64(F.lit(seed), F.monotonically_increasing_id()).alias("draw"))
    scattered = scattered.withColumn("bucket", F.pmod("draw", F.lit(buckets)))
    by_draw = lambda a, b: F.when(a["draw"] < b["draw"], -1).when(a["draw"] > b["draw"], 1).otherwise(0)
    gathered = scattered.repartition(tasks, "bucket").groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("draw", "record")), by_draw).alias("records"))
    # buckets and their records in a known order, so that the same input gives the same places
    drawn = gathered.sortWithinPartitions("bucket").select("bucket", F.posexplode(F.shuffle("records", seed)).alias("k", "r"))
    drawn = drawn.select("bucket", "k", "r.record")
    path = stage_path(spark, "buckets")
    drawn.write.option("compression", PACKED).parquet(path)
    drawn = spark.read.schema(drawn.schema).parquet(path)
    counts = drawn.groupBy("bucket").agg(F.count("*").alias("n"))  # one row a bucket
    # written, so that its true size decides the join and records stay in place
    offsets = stage(counts.select("bucket", F.coalesce(F.sum("n").over(
        Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")), "offsets")
    place = F.col("before") + F.col("k")
    return drawn.join(offsets, "bucket").select(
        "record.*", F.pmod(place, F.lit(shards)).cast("int").alias("shard"), F.floor(place / shards).cast("long").alias("slot"))


def write_shards(shuffled: DataFrame, path: str, rows_a_file: int = 1 << 20) -> None:
    """One folder a shard, written from where the rows are; each file's rows are in slot order."""
    shuffled.sortWithinPartitions("shard", "slot").write.option("maxRecordsPerFile", rows_a_file).option("compression", PACKED).partitionBy("shard").parquet(path)


def shard_files(docs: DataFrame, shards: int, rows_a_file: int = 1 << 16) -> DataFrame:
    """``docs`` shuffled whole into shard files in the shared folder, as read back from them, with shard and slot."""
    spark = docs.sparkSession
    sized = docs.withColumn("size", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long"))
    out = placed(sized, shards, bytes_of="size").drop("size")
    path = stage_path(spark, "shards")
    write_shards(out, path, rows_a_file)
    return spark.read.schema(out.schema).parquet(path)


def op5_external_shuffle(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return shard_files(spark.read.parquet(f"{folder}/documents.parquet"), shards=16).select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERY = op5_external_shuffle
SQL = None
