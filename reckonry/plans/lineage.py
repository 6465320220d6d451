"""Version storage, registration and lineage queries."""

import uuid

from pyspark.sql import Window, functions as F

from reckonry.operators.profile import SOURCE_ROW
from reckonry.plans.catalog import Tables, query
from reckonry.plans.staging import checkpoint_folder
from reckonry.sources import versions as V


def manifest(t: Tables):
    """Each order is a version of its customer's dataset; every tenth starts from a new upload."""
    before = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    first = F.lag("o_orderkey").over(before)
    upload = F.when(first.isNull() | (F.col("o_orderkey") % 10 == 0), F.concat(F.lit("u"), "o_orderkey"))
    return t.orders.select(
        F.col("o_orderkey").alias("version_id"), F.col("o_custkey").alias("dataset"), (F.row_number().over(before) - 1).alias("version_no"),
        first.alias("parent_version_id"), upload.alias("upload_id"), F.lit("cleaned").alias("kind"))


_MANIFEST = """
    with m as (select o_orderkey as v, o_custkey as d, lag(o_orderkey) over w as p, row_number() over w - 1 as no from orders window w as (partition by o_custkey order by o_orderkey)),
         u as (select *, case when p is null or v % 10 = 0 then v end as own from m),
         s as (select *, max(own) over (partition by d order by v) as origin from u)"""


@query("S7", _MANIFEST + " select v as version_id, 'u' || origin as source_upload from s")
def version_origins(t: Tables):
    return V.source_uploads(manifest(t))


@query("S7", _MANIFEST + """
    select a.v as version_id, b.v as ancestor, 'cleaned' as kind, a.no - b.no as steps from m a join m b on a.d = b.d and b.no <= a.no""")
def version_ancestry(t: Tables):
    return V.ancestry(manifest(t))


@query("S8", _MANIFEST + """
    , l as (select l_orderkey, count(*) as n, cast(sum(l_quantity) as bigint) as q from lineitem where l_returnflag = 'R' group by 1)
    select v as version_id, 'file-' || origin || '.csv' as source_filename, own is not null as parsed_directly,
           case when own is null then no - 1 end as parent_version_no, case when own is null then n end as applied_changes, case when own is null then q end as applied_rows
    from s left join l on l_orderkey = p""")
def version_provenance(t: Tables):
    uploads = t.orders.select(F.concat(F.lit("u"), "o_orderkey").alias("upload_id"), F.concat(F.lit("file-"), F.col("o_orderkey"), F.lit(".csv")).alias("filename"), F.col("o_orderdate").alias("uploaded_at"))
    proposals = t.lineitem.select(
        F.col("l_orderkey").alias("dataset_version"), F.when(F.col("l_returnflag") == "R", "applied").otherwise("rejected").alias("status"), F.col("l_quantity").cast("long").alias("affected_rows"))
    return V.provenance(manifest(t), uploads, proposals).drop("uploaded_at")


@query("S6", _MANIFEST + """
    select c_custkey as dataset, coalesce(max(no) + 1, 0) as version_no, max(v) as parent_version_id from customer left join m on d = c_custkey group by 1""")
def version_registration(t: Tables):
    fresh = t.customer.select(F.col("c_custkey").alias("dataset"), (-F.col("c_custkey")).alias("version_id"), F.lit(None).cast("long").alias("parent_version_id"))
    return V.register_versions(manifest(t), fresh).select("dataset", "version_no", "parent_version_id")


@query("S1 S5", """
    select o_orderpriority as priority, count(*) as n, cast(sum(cast(round(o_totalprice * 100) as bigint)) as double) / 100 as total from orders group by 1""")
def version_round_trip(t: Tables):
    root = f"{checkpoint_folder(t.spark)}/versions-{uuid.uuid4().hex}"
    data = t.orders.select("o_orderpriority", "o_totalprice", F.col("o_orderkey").alias(SOURCE_ROW))
    path = V.write_version(data, root, "orders", 0)
    return V.read_version(t.spark, path).groupBy(F.col("o_orderpriority").alias("priority")).agg(
        F.count(F.lit(1)).alias("n"), (F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / 100.0).alias("total"))


@query("S9 S10", """
    select strftime(o_orderdate, '%Y-%m-%d') as day, count(*) as n, 2 as columns from orders group by 1""")
def delimited_export(t: Tables):
    path = f"{checkpoint_folder(t.spark)}/export-{uuid.uuid4().hex}"
    data = t.orders.select(
        F.col("o_orderkey").alias(SOURCE_ROW), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_totalprice").alias("total"),
        F.col("o_orderdate").cast("string").alias("__raw_day"))
    V.write_csv(data, path)
    back = t.spark.read.option("header", True).csv(path)
    return back.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.lit(len(back.columns)).alias("columns"))


@query("S2", """
    select 'nation-' || n_regionkey as name, count(*) as data_rows, 3 as width from nation group by 1""")
def delimited_scan(t: Tables):
    """Nations written as semicolon files, one folder per region, read back as cells."""
    from reckonry.sources.delimited import read_cells

    path = f"{checkpoint_folder(t.spark)}/sheets-{uuid.uuid4().hex}"
    t.nation.select("n_regionkey", "n_nationkey", "n_name", F.lit("a|b").alias("note")).repartition("n_regionkey").write.partitionBy("n_regionkey").option("sep", ";").csv(path)
    cells = read_cells(t.spark, path)
    name = F.concat(F.lit("nation-"), F.regexp_extract("file", r"n_regionkey=(\d+)", 1))
    return cells.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("data_rows"), F.max(F.size("cells")).alias("width"))


@query("S2", """
    select o_orderpriority || chr(10) || 'status "' || o_orderstatus || '"' as note, count(*) as n, cast(sum(o_orderkey) as bigint) as keys from orders group by 1""")
def delimited_split_scan(t: Tables):
    """Orders written with quotes and line breaks in cells, read back by line ranges of the files."""
    from reckonry.sources.delimited import read_cells

    path = f"{checkpoint_folder(t.spark)}/notes-{uuid.uuid4().hex}"
    note = F.concat("o_orderpriority", F.lit('\nstatus "'), "o_orderstatus", F.lit('"'))
    t.orders.select("o_orderkey", note.alias("note"), F.lit("a,b").alias("more")).write.option("escape", '"').csv(path)
    cells = read_cells(t.spark, path, whole_bytes=0)
    return cells.groupBy(F.col("cells")[1].alias("note")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("cells")[0].cast("long")).alias("keys"))
