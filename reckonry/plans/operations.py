"""Operational queries: events as jobs, conversations as question history."""

from pyspark.sql import functions as F

from reckonry.operators import ops as O
from reckonry.plans.catalog import Tables, query

_KINDS = {"click": "propose_cleaning", "view": "query_dataset", "purchase": "generate_report", "error": "export_dataset"}


def jobs(t: Tables):
    """Each event is a job; its kind, status and result follow from its fields."""
    e = t.events
    ts = F.col("ts").cast("timestamp")
    k = F.col("event_id")
    kinds = F.array(*[F.lit(v) for v in ("propose_cleaning", "query_dataset", "generate_report", "export_dataset", "store_sync")])
    model = F.when(k % 3 == 0, F.lit('{"summary":{"model_used":"m-a"},"row_count":7}')).when(k % 3 == 1, F.lit('{"model_used":"m-b","rows_total":9,"version_no":2}')).otherwise(F.lit("{}"))
    return e.select(
        F.concat(F.lit("j"), k.cast("string")).alias("job_id"), F.element_at(kinds, (k % 5 + 1).cast("int")).alias("kind"),
        F.when(k % 7 == 0, "failed").when(k % 11 == 0, "running").otherwise("succeeded").alias("status"),
        F.col("user_id").cast("string").alias("workspace_id"), (k % 40).cast("string").alias("dataset_id"), F.concat(F.lit("w"), (k % 4).cast("string")).alias("claimed_by"),
        ts.alias("created_at"), ts.alias("started_at"), F.timestamp_micros(F.unix_micros(ts) + (F.col("value") * 100).cast("long") * 10000).alias("finished_at"), model.alias("result"))


def workspaces(t: Tables):
    return t.customer.select(F.col("c_custkey").cast("string").alias("workspace_id"), F.col("c_name").alias("name"))


def datasets(t: Tables):
    return t.nation.select(F.col("n_nationkey").cast("string").alias("dataset_id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("workspace_id"))


_JOBS = """
    with j as (select 'j' || event_id as job_id, ['propose_cleaning', 'query_dataset', 'generate_report', 'export_dataset', 'store_sync'][event_id % 5 + 1] as kind,
                 case when event_id % 7 = 0 then 'failed' when event_id % 11 = 0 then 'running' else 'succeeded' end as status, cast(user_id as varchar) as workspace_id,
                 cast(event_id % 40 as varchar) as dataset_id, 'w' || event_id % 4 as claimed_by, ts as created_at, cast(floor(value * 100) as bigint) / 100.0 as seconds, value, event_id,
                 case event_id % 3 when 0 then 'm-a' when 1 then 'm-b' end as model from events)"""


@query("O1", _JOBS + """
    select job_id, c_name as workspace_name, n_name as dataset_name, model as model_used,
           status = 'succeeded' and kind in ('propose_cleaning', 'generate_report', 'query_dataset') and model is null as fell_back
    from j left join customer on c_custkey = cast(workspace_id as bigint) left join nation on n_nationkey = cast(dataset_id as integer)""")
def job_telemetry(t: Tables):
    return O.job_telemetry(jobs(t), workspaces(t), datasets(t)).select("job_id", "workspace_name", "dataset_name", "model_used", "fell_back")


_HEALTH = _JOBS + """
    , s as (select min(created_at) as t from j where model is not null),
      h as (select kind, count(*) filter (where status = 'succeeded') as succeeded, count(*) filter (where status = 'failed') as failed_jobs,
              count(*) filter (where status = 'succeeded' and model is not null) as model_ran, count(*) filter (where status = 'succeeded' and model is null) as degraded,
              min(created_at) filter (where status = 'succeeded' and model is null) as first_degraded_at, max(created_at) filter (where status = 'succeeded' and model is null) as last_degraded_at,
              count(distinct model) as models, count(distinct claimed_by) as workers
            from j, s where kind in ('propose_cleaning', 'generate_report', 'query_dataset') and created_at >= s.t group by 1)"""


@query("O2", _HEALTH + """
    , n as (select kind, array_to_string(list_sort(list(distinct model) filter (where model is not null)), ',') as models_seen,
              array_to_string(list_sort(list(distinct claimed_by)), ',') as workers_seen
            from j, s where kind in ('propose_cleaning', 'generate_report', 'query_dataset') and created_at >= s.t group by 1)
    select kind, succeeded, failed_jobs, model_ran, degraded, strftime(first_degraded_at, '%Y-%m-%d %H:%M:%S') as first_degraded_at,
           strftime(last_degraded_at, '%Y-%m-%d %H:%M:%S') as last_degraded_at, models_seen, workers_seen, models, workers from h join n using (kind)""")
def model_health(t: Tables):
    h = O.model_health(jobs(t))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    names = lambda c: F.when(F.size(c) > 0, F.concat_ws(",", c)).alias(c)
    return h.select("kind", "succeeded", "failed_jobs", "model_ran", "degraded", stamp("first_degraded_at"), stamp("last_degraded_at"),
                    names("models_seen"), names("workers_seen"), "models", "workers")


@query("O2", _JOBS + """
    , s as (select min(created_at) as t from j where model is not null),
      x as (select * from j, s where kind in ('propose_cleaning', 'generate_report', 'query_dataset') and created_at >= s.t)
    select kind, 'model' as what, model as name, count(*) as jobs from x where model is not null group by 1, 3
    union all select kind, 'worker', claimed_by, count(*) from x where claimed_by is not null group by 1, 3""")
def seen_at_work(t: Tables):
    return O.seen_at_work(jobs(t))


@query("O3", _HEALTH + """
    select kind, degraded, round(degraded / (degraded + model_ran), 6) as share from h where degraded > 0 and last_degraded_at >= (select max(ts) from events) - interval 24 hours""")
def degraded_kinds(t: Tables):
    now = t.events.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    return O.degraded_now(O.model_health(jobs(t), names=False), F.lit(now)).select("kind", "degraded", F.round("share", 6).alias("share"))


@query("O4", """
    with w as (select user_id, ts, count(*) over f as used, min(ts) over f as oldest from events
               window f as (partition by user_id order by ts range between interval '299.999999 seconds' preceding and current row))
    select user_id, epoch_us(ts) as at_us, count(*) as events, max(used) as used, epoch_us(min(oldest)) as oldest_us,
           case when max(used) < 2 then 0 else greatest(1, cast(ceil((epoch_us(min(oldest)) + 300000000 - epoch_us(ts)) / 1000000) as integer)) end as retry_after
    from w group by user_id, ts""")
def rolling_usage(t: Tables):
    return O.rolling_usage(t.events, "user_id", "ts", allowed=2).select(
        "user_id", F.unix_micros("ts").alias("at_us"), "events", "used", F.unix_micros("oldest").alias("oldest_us"), "retry_after")


@query("O5", _JOBS + """
    , p as (select cast(o_custkey as varchar) as w, count(*) as pending, cast(sum(cast(round(o_totalprice * 100) as bigint)) as double) / 100 as v from orders where o_orderstatus = 'O' group by 1),
      h as (select workspace_id as w, count(*) filter (where kind = 'query_dataset') as analysis, count(*) filter (where kind = 'propose_cleaning') as cleaning,
              count(*) filter (where kind = 'export_dataset') as export, count(*) filter (where kind = 'generate_report') as report,
              max_by(case kind when 'query_dataset' then 'Analysis' when 'propose_cleaning' then 'Cleaning review' when 'export_dataset' then 'Export' else 'Report' end, created_at) as latest
            from j where kind <> 'store_sync' group by 1)
    select c_name as name, (select count(*) from nation where n_regionkey = c_custkey) as datasets, (select count(*) from j where workspace_id = cast(c_custkey as varchar) and status = 'running') as working,
           coalesce(pending, 0) as pending, coalesce(v, 0) as pending_value, coalesce(analysis, 0) as analysis, coalesce(cleaning, 0) as cleaning, coalesce(export, 0) as export, coalesce(report, 0) as report, latest
    from customer left join p on p.w = cast(c_custkey as varchar) left join h on h.w = cast(c_custkey as varchar)""")
def client_board(t: Tables):
    changes = t.orders.select(F.col("o_custkey").cast("string").alias("workspace_id"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("applied").alias("status"), F.col("o_totalprice").alias("materiality"))
    return O.client_board(workspaces(t), datasets(t), jobs(t), changes).select(
        "name", "datasets", "working", "pending", "pending_value", "analysis", "cleaning", "export", "report", "latest")


@query("O6", _JOBS + """
    select job_id, case kind when 'query_dataset' then 'analysis' when 'propose_cleaning' then 'cleaning' when 'export_dataset' then 'export' else 'report' end as family, n_name as source,
           case when event_id % 3 = 1 then 2 end as version_no, case event_id % 3 when 0 then 7 when 1 then 9 end as rows, case when event_id % 3 = 1 then 'm-b' end as model_used
    from j left join nation on n_nationkey = cast(dataset_id as integer) where kind <> 'store_sync'""")
def operation_history(t: Tables):
    fixed = F.when(F.get_json_object("result", "$.summary").isNotNull(), F.lit('{"row_count":7}')).otherwise(F.col("result"))
    return O.operations(jobs(t).withColumn("result", fixed), datasets(t)).select("job_id", "family", "source", "version_no", "rows", "model_used")


@query("O6", _JOBS + " select job_id, status from j where kind = 'generate_report'")
def report_history(t: Tables):
    return O.operations(jobs(t), datasets(t), family="report").select("job_id", "status")


def turns(t: Tables):
    """User turns as questions, each asked again in other punctuation by every second conversation."""
    c = t.conversations.where("role = 'user'")
    day = F.date_sub(F.lit("2026-08-31").cast("date"), F.pmod("conv_id", F.lit(60)).cast("int"))
    base = c.select(
        F.concat_ws("-", "conv_id", "turn").alias("request_id"), (F.col("conv_id") % 5).cast("string").alias("workspace_id"), F.col("text").alias("question"),
        F.lit("seen").alias("answer"), F.when(F.col("turn") % 3 == 0, "done").when(F.col("turn") % 3 == 1, "pending").otherwise("failed").alias("status"),
        day.cast("timestamp").alias("created_at"), F.when(F.col("conv_id") % 9 == 0, F.lit("2026-08-31").cast("timestamp")).alias("deleted_at"))
    again = base.withColumns({"request_id": F.concat("request_id", F.lit("b")), "question": F.concat(F.lit("  "), "question", F.lit(" ?!"))})
    return base.unionByName(again)


_SIG = "regexp_replace(regexp_replace(lower(regexp_replace(question, '^\\s+|\\s+$', '', 'g')), '\\s+', ' ', 'g'), '[?.!\\s]+$', '')"
_TURNS = f"""
    with b as (select conv_id || '-' || turn as request_id, cast(conv_id % 5 as varchar) as workspace_id, text as question, 'seen' as answer,
                 case turn % 3 when 0 then 'done' when 1 then 'pending' else 'failed' end as status, date '2026-08-31' - cast(conv_id % 60 as integer) as created_at, conv_id % 9 = 0 as gone
               from conversations where role = 'user'),
         u as (select * from b union all select request_id || 'b', workspace_id, '  ' || question || ' ?!', answer, status, created_at, gone from b),
         t as (select *, {_SIG} as signature from u)"""


@query("T11", _TURNS + """
    , g as (select *, count(*) over w as n, row_number() over (partition by workspace_id, signature order by created_at desc, request_id desc) as i from t where signature <> ''
            window w as (partition by workspace_id, signature))
    select request_id, n > 1 as duplicate, n > 1 and i > 1 and status <> 'pending' as redundant from g""")
def duplicate_turns(t: Tables):
    return O.with_duplicates(turns(t)).where("signature <> ''").select("request_id", "duplicate", "redundant")


@query("T11", _TURNS + " select workspace_id, md5(signature) as signature, count(*) as turns from t where signature <> '' group by workspace_id, t.signature having count(*) > 1")
def duplicate_question_groups(t: Tables):
    return O.duplicate_questions(turns(t)).select("workspace_id", F.md5("signature").alias("signature"), "turns")


@query("O7", _TURNS + """
    select count(*) filter (where not gone) as "all", count(*) filter (where not gone and status = 'done') as answered, count(*) filter (where not gone and status <> 'done') as unanswered,
           count(*) filter (where gone) as trash,
           (select cast(coalesce(sum(n), 0) as bigint) from (select count(*) as n from t where not gone and signature <> '' group by workspace_id, signature having count(*) > 1)) as duplicates from t""")
def history_counts(t: Tables):
    return O.filter_counts(turns(t))


@query("O7", _TURNS + """
    select 'unanswered' as which, request_id from t where not gone and status <> 'done' and contains(lower(question), 'la')
    union all select 'trash', request_id from t where gone
    union all select 'duplicates', request_id from t where not gone and (workspace_id, signature) in (select (workspace_id, signature) from t where not gone and signature <> '' group by all having count(*) > 1)""")
def filtered_history(t: Tables):
    all_turns = turns(t)
    parts = [O.filter_turns(all_turns, w, s).select(F.lit(w).alias("which"), "request_id") for w, s in (("unanswered", " LA "), ("trash", ""), ("duplicates", ""))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("T12 O8", _TURNS + """
    select case when d <= 0 then 'today' when d = 1 then 'yesterday' when d < 7 then 'week' when d < 31 then 'month' else 'earlier' end as bucket, count(*) as turns,
           cast(max(created_at) as varchar) as newest from (select *, date '2026-08-31' - created_at as d from t) group by 1""")
def history_by_age(t: Tables):
    return O.group_by_age(turns(t), F.lit("2026-08-31 15:00:00").cast("timestamp")).select("bucket", "turns", F.to_date("newest_at").cast("string").alias("newest"))


@query("O8", _TURNS + """
    select workspace_id, coalesce(r_name, 'Removed client') as label, count(*) as turns from t left join region on cast(r_regionkey as varchar) = workspace_id and r_regionkey < 3 group by 1, 2""")
def history_by_client(t: Tables):
    names = t.region.where("r_regionkey < 3").select(F.col("r_regionkey").cast("string").alias("workspace_id"), F.col("r_name").alias("name"))
    return O.group_by_client(turns(t), names).select("workspace_id", "label", "turns")
