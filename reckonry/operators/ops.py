"""Operational analytics over jobs, questions and review queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reckonry.functions import fixed_values as fv
from reckonry.functions.text import age_bucket, question_signature
from reckonry.plans.skew import lookup
from reckonry.plans.sums import cents, units


def model_used(result: Column) -> Column:
    return F.coalesce(F.get_json_object(result, "$.summary.model_used"), F.get_json_object(result, "$.model_used"))


def _seconds(start: str, end: str) -> Column:
    return (F.unix_micros(F.col(end).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))) / 1e6


def job_telemetry(jobs: DataFrame, workspaces: DataFrame, datasets: DataFrame) -> DataFrame:
    """One row per job with names, duration, model and whether it answered without one."""
    named = jobs.join(workspaces.select("workspace_id", F.col("name").alias("workspace_name")), "workspace_id", "left").join(
        datasets.select("dataset_id", F.col("name").alias("dataset_name")), "dataset_id", "left")
    model = model_used(F.col("result"))
    return named.withColumns({
        "duration_seconds": F.round(_seconds("started_at", "finished_at"), 2), "model_used": model,
        "fell_back": (F.col("status") == "succeeded") & F.col("kind").isin(*fv.MODEL_BACKED_KINDS) & model.isNull()})


def _since_first_model(jobs: DataFrame, kinds) -> DataFrame:
    tagged = jobs.withColumn("model", model_used(F.col("result")))
    since = tagged.where("model is not null").agg(F.min("created_at").alias("since"))
    return tagged.where(F.col("kind").isin(*kinds)).join(F.broadcast(since), F.col("created_at") >= F.col("since"))


def seen_at_work(jobs: DataFrame, kinds=fv.MODEL_BACKED_KINDS) -> DataFrame:
    """(kind, what, name, jobs): every model and worker seen since the first job that recorded a model, a line each."""
    scoped = _since_first_model(jobs, kinds)
    either = scoped.select("kind", F.explode(F.create_map(F.lit("model"), "model", F.lit("worker"), "claimed_by")).alias("what", "name"))
    return either.where("name is not null").groupBy("kind", "what", "name").agg(F.count(F.lit(1)).alias("jobs"))


def model_health(jobs: DataFrame, kinds=fv.MODEL_BACKED_KINDS, names: bool = True) -> DataFrame:
    """Per kind since the first job that recorded a model, with the ``names`` of its models and workers in order.

    Names are made distinct by shuffle (:func:`seen_at_work`) before any list is built, so a list holds each name once.
    """
    scoped = _since_first_model(jobs, kinds)
    ok = F.col("status") == "succeeded"
    bare = ok & F.col("model").isNull()
    tallies = scoped.groupBy("kind").agg(
        F.count_if(ok).alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed_jobs"),
        F.count_if(ok & F.col("model").isNotNull()).alias("model_ran"), F.count_if(bare).alias("degraded"),
        F.min(F.when(bare, F.col("created_at"))).alias("first_degraded_at"), F.max(F.when(bare, F.col("created_at"))).alias("last_degraded_at"),
        F.round(F.avg(_seconds("started_at", "finished_at")), 2).alias("avg_seconds"))
    if not names:
        return tallies
    of = lambda what: F.array_sort(F.collect_list(F.when(F.col("what") == what, F.col("name"))))
    seen = seen_at_work(jobs, kinds).groupBy("kind").agg(of("model").alias("models_seen"), of("worker").alias("workers_seen"))
    none = F.array().cast("array<string>")
    named = tallies.join(seen, "kind", "left").withColumns({c: F.coalesce(c, none) for c in ("models_seen", "workers_seen")})
    return named.withColumns({"models": F.size("models_seen").cast("long"), "workers": F.size("workers_seen").cast("long")})


def degraded_now(health: DataFrame, now: Column, hours: int = fv.DEGRADATION_WINDOW_HOURS) -> DataFrame:
    recent = F.col("last_degraded_at").isNull() | (F.col("last_degraded_at") >= now - F.expr(f"interval {hours} hours"))
    return health.where((F.col("degraded") > 0) & recent).withColumn(
        "share", F.col("degraded") / (F.col("degraded") + F.col("model_ran")))


def rolling_usage(events: DataFrame, user: str, ts: str, seconds: int = fv.UPLOAD_WINDOW_SECONDS,
                  allowed: int = fv.UPLOADS_PER_WINDOW) -> DataFrame:
    """(user, ts, used, oldest, retry_after): events of that user in the window ending at each event.

    A busy user's history is cut into whole seconds.  A window is the seconds
    fully inside it, plus part of its first and of its last second, so no task
    ever sorts more than one second of one user (at most a million distinct
    times after equal times are folded).
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    at = events.groupBy(F.col(user).alias("user"), micros.alias("at")).agg(F.count(F.lit(1)).alias("n"))
    at = at.withColumn("sec", F.expr("at div 1000000"))
    per_sec = at.groupBy("user", "sec").agg(F.sum("n").alias("sn"), F.min("at").alias("s_old"))

    # Whole seconds sec-seconds+1 .. sec-1: blocks of one window length, each row also offered to the next block.
    from pyspark.sql import Window

    blocks = per_sec.select("user", "sec", "sn", "s_old", F.explode(F.array(
        F.floor(F.col("sec") / seconds), F.floor(F.col("sec") / seconds) + 1)).alias("block"))
    inner = Window.partitionBy("user", "block").orderBy("sec").rangeBetween(-(seconds - 1), -1)
    whole = blocks.withColumns({"w_n": F.coalesce(F.sum("sn").over(inner), F.lit(0)), "w_old": F.min("s_old").over(inner)}).where(
        F.col("block") == F.floor(F.col("sec") / seconds)).select("user", "sec", "w_n", "w_old")

    # The partial first second, moved forward so it sorts beside the last one.
    shift = seconds * 1000000
    own = at.select("user", "sec", F.col("at").alias("key"), "n", F.lit(False).alias("tail"), "at")
    tail = at.select("user", (F.col("sec") + seconds).alias("sec"), (F.col("at") + shift).alias("key"), "n", F.lit(True).alias("tail"), "at")
    order = Window.partitionBy("user", "sec").orderBy("key")
    to_here, after = order.rangeBetween(Window.unboundedPreceding, 0), order.rangeBetween(1, Window.unboundedFollowing)
    mine, old = F.when(~F.col("tail"), F.col("n")), F.when(F.col("tail"), F.col("n"))
    edges = own.unionByName(tail).withColumns({
        "o_n": F.sum(mine).over(to_here), "o_old": F.min(F.when(~F.col("tail"), F.col("at"))).over(to_here),
        "t_n": F.coalesce(F.sum(old).over(after), F.lit(0)), "t_old": F.min(F.when(F.col("tail"), F.col("at"))).over(after)}).where(~F.col("tail"))
    used = edges.join(whole, ["user", "sec"]).select(
        "user", "at", "n", (F.col("o_n") + F.col("t_n") + F.col("w_n")).alias("used"), F.least("t_old", "w_old", "o_old").alias("oldest_at"))
    wait = F.ceil((F.col("oldest_at") + shift - F.col("at")) / 1e6)
    return used.select(
        F.col("user").alias(user), F.timestamp_micros("at").alias(ts), F.col("n").alias("events"), "used", F.timestamp_micros("oldest_at").alias("oldest"),
        F.when(F.col("used") < allowed, 0).otherwise(F.greatest(F.lit(1), wait)).cast("int").alias("retry_after"))


def operations(jobs: DataFrame, datasets: DataFrame, family: str | None = None) -> DataFrame:
    """History rows from job results; kinds outside the history fall away."""
    families = F.create_map(*[F.lit(x) for kv in fv.OPERATION_FAMILY.items() for x in kv])
    labels = F.create_map(*[F.lit(x) for kv in fv.OPERATION_LABELS.items() for x in kv])
    field = lambda name: F.get_json_object("result", f"$.{name}")
    named = jobs.where(F.col("kind").isin(*fv.OPERATION_FAMILY)).join(
        datasets.select("dataset_id", F.col("name").alias("dataset_name")), "dataset_id", "left")
    out = named.select(
        "job_id", "workspace_id", "kind", F.element_at(labels, F.col("kind")).alias("label"), F.element_at(families, F.col("kind")).alias("family"),
        "status", "created_at", "finished_at", F.coalesce(field("source_filename"), field("dataset_name"), "dataset_name").alias("source"),
        field("version_no").try_cast("int").alias("version_no"), F.coalesce(field("rows_total"), field("row_count")).try_cast("long").alias("rows"),
        field("rows_categorised").try_cast("long").alias("categorised"), field("rows_flagged").try_cast("long").alias("flagged"), field("model_used").alias("model_used"))
    return out.where(F.col("family") == family) if family else out


def client_board(workspaces: DataFrame, datasets: DataFrame, jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """Per client: tallies, pending money, operations per family and the newest one; most waiting first."""
    families = sorted(set(fv.OPERATION_FAMILY.values()))
    sets = datasets.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("datasets"))
    active = jobs.where(F.col("status").isin("queued", "running")).groupBy("workspace_id").agg(F.count(F.lit(1)).alias("working"))
    waiting = changes.where("status = 'pending'").groupBy("workspace_id").agg(
        F.count(F.lit(1)).alias("pending"), units(F.coalesce(F.sum(F.abs(cents(F.col("materiality")))), F.lit(0))).alias("pending_value"))
    history = operations(jobs, jobs.sparkSession.createDataFrame([], "dataset_id string, name string")).select("workspace_id", "family", "label", "created_at", "job_id")
    done = history.groupBy("workspace_id").pivot("family", families).agg(F.count(F.lit(1)))
    newest = history.groupBy("workspace_id").agg(F.max_by("label", F.struct("created_at", "job_id")).alias("latest"), F.max("created_at").alias("latest_at"))
    board = workspaces
    for part in (sets, active, waiting, done, newest):
        board = board.join(part, "workspace_id", "left")
    return board.fillna(0, ["datasets", "working", "pending", "pending_value", *families]).orderBy(F.desc("pending"), "workspace_id")


# ---------------------------------------------------------------- question history
# A turn has: request_id, workspace_id, question, answer, status, created_at, deleted_at.


def duplicate_questions(turns: DataFrame) -> DataFrame:
    """Questions asked more than once of one client: how often, and which turn is the newest."""
    signed = turns.withColumn("signature", question_signature(F.col("question"))).where("signature <> ''")
    return signed.groupBy("workspace_id", "signature").agg(
        F.count(F.lit(1)).alias("turns"), F.max(F.struct("created_at", "request_id")).alias("n"),
        F.max_by("question", F.struct("created_at", "request_id")).alias("question")).where("turns > 1").select(
        "workspace_id", "signature", "question", "turns", F.col("n.request_id").alias("newest"))


def with_duplicates(turns: DataFrame) -> DataFrame:
    """Adds duplicate (bool) and redundant (a duplicate that is neither newest nor pending).

    Every turn meets its group by a join salted by the turn's own id, whatever the group's size.
    """
    groups = duplicate_questions(turns).select("workspace_id", "signature", F.col("newest").alias("__newest"))
    signed = turns.withColumn("signature", question_signature(F.col("question")))
    joined = lookup(signed, groups, ["workspace_id", "signature"], row="request_id")
    newest = F.col("__newest")
    return joined.withColumns({
        "duplicate": newest.isNotNull(),
        "redundant": newest.isNotNull() & (F.col("request_id") != newest) & (F.col("status") != "pending")}).drop("__newest")


def filter_turns(turns: DataFrame, which: str = "all", search: str = "") -> DataFrame:
    scope = turns.where(F.col("deleted_at").isNotNull() if which == "trash" else F.col("deleted_at").isNull())
    if which == "answered":
        scope = scope.where("status = 'done'")
    elif which == "unanswered":
        scope = scope.where("status <> 'done'")
    elif which == "duplicates":
        scope = with_duplicates(scope).where("duplicate").select(*turns.columns)
    needle = search.strip().lower()
    if needle:
        scope = scope.where(F.lower("question").contains(needle) | F.lower(F.coalesce("answer", F.lit(""))).contains(needle))
    return scope


def filter_counts(turns: DataFrame) -> DataFrame:
    live = F.col("deleted_at").isNull()
    plain = turns.agg(
        F.count_if(live).alias("all"), F.count_if(live & (F.col("status") == "done")).alias("answered"),
        F.count_if(live & (F.col("status") != "done")).alias("unanswered"), F.count_if(~live).alias("trash"))
    repeated = duplicate_questions(turns.where(live)).agg(F.coalesce(F.sum("turns"), F.lit(0)).alias("duplicates"))
    return plain.join(F.broadcast(repeated), F.lit(True))


def group_by_client(turns: DataFrame, workspaces: DataFrame) -> DataFrame:
    groups = turns.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("turns"), F.max("created_at").alias("newest_at"))
    return groups.join(workspaces.select("workspace_id", "name"), "workspace_id", "left").select(
        "workspace_id", F.coalesce("name", F.lit("Removed client")).alias("label"), "turns", "newest_at").orderBy(F.desc("newest_at"), "workspace_id")


def group_by_age(turns: DataFrame, now: Column) -> DataFrame:
    order = F.array(*[F.lit(b) for b in fv.AGE_BUCKETS])
    return turns.groupBy(age_bucket(F.col("created_at"), now).alias("bucket")).agg(
        F.count(F.lit(1)).alias("turns"), F.max("created_at").alias("newest_at")).orderBy(F.array_position(order, F.col("bucket")))
