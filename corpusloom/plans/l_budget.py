"""Queries for section L: queue order, budgets, job state. Users of `events` stand in for jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.clock import epoch_micros
from corpusloom.operators import budget as ops
from .registry import query, table

NOW = "2024-01-31 00:00:00"

JOBS_SQL = """jobs as (select user_id as dataset_id, count(*) * (1 + user_id % 50) * 1000 as n_rows, 5 + user_id % 60 as n_features, min(event_id) as inserted,
  case user_id % 5 when 0 then 'binary' when 1 then 'multiclass' when 2 then 'regression' when 3 then 'ranking' else 'binary' end as task_type,
  round(1 + avg(value) / 10, 3) as priority from events group by user_id)"""
MB_SQL = "greatest(least(256.0, n_rows) * (n_features // 2) * 4 + least(256.0, n_rows) * (n_features - n_features // 2) * 2, n_rows * n_features * 4 * 0.15::double) * 1.5::double / (1024 * 1024)"


def jobs(spark, sf):
    five = F.col("user_id") % 5
    task = (F.when(five == 1, "multiclass").when(five == 2, "regression").when(five == 3, "ranking").otherwise("binary"))
    grouped = table(spark, sf, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("inserted"), F.avg("value").alias("m"))
    return grouped.select(F.col("user_id").alias("dataset_id"), (F.col("n") * (1 + F.col("user_id") % 50) * 1000).alias("n_rows"),
                          (5 + F.col("user_id") % 60).alias("n_features"), "inserted", task.alias("task_type"),
                          F.round(1 + F.col("m") / 10, 3).alias("priority"))


def sized(spark, sf):
    return jobs(spark, sf).withColumn("est_mb", ops.estimate_batch_mb("n_rows", "n_features"))


@query("l1_estimate_batch_mb", f"""
with {JOBS_SQL} select dataset_id, round({MB_SQL}, 6) as est_mb,
  round(greatest(least(64.0, n_rows) * n_features * 4 + least(64.0, n_rows) * 3 * 2, n_rows * n_features * 4 * 0.15::double) * 1.5::double / (1024 * 1024), 6) as exact_mb from jobs""")
def l1(spark, sf):
    df = jobs(spark, sf).withColumn("three", F.lit(3))
    return df.select("dataset_id", F.round(ops.estimate_batch_mb("n_rows", "n_features"), 6).alias("est_mb"),
                     F.round(ops.estimate_batch_mb("n_rows", "n_features", 64, "n_features", "three"), 6).alias("exact_mb"))


@query("l2_normalize_task", """
select event_id, case event_id % 6 when 0 then 'regression' when 1 then 'multiclass' when 2 then 'binary' when 3 then 'regression' else 'binary' end as task_type,
  case when event_id % 10 in (0, 1) then 1000 else event_id % 10 end as n_rows, case when event_id % 3 = 0 then 20 else event_id % 3 end as n_features from events""")
def l2(spark, sf):
    six = F.col("event_id") % 6
    raw = (F.when(six == 0, "Regression").when(six == 1, "MULTICLASS").when(six == 2, "text-classification")
           .when(six == 3, "tabular_regressor").when(six == 4, ""))
    df = table(spark, sf, "events").select(
        "event_id", raw.alias("raw"), F.when(F.col("event_id") % 10 != 1, F.col("event_id") % 10).alias("n_rows"),
        (F.col("event_id") % 3).alias("n_features"))
    return ops.with_defaults(df).select("event_id", ops.normalize_task("raw").alias("task_type"), "n_rows", "n_features")


@query("l3_dedupe_keep_first", """
select user_id as dataset_id, min(event_id) as inserted, arg_min(event_type, event_id) as event_type from events group by user_id""")
def l3(spark, sf):
    queue = table(spark, sf, "events").select(F.col("user_id").alias("dataset_id"), F.col("event_id").alias("inserted"), "event_type")
    return ops.dedupe_keep_first(queue)


@query("l4_inverse_size_priority", f"""
with {JOBS_SQL} select dataset_id, round(priority / greatest(1.0, log10(greatest({MB_SQL}, 1.0))), 6) as priority from jobs""")
def l4(spark, sf):
    return sized(spark, sf).select("dataset_id", F.round(ops.inverse_size_priority(), 6).alias("priority"))


ROBIN_SQL = """robin as (select dataset_id, row_number() over (order by s > 3, turn, s) as position from (
  select *, row_number() over (partition by s order by case when s <= 3 then -priority else 0 end, inserted) as turn
  from (select *, coalesce(list_position(['binary','multiclass','regression'], task_type), 4) as s from jobs)))"""


@query("l5_round_robin_interleave", f"with {JOBS_SQL}, {ROBIN_SQL} select dataset_id, position from robin")
def l5(spark, sf):
    return ops.round_robin(jobs(spark, sf)).select("dataset_id", "position")


@query("l6_greedy_budget_select", f"""
with recursive {JOBS_SQL}, {ROBIN_SQL}, q as (select dataset_id, position, n_rows from robin join jobs using (dataset_id)),
take as (select position, dataset_id, n_rows <= 12000000 as selected, if(n_rows <= 12000000, n_rows, 0)::bigint as held from q where position = 1
  union all select q.position, q.dataset_id, t.held + q.n_rows <= 12000000, if(t.held + q.n_rows <= 12000000, t.held + q.n_rows, t.held)
  from take t join q on q.position = t.position + 1)
select dataset_id, position, selected from take""")
def l6(spark, sf):
    queue = ops.round_robin(jobs(spark, sf)).select("dataset_id", "position", "n_rows")
    return ops.greedy_budget(queue, ["position"], "n_rows", 12_000_000).select("dataset_id", "position", "selected")


@query("l7_queue_union", """
with prepared as (select distinct o_custkey as dataset_id from orders)
select dataset_id, null::varchar as task_type, 'prepared' as source from prepared
union all select c_custkey, 'binary', 'catalog' from customer where c_custkey in (select dataset_id from prepared)
union all select user_id, 'regression', 'registry' from (select distinct user_id from events where event_type = 'view') where user_id in (select dataset_id from prepared)""")
def l7(spark, sf):
    prepared = table(spark, sf, "orders").select(F.col("o_custkey").alias("dataset_id")).distinct()
    catalog = table(spark, sf, "customer").select(F.col("c_custkey").alias("dataset_id"), F.lit("binary").alias("task_type"))
    registry = table(spark, sf, "events").select(
        F.col("user_id").alias("dataset_id"), F.lit("regression").alias("task_type"),
        F.when(F.col("event_type") == "view", "ok").otherwise("fail").alias("status")).distinct()
    return ops.queue_union(prepared, catalog, registry)


@query("l8_queue_export", f"""
with {JOBS_SQL} select dataset_id, 'data/' || dataset_id as prepared_dir, task_type, 200 as steps_per_cycle, null::bigint as max_total_steps from jobs""")
def l8(spark, sf):
    queue = jobs(spark, sf).withColumns({
        "prepared_dir": F.concat(F.lit("data/"), F.col("dataset_id").cast("string")), "steps_per_cycle": F.lit(200)})
    return ops.queue_export(queue)


QUEUE_SQL = """queue as (select user_id as dataset_id, event_id as inserted, event_id % 7 as priority, case event_type when 'error' then 'failed' when 'view' then 'done' else 'pending' end as status,
  (value * 100)::bigint as total_steps, 5000::bigint as max_total_steps, 250 + event_id % 100 as steps_per_cycle from events)"""


def queue(spark, sf):
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "done").otherwise("pending")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("dataset_id"), F.col("event_id").alias("inserted"), (F.col("event_id") % 7).alias("priority"),
        status.alias("status"), F.round(F.col("value") * 100).cast("bigint").alias("total_steps"),
        F.lit(5000).cast("bigint").alias("max_total_steps"), (250 + F.col("event_id") % 100).alias("steps_per_cycle"))


@query("l9_next_pending", f"""
with {QUEUE_SQL} select dataset_id, inserted, priority from (select *, row_number() over (partition by dataset_id order by priority, inserted) as rn
  from queue where status = 'pending') where rn = 1""")
def l9(spark, sf):
    return ops.next_pending(queue(spark, sf), ["dataset_id"]).select("dataset_id", "inserted", "priority")


@query("l10_queue_progress", """
with s as (select if(user_id % 5 <> 0, user_id, -1 - user_id) as dataset_id, sum(event_id % 100) as steps, sum(event_id % 1000) as rows_seen, min(nullif(value, 0)) as best, max(event_id) as last
  from events group by 1),
q as (select user_id as dataset_id, 10::bigint as total_steps, 2500::bigint as max_total_steps, 20::bigint as seen, case when user_id % 2 = 0 then 0.5 end as best0
  from events group by user_id)
select dataset_id, (total_steps + coalesce(steps, 0))::bigint as total_steps, (seen + coalesce(rows_seen, 0))::bigint as total_rows_seen,
  round(case when best0 is null then best when best is null then best0 else least(best0, best) end, 4)::double as best_val_loss, last as last_session_at,
  case when last is null then 'failed' when total_steps + steps >= max_total_steps then 'done' else 'pending' end as status
from q left join s using (dataset_id)""")
def l10(spark, sf):
    events = table(spark, sf, "events")
    # sessions of every fifth user belong to no entry
    sessions = events.select(
        F.expr("if(user_id % 5 <> 0, user_id, -1 - user_id)").alias("dataset_id"), (F.col("event_id") % 100).alias("steps_trained"), (F.col("event_id") % 1000).alias("rows_seen"),
        F.nullif("value", F.lit(0.0)).alias("val_loss"), F.col("event_id").alias("ended_at"))
    entries = events.select(F.col("user_id").alias("dataset_id")).distinct().withColumns({
        "status": F.lit("failed"), "total_steps": F.lit(10).cast("bigint"), "max_total_steps": F.lit(2500).cast("bigint"),
        "total_rows_seen": F.lit(20).cast("bigint"), "best_val_loss": F.when(F.col("dataset_id") % 2 == 0, 0.5),
        "last_session_at": F.lit(None).cast("bigint")})
    out = ops.queue_progress(entries, sessions)
    return out.select("dataset_id", "total_steps", "total_rows_seen", F.round("best_val_loss", 4).alias("best_val_loss"),
                      "last_session_at", "status")


@query("l11_step_budget", f"""
with {QUEUE_SQL} select inserted, greatest(0, 5000 - total_steps) as remaining_steps, least(total_steps + steps_per_cycle, 5000) as next_target from queue""")
def l11(spark, sf):
    return ops.step_budget(queue(spark, sf)).select("inserted", "remaining_steps", "next_target")


@query("l12_queue_status", f"""
with {QUEUE_SQL}, q as (select status, total_steps, max_total_steps from queue union all select 'all', total_steps, max_total_steps from queue)
select status, count(*) as entries, sum(total_steps)::bigint as steps_done, sum(max_total_steps)::bigint as steps_budget,
  round(100 * sum(total_steps) / sum(max_total_steps), 1) as percent from q group by status""")
def l12(spark, sf):
    return ops.queue_status(queue(spark, sf))


@query("l13_assert_new_keys", """
select o_custkey as dataset_id, 'old' as origin from (select distinct if(o_totalprice > 350000, o_custkey, -o_custkey) as o_custkey from orders)
union all select c_custkey, 'new' from customer where c_custkey not in (select if(o_totalprice > 350000, o_custkey, -o_custkey) from orders)""")
def l13(spark, sf):
    old = table(spark, sf, "orders").select(F.expr("if(o_totalprice > 350000, o_custkey, -o_custkey)").alias("dataset_id"))
    old = old.distinct().withColumn("origin", F.lit("old"))
    new = table(spark, sf, "customer").select(F.col("c_custkey").alias("dataset_id"))
    new = new.join(old, "dataset_id", "left_anti").withColumn("origin", F.lit("new"))
    return ops.assert_new_keys(old, new)


@query("l14_evict_to_budget", f"""
with f as (select event_id as path, (value * 1000)::bigint as size, greatest(epoch(timestamp '{NOW}') - epoch(ts), 1.0) * greatest((value * 1000)::bigint, 1) as score from events),
t as (select path, size, sum(size) over () as total, coalesce(sum(size) over (order by score desc, path rows between unbounded preceding and 1 preceding), 0) as gone from f)
select path, size, total - gone > total * 0.4 as removed from t""")
def l14(spark, sf):
    files = table(spark, sf, "events").select(F.col("event_id").alias("path"), F.round(F.col("value") * 1000).cast("bigint").alias("size"),
                                              F.col("ts").alias("modified"))
    total = files.agg(F.sum("size")).first()[0]
    out = ops.evict_to_budget(files, F.lit(NOW), total * 0.4)
    return out.select("path", "size", "removed")


JOBSTATE_SQL = f"""reg as (select user_id, arg_max(event_type, event_id) as kind, max(ts) as beat, count(*) as steps from events group by user_id),
states as (select c_custkey as experiment_name, 70 as max_total_steps, steps as current_step,
  case kind when 'error' then 'failed' when 'view' then 'running' when 'click' then 'stale' else 'idle' end as status, beat as heartbeat_at,
  case when user_id % 4 = 0 then beat + interval 2 day end as cooldown_until, user_id from customer left join reg on user_id = c_custkey)"""


def job_tables(spark, sf):
    jobs_ = table(spark, sf, "customer").select(F.col("c_custkey").alias("experiment_name"), F.lit(70).alias("max_total_steps"))
    kind = F.max_by("event_type", "event_id")
    registry = table(spark, sf, "events").groupBy("user_id").agg(kind.alias("kind"), F.max("ts").alias("heartbeat_at"),
                                                                F.count(F.lit(1)).alias("current_step"))
    status = (F.when(F.col("kind") == "error", "failed").when(F.col("kind") == "view", "running")
              .when(F.col("kind") == "click", "stale").otherwise("idle"))
    registry = registry.select(F.col("user_id").alias("experiment_name"), status.alias("status"), "heartbeat_at", "current_step",
                               F.when(F.col("user_id") % 4 == 0, F.col("heartbeat_at") + F.expr("interval 2 days")).alias("cooldown_until"))
    return jobs_, registry


@query("l15_job_state", f"""
with {JOBSTATE_SQL} select experiment_name, case when coalesce(current_step, 0) >= 70 then 'complete' when status = 'failed' then 'failed'
  when cooldown_until > timestamp '{NOW}' then 'cooldown'
  when status = 'stale' or (status = 'running' and epoch_us(timestamp '{NOW}') - epoch_us(heartbeat_at) > 20000000000) then 'recovered' else 'runnable' end as state
from states""")
def l15(spark, sf):
    jobs_, registry = job_tables(spark, sf)
    return ops.job_state(jobs_, registry, F.lit(NOW), 20_000).select("experiment_name", "state")


@query("l16_failure_state", f"""
select event_id, case when coalesce(nullif(event_id % 5, 4), 0) + 1 >= 3 then 'failed' else 'retry_wait' end as status,
  coalesce(nullif(event_id % 5, 4), 0) + 1 as failure_count, epoch_us(timestamp '{NOW}') + greatest(event_id % 100 - 20, 0) * 1000000 as cooldown_us from events""")
def l16(spark, sf):
    df = table(spark, sf, "events").select(
        "event_id", F.nullif(F.col("event_id") % 5, F.lit(4)).alias("failure_count"), F.lit(3).alias("max_retries"),
        (F.col("event_id") % 100 - 20).alias("retry_backoff_seconds"))
    out = ops.failure_state(df, F.lit(NOW))
    return out.select("event_id", "status", "failure_count", epoch_micros("cooldown_until", out.schema["cooldown_until"].dataType).alias("cooldown_us"))
