"""Queries for section M: logs, rollups, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import metrics as ops
from .registry import low_limits, query, table
from .k_registry import REG_SQL, records
from .l_budget import NOW


@query("m1_status_dashboard", f"with {REG_SQL} select status, count(*) as n, (select count(*) from reg) as job_count from reg group by status")
def m1(spark, sf):
    return ops.status_dashboard(records(spark, sf))


@query("m2_alerts", """
select event_id as experiment_name, event_id || ': status=' || case event_type when 'error' then 'failed' else 'stale' end || ' failures=' || (event_id % 4)
  || ' repo=' || props as alert from events where event_type in ('error', 'view')""")
def m2(spark, sf):
    kind = F.col("event_type")
    jobs = table(spark, sf, "events").select(
        F.col("event_id").alias("experiment_name"), F.when(kind == "error", "failed").when(kind == "view", "stale").otherwise("running").alias("status"),
        (F.col("event_id") % 4).alias("failure_count"), F.col("props").alias("repo_id"))
    return ops.alerts(jobs)


@query("m3_reconcile_stale", f"""
select event_id, case when event_type <> 'view' then 'idle' when event_id % 6 = 0 then 'orphaned'
  when epoch_us(timestamp '{NOW}') - epoch_us(ts) > 1000000000000 then 'stale' else 'running' end as status,
  case when event_type = 'view' and event_id % 6 = 0 and event_id % 4 <> 0 then 'Missing heartbeat for running job.' when event_id % 4 = 0 then 'boom' end as last_error from events""")
def m3(spark, sf):
    jobs = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") == "view", "running").otherwise("idle").alias("status"),
        F.when(F.col("event_id") % 6 != 0, F.col("ts")).alias("heartbeat_at"), F.when(F.col("event_id") % 4 == 0, "boom").alias("last_error"))
    return ops.reconcile_stale(jobs, F.lit(NOW), 1_000_000).select("event_id", "status", "last_error")


_LOG_SQL = """log as (select user_id as shard, count(*) as rows, count(distinct event_type) as datasets, count(*) filter (where event_type = 'error') as gate_fails,
  case when user_id % 4 = 0 then null else 1::bigint end as errors, round(case when user_id % 3 = 0 then 0 else avg(value) / 30 end, 6) as mean_utility_auc from events group by user_id)"""


def shard_log(spark, sf):
    events = table(spark, sf, "events")
    grouped = events.groupBy(F.col("user_id").alias("shard")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("event_type").alias("datasets"),
        F.count_if(F.col("event_type") == "error").alias("gate_fails"), F.avg("value").alias("m"))
    return grouped.select("shard", "rows", "datasets", "gate_fails", F.when(F.col("shard") % 4 != 0, F.lit(1).cast("bigint")).alias("errors"),
                          F.round(F.when(F.col("shard") % 3 == 0, 0.0).otherwise(F.col("m") / 30), 6).alias("mean_utility_auc"))


@query("m4_corpus_stats", f"""
with {_LOG_SQL} select count(*) as shards, sum(rows)::bigint as total_rows, sum(datasets)::bigint as total_datasets, coalesce(sum(errors), 0)::bigint as total_errors,
  round(coalesce(avg(mean_utility_auc) filter (where mean_utility_auc > 0), 0), 6) as mean_utility_auc,
  round(sum(gate_fails) / greatest(sum(datasets) + sum(gate_fails), 1), 6) as gate_fail_rate from log""")
def m4(spark, sf):
    return ops.corpus_totals(shard_log(spark, sf)).withColumns({
        "mean_utility_auc": F.round("mean_utility_auc", 6), "gate_fail_rate": F.round("gate_fail_rate", 6)})


@query("m4_merge_counters", """
select 'kinds' as counter, event_type as name, count(*) as n from events group by event_type
union all select 'thirds', (event_id % 3)::varchar, sum(user_id)::bigint from events group by event_id % 3""")
def m4_counters(spark, sf):
    events = table(spark, sf, "events")
    kinds = events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(
        F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("kinds"))
    thirds = events.groupBy("user_id", (F.col("event_id") % 3).cast("string").alias("t")).agg(F.sum("user_id").alias("n")).groupBy("user_id").agg(
        F.map_from_entries(F.collect_list(F.struct("t", "n"))).alias("thirds"))
    return ops.merge_counters(kinds.join(thirds, "user_id"), ["kinds", "thirds"])


@query("m5_best_so_far", """
with b as (select event_id, value, min(value) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as prev_best from events)
select event_id, prev_best, prev_best is null or value < prev_best as improved from b""")
def m5(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    return ops.best_so_far(events, ["user_id"], ["ts", "event_id"], "value").select("event_id", "prev_best", "improved")


@query("m6_last_event", """
select user_id, arg_max(value, event_id) as accuracy, arg_max(props, event_id) as props from events where event_type = 'purchase' group by user_id""")
def m6(spark, sf):
    events = table(spark, sf, "events").withColumn("accuracy", F.col("value"))
    return ops.last_event(events, ["user_id"], ["event_id"], F.col("event_type") == "purchase", ["accuracy", "props"])


@query("m7_ledger_tail", """
select user_id, event_id, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn <= 5""")
def m7(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", "value", "ts")
    return ops.ledger_tail(events, ["user_id"], ["ts", "event_id"], 5).drop("ts")


@query("m7_ledger_tail_long", """
select g, event_id from (select event_id, event_id % 3 as g, row_number() over (partition by event_id % 3 order by ts desc, event_id desc) as rn from events) where rn <= 1200""")
def m7_long(spark, sf):
    """More rows per group than a task keeps by itself."""
    events = table(spark, sf, "events").select((F.col("event_id") % 3).alias("g"), "event_id", "ts")
    with low_limits(spark, 100):
        return ops.ledger_tail(events, ["g"], ["ts", "event_id"], 1200).drop("ts")


@query("m7_latest_checkpoint", """
with s as (select user_id, event_id, case when event_type <> 'error' then 'ckpt_' || (event_id % 500) end as checkpoint_path from events),
f as (select distinct if(doc_id % 3 = 0, 'ckpt_', 'old_') || doc_id as checkpoint_path from documents)
select user_id, arg_max(checkpoint_path, event_id) as checkpoint_path from s where checkpoint_path in (select checkpoint_path from f) group by user_id""")
def m7_checkpoint(spark, sf):
    path = F.concat(F.lit("ckpt_"), (F.col("event_id") % 500).cast("string"))
    sessions = table(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_type") != "error", path).alias("checkpoint_path"))
    files = table(spark, sf, "documents").select(
        F.concat(F.when(F.col("doc_id") % 3 == 0, "ckpt_").otherwise("old_"), F.col("doc_id").cast("string")).alias("checkpoint_path"))
    return ops.latest_checkpoint(sessions, files, ["user_id"], ["event_id"])


_PRED = """pred as (select lang, quality as y, (n_chars // 400) - 3 as score from labels join documents using (doc_id)
  union all select 'all', quality, (n_chars // 400) - 3 from labels join documents using (doc_id))"""


@query("m8_classification_metrics", f"""
with {_PRED}, r as (select *, rank() over (partition by lang order by score) + (count(*) over (partition by lang, score) - 1) / 2 as ar from pred),
a as (select lang, sum(y) as p, count(*) - sum(y) as q, sum(ar) filter (where y = 1) as ranks, avg(((score > 0)::int = y)::int) as accuracy from r group by lang)
select lang, round(accuracy, 6) as accuracy, round(case when p > 0 and q > 0 then (ranks - p * (p + 1) / 2) / (p * q) end, 6) as roc_auc from a""")
def m8(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    pred = table(spark, sf, "labels").join(docs, "doc_id").select(
        "lang", F.col("quality").alias("y"), (F.floor(F.col("n_chars") / 400) - 3).alias("score"))
    by_lang = ops.classification_metrics(pred, "y", "score", ["lang"])
    whole = ops.classification_metrics(pred, "y", "score").withColumn("lang", F.lit("all"))
    both = by_lang.unionByName(whole)
    return both.select("lang", F.round("accuracy", 6).alias("accuracy"), F.round("roc_auc", 6).alias("roc_auc"))


@query("m8_multiclass_accuracy", """
select round(avg((list_position(embedding, list_max(embedding)) - 1 = label)::int), 6) as accuracy from embeddings""")
def m8_multi(spark, sf):
    return ops.multiclass_accuracy(table(spark, sf, "embeddings"), "label", "embedding").select(F.round("accuracy", 6).alias("accuracy"))


@query("m9_rmse", "select event_type, round(sqrt(avg(pow(value - user_id / 10, 2))), 6) as rmse from events group by event_type")
def m9(spark, sf):
    events = table(spark, sf, "events").withColumn("guess", F.col("user_id") / 10)
    return events.groupBy("event_type").agg(F.round(ops.rmse("value", "guess"), 6).alias("rmse"))


@query("m10_log_loss_with_logits", """
select user_id, round(avg(greatest(x, 0) - x * y + ln(1 + exp(-abs(x)))), 6) as log_loss
from (select user_id, value - 10 as x, (event_type in ('error', 'click'))::int as y from events) group by user_id""")
def m10(spark, sf):
    events = table(spark, sf, "events").select(
        "user_id", (F.col("value") - 10).alias("x"), F.col("event_type").isin("error", "click").cast("int").alias("y"))
    return events.groupBy("user_id").agg(F.round(ops.log_loss_with_logits("y", "x"), 6).alias("log_loss"))


@query("m11_ensemble_average", """
select user_id, round(avg(value - 5), 6) as logit, count(*) as members from events group by user_id""")
def m11(spark, sf):
    events = table(spark, sf, "events").select("user_id", (F.col("value") - 5).alias("logit"))
    return ops.ensemble_average(events, ["user_id"], "logit").withColumn("logit", F.round("logit", 6))


@query("m12_vector_mean_by_key", """
select label, slot - 1 as slot, round(avg(embedding[slot]::double), 6) as mean from embeddings, range(1, 65) t(slot) group by label, slot""")
def m12(spark, sf):
    means = ops.vector_mean_by_key(table(spark, sf, "embeddings").select("label", "embedding"), ["label"], "embedding")
    return means.select("label", F.posexplode("embedding").alias("slot", "mean")).select(
        "label", F.col("slot").cast("bigint").alias("slot"), F.round("mean", 6).alias("mean"))


@query("m13_throughput", """
select event_id, round(k / greatest(value, 1), 6) as rate, (sum(k) over w)::bigint as total_rows, round(sum(k) over w / greatest(sum(value) over w, 1), 6) as total_rate
from (select *, 100 + event_id % 900 as k from events) window w as (partition by user_id order by event_id)""")
def m13(spark, sf):
    log = table(spark, sf, "events").select("event_id", "user_id", "value", (100 + F.col("event_id") % 900).alias("rows"))
    out = ops.throughput(log, ["user_id"], ["event_id"], "rows", "value")
    return out.select("event_id", F.round("rate", 6).alias("rate"), "total_rows", F.round("total_rate", 6).alias("total_rate"))


_LINE = """substr(text, 1, 20) || ' step= ' || (turn * 1000 + conv_id) || ',000 loss=0.' || length(text) || ' rows=' || conv_id || case when conv_id % 3 = 0 then '' else ' rate=12,345' end || ' eta=' || turn || '.5h ' || text"""


@query("m14_log_line_extract", f"""
with l as (select conv_id, arg_max({_LINE}, turn) as line from conversations group by conv_id),
f as (select conv_id, regexp_extract(line, 'step=\\s*([\\d,]+)', 1) as step, regexp_extract(line, 'loss=([\\d.]+)', 1) as loss, regexp_extract(line, 'rows=([\\d,]+)', 1) as rows,
  regexp_extract(line, 'rate=([\\d,]+)', 1) as rate, regexp_extract(line, 'eta=([\\d.]+h)', 1) as eta from l)
select conv_id, coalesce(nullif(step, ''), '?') as step, coalesce(nullif(loss, ''), '?') as loss, coalesce(nullif(rows, ''), '?') as rows,
  coalesce(nullif(rate, ''), '?') as rate, coalesce(nullif(eta, ''), '?') as eta from f""")
def m14(spark, sf):
    line = F.concat(F.substring("text", 1, 20), F.lit(" step= "), (F.col("turn") * 1000 + F.col("conv_id")).cast("string"), F.lit(",000 loss=0."),
                    F.length("text").cast("string"), F.lit(" rows="), F.col("conv_id").cast("string"),
                    F.when(F.col("conv_id") % 3 == 0, "").otherwise(" rate=12,345"), F.lit(" eta="), F.col("turn").cast("string"), F.lit(".5h "), "text")
    lines = table(spark, sf, "conversations").select("conv_id", "turn", line.alias("line"))
    return ops.log_line_extract(lines, ["conv_id"], "line", ["turn"])


@query("m15_batch_rollup", """
select coalesce(sum(try_cast(t as bigint)), 0)::bigint as total_rows, count_if(st = 'real')::bigint as n_real, count_if(st = 'synthetic')::bigint as n_synthetic
from (select case when event_id % 9 = 0 then 'n/a' else (event_id % 1000)::varchar end as t, case event_id % 3 when 0 then 'real' when 1 then 'synthetic' else 'other' end as st
  from events where event_type <> 'error')""")
def m15(spark, sf):
    return ops.batch_totals(batch_log(spark, sf))


def batch_log(spark, sf):
    third = F.col("event_id") % 3
    return table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("batch_id"), F.when(F.col("event_type") != "error", "success").otherwise("failed").alias("status"),
        F.when(F.col("event_id") % 9 == 0, "n/a").otherwise((F.col("event_id") % 1000).cast("string")).alias("total_rows"),
        F.when(third == 0, "real").when(third == 1, "synthetic").otherwise("other").alias("source_type"))


@query("m15_first_per_batch", """
select user_id as batch_id, min(event_id) as event_id, count(*) > 0 as found from events where event_type <> 'error' group by user_id""")
def m15_first(spark, sf):
    return ops.first_per_batch(batch_log(spark, sf), "batch_id", ["event_id"]).select("batch_id", "event_id", F.lit(True).alias("found"))


@query("m16_epoch_loss", """
with b as (select event_type, (row_number() over (partition by event_type order by event_id) - 1) // 32 as batch_id, value from events),
m as (select event_type, batch_id, avg(value) as loss from b group by all)
select event_type, round(avg(loss), 6) as epoch_loss, count(*) as n_batches from m group by event_type""")
def m16(spark, sf):
    from corpusloom.operators.scale import positions

    events = positions(table(spark, sf, "events").select("event_type", "event_id", "value"), ["event_type"], ["event_id"], "pos")
    batches = events.groupBy("event_type", F.floor((F.col("pos") - 1) / 32).alias("batch_id")).agg(F.avg("value").alias("loss"))
    return ops.epoch_loss(batches, ["event_type"], "loss").withColumn("epoch_loss", F.round("epoch_loss", 6))
