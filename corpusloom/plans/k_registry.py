"""Queries for section K: registry and discovery tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.clock import epoch_micros
from corpusloom.operators import registry as ops
from .registry import query, table

STATUS_SQL = """case event_type when 'view' then 'ok' when 'click' then 'ok' when 'error' then 'download_fail'
  when 'signup' then 'schema_fail' else 'skipped' end"""
REG_SQL = f"""reg as (select event_id, user_id as dataset_id, ts, {STATUS_SQL} as status, case user_id % 3 when 0 then 'pmlb' when 1 then 'openml' else 'hub' end as source,
  case event_id % 4 when 0 then 'timeout' when 1 then 'timeout retry=' || (event_id % 5) when 2 then 'a retry=1 b retry=' || (event_id % 3) else '' end as notes
  from events)"""


def records(spark, sf):
    events = table(spark, sf, "events")
    kind = F.col("event_type")
    status = (F.when(kind.isin("view", "click"), "ok").when(kind == "error", "download_fail")
              .when(kind == "signup", "schema_fail").otherwise("skipped"))
    source = F.when(F.col("user_id") % 3 == 0, "pmlb").when(F.col("user_id") % 3 == 1, "openml").otherwise("hub")
    four = F.col("event_id") % 4
    notes = (F.when(four == 0, "timeout").when(four == 1, F.concat(F.lit("timeout retry="), (F.col("event_id") % 5).cast("string")))
             .when(four == 2, F.concat(F.lit("a retry=1 b retry="), (F.col("event_id") % 3).cast("string"))).otherwise(""))
    return events.select("event_id", F.col("user_id").alias("dataset_id"), "ts", status.alias("status"),
                         source.alias("source"), notes.alias("notes"))


@query("k1_registry_upsert", f"""
with {REG_SQL} select dataset_id, arg_max(status, (ts, event_id)) as status, max(event_id) filter (where ts = m) as event_id,
  epoch_us(min(ts)) as created_us from (select *, max(ts) over (partition by dataset_id) as m from reg) group by dataset_id""")
def k1(spark, sf):
    out = ops.registry_upsert(records(spark, sf), ["dataset_id"], ["ts", "event_id"], created="ts")
    return out.select("dataset_id", "status", "event_id", epoch_micros("created_at", out.schema["created_at"].dataType).alias("created_us"))


@query("k2_new_candidates", "select c_custkey, c_name from customer where c_custkey not in (select if(o_totalprice > 350000, o_custkey, -o_custkey) from orders)")
def k2(spark, sf):
    # ids of other orders are known too, but belong to nobody
    known = table(spark, sf, "orders").select(F.expr("if(o_totalprice > 350000, o_custkey, -o_custkey)").alias("c_custkey"))
    return ops.new_candidates(table(spark, sf, "customer").select("c_custkey", "c_name"), known, "c_custkey")


@query("k3_ingested_ids", """
select distinct trim(x) as source_id from (select unnest(string_split(user_id || '| ' || event_type || ' ||' || (event_id % 100), '|')) as x
  from events where event_type <> 'error') where trim(x) <> ''""")
def k3(spark, sf):
    events = table(spark, sf, "events")
    cell = F.concat(F.col("user_id").cast("string"), F.lit("| "), "event_type", F.lit(" ||"), (F.col("event_id") % 100).cast("string"))
    return ops.ingested_ids(events.select(cell.alias("source_id"), F.when(F.col("event_type") != "error", "success").alias("status")))


@query("k4_merge_searches", """
with u as (select 0 as list_no, event_id as position, user_id * 2 as id, event_type as title from events
  union all select 1, event_id, user_id * 3, event_type from events
  union all select 2, event_id, event_id % 1000, event_type from events)
select id, list_no, position, title from (select *, row_number() over (partition by id order by list_no, position) as rn from u) where rn = 1""")
def k4(spark, sf):
    events = table(spark, sf, "events")
    lists = [events.select(F.col("event_id").alias("position"), key.alias("id"), F.col("event_type").alias("title"))
             for key in (F.col("user_id") * 2, F.col("user_id") * 3, F.col("event_id") % 1000)]
    return ops.merge_searches(lists, ["id"], "position")


_RETRY = "case when contains(notes, 'retry=') then coalesce(try_cast(trim(list_last(string_split(notes, 'retry='))) as int), 0) else 0 end"


@query("k5_retryable", f"""
with {REG_SQL} select event_id, dataset_id, notes from reg where status = 'download_fail' and source = 'openml' and {_RETRY} < 3""")
def k5(spark, sf):
    return ops.retryable(records(spark, sf), "openml").select("event_id", "dataset_id", "notes")


@query("k6_status_transition", f"""
with {REG_SQL}, upd as (select if(event_id % 2 = 0, event_id, -1 - event_id) as event_id, case when event_id % 3 = 0 then 'ok' else 'schema_fail' end as new_status,
  repeat('note ' || event_id || ';', 20) as new_notes from events)
select reg.event_id, coalesce(new_status, status) as status, case when new_status is null then notes when new_status = 'ok' then new_notes
  else left(new_notes, 150) || ' retry=' || ({_RETRY} + 1) end as notes from reg left join upd using (event_id)""")
def k6(spark, sf):
    # half of the updates are for records that are not there
    updates = table(spark, sf, "events").select(
        F.expr("if(event_id % 2 = 0, event_id, -1 - event_id)").alias("event_id"), F.when(F.col("event_id") % 3 == 0, "ok").otherwise("schema_fail").alias("new_status"),
        F.repeat(F.concat(F.lit("note "), F.col("event_id").cast("string"), F.lit(";")), 20).alias("new_notes"))
    return ops.status_transition(records(spark, sf), updates, "event_id").select("event_id", "status", "notes")


@query("k7_status_rollup", f"""
with {REG_SQL} select source, count_if(status = 'ok')::bigint as ok, count_if(status <> 'ok')::bigint as fail, count(*) as total from reg group by source
union all select 'all', count_if(status = 'ok')::bigint, count_if(status <> 'ok')::bigint, count(*) from reg""")
def k7(spark, sf):
    return ops.status_rollup(records(spark, sf))


@query("k8_quality_map", """
with q as (select event_id, regexp_extract(props, '([0-9]+)', 1)::bigint as k, value from events)
select event_id, k * 10 as n_rows, floor(value)::bigint as n_features, 0::bigint as n_classes from q
where k * 10 between 30 and 800 and floor(value) between 2 and 2000""")
def k8(spark, sf):
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")

    def pair(name, value):
        return F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    items = table(spark, sf, "events").select("event_id", F.array(
        pair("NumberOfInstances", F.lit("7")), pair("NumberOfFeatures", F.col("value")),
        pair("NumberOfClasses", F.lit("unknown")), pair("NumberOfInstances", k * 10)).alias("quality"))
    wide = ops.quality_map(items, "quality", {"NumberOfInstances": "n_rows", "NumberOfFeatures": "n_features", "NumberOfClasses": "n_classes"})
    return ops.size_filter(wide, "n_rows", "n_features", 800).drop("quality")


@query("k9_materialize_summary", """
with r as (select o_custkey as c_custkey, count(*) as rows, case when count(*) > 12 then 'too many rows' end as error from orders group by 1)
select c_custkey, case when error is null and rows is not null then 'ok' else 'error' end as status,
  case when error is null then rows end as rows, case when rows is null then 'no result' else error end as error
from customer left join r using (c_custkey)""")
def k9(spark, sf):
    results = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("rows"))
    results = results.withColumn("error", F.when(F.col("rows") > 12, "too many rows"))
    return ops.materialize_summary(table(spark, sf, "customer").select("c_custkey"), results, "c_custkey")


@query("k10_rank_candidates", """
with c as (select o_custkey as id, o_orderkey as position, case when o_orderkey % 5 = 0 then null else o_orderkey % 1000 end as downloads from orders),
f as (select *, row_number() over (partition by id order by position) as rn from c where id not in (select if(c_nationkey < 5, c_custkey, -c_custkey) from customer)
  and id not in (select s_suppkey from supplier))
select id, position, coalesce(downloads, 0) as downloads from f where rn = 1""")
def k10(spark, sf):
    candidates = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("position"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") % 1000).alias("downloads"))
    processed = table(spark, sf, "customer").select(F.expr("if(c_nationkey < 5, c_custkey, -c_custkey)").alias("id"))
    skip = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))
    return ops.rank_candidates(candidates, processed, skip, "id", ["position"])
