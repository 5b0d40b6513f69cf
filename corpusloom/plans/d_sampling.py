"""Queries for section D: splits, samples, episodes, orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import sampling as ops
from .registry import low_limits, query, table
from .sqltext import unit


def quota_sql(source: str, group: str, size: str) -> str:
    """Rows (g, quota): largest remainder of `size` over the groups of `source`."""
    return f"""(select g, base + (row_number() over (order by rest desc, g) <= size - sum(base) over ())::bigint as quota
  from (select g, size, (size * n) // total as base, (size * n) % total as rest
    from (select {group} as g, count(*) as n, sum(count(*)) over () as total, {size} as size from {source} group by {group})))"""


def split_sql(source: str, group: str, key: str, held: str, test_share: str, seed: int = 7) -> str:
    """CTEs ending in `split_rows`: `source` with its split label."""
    return f"""n_held as (select ceil({held}::double * count(*))::bigint as h from {source}),
q1 as (select * from {quota_sql(source, group, '(select h from n_held)')}),
first_cut as (select s.*, md5('{seed}:' || {key}) as d,
  row_number() over (partition by {group} order by md5('{seed}:' || {key})) <= quota as is_held
  from {source} s join q1 on q1.g = s.{group}),
held_rows as (select * from first_cut where is_held),
n_test as (select ceil({test_share}::double * (select h from n_held))::bigint as h),
q2 as (select * from {quota_sql('held_rows', group, '(select h from n_test)')}),
split_rows as (select * exclude (d, is_held, quota, g), 'train' as split from
    (select f.*, 0 as quota, '' as g from first_cut f) where not is_held
  union all select * exclude (d, is_held, quota, g, rn), case when rn <= quota then 'test' else 'val' end
    from (select h.*, q2.quota, q2.g, row_number() over (partition by {group} order by d) as rn
          from held_rows h join q2 on q2.g = h.{group}))"""


@query("d1_cap_rows_stratified", f"""
with q as (select * from {quota_sql('orders', 'o_orderpriority', '1234')})
select o_orderkey, o_orderpriority from (select o_orderkey, o_orderpriority,
  row_number() over (partition by o_orderpriority order by md5('7:' || o_orderkey)) as rn from orders) r
join q on q.g = r.o_orderpriority where rn <= quota""")
def d1(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return ops.cap_rows_stratified(orders, 1234, "o_orderpriority", "multiclass", ["o_orderkey"])


@query("d2_split_stratified", f"""
with {split_sql('events', 'event_type', 'event_id', '0.2', '0.25')}
select event_id, event_type, split from split_rows""")
def d2(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type")
    return ops.split_table(events, "event_type", "multiclass", ["event_id"], 7, 0.15, 0.05)


@query("d2_split_stratified_labels", f"""
with src as (select doc_id, toxic::varchar as toxic from labels),
{split_sql('src', 'toxic', 'doc_id', '0.3', '0.5', seed=11)}
select doc_id, toxic, split from split_rows""")
def d2_labels(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", F.col("toxic").cast("string").alias("toxic"))
    return ops.split_table(labels, "toxic", "binary", ["doc_id"], 11, 0.15, 0.15)


_PLAIN = """select {cols}, case when rn > h then 'train' when rn <= t then 'test' else 'val' end as split
from (select *, row_number() over (order by md5('7:' || {key})) as rn from {source}),
 (select ceil(0.2::double * count(*))::bigint as h, ceil(0.5::double * ceil(0.2::double * count(*)))::bigint as t from {source})"""


@query("d3_stratify_fallback", f"""
with src as (select event_id, case when event_id = 0 then 'solo' else event_type end as label, md5('7:' || event_id) as d from events),
n_held as (select ceil(0.2::double * count(*))::bigint as h from src),
first_cut as (select *, row_number() over (order by d) <= (select h from n_held) as is_held from src),
held_rows as (select * from first_cut where is_held),
n_test as (select ceil(0.5::double * (select h from n_held))::bigint as h),
q2 as (select * from {quota_sql('held_rows', 'label', '(select h from n_test)')}),
lone as (select min(n) < 2 as yes from (select count(*) as n from held_rows group by label)),
ranked as (select event_id, label, row_number() over (order by d) as rn, row_number() over (partition by label order by d) as crn
  from held_rows)
select event_id, 'train' as split from first_cut where not is_held
union all select event_id, if(if((select yes from lone), rn <= (select h from n_test), crn <= quota), 'test', 'val')
from ranked join q2 on q2.g = label""")
def d3(spark, sf):
    lonely = F.when(F.col("event_id") == 0, "solo").otherwise(F.col("event_type"))
    events = table(spark, sf, "events").select("event_id", lonely.alias("label"))
    return ops.split_table(events, "label", "multiclass", ["event_id"]).select("event_id", "split")


@query("d4_split_uniform", _PLAIN.format(cols="o_orderkey, o_totalprice", key="o_orderkey", source="orders"))
def d4(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return ops.split_table(orders, "o_totalprice", "regression", ["o_orderkey"])


@query("d5_fixed_size_sample", """
select event_id, value from events order by md5('42:' || event_id) limit 5000""")
def d5(spark, sf):
    return ops.fixed_size_sample(table(spark, sf, "events").select("event_id", "value"), 5000, ["event_id"])


@query("d6_sample_episode", """
select user_id, event_id, case when rn <= 8 then 'support' else 'query' end as role
from (select *, row_number() over (partition by user_id order by md5('3:' || event_id)) as rn from events) where rn <= 12""")
def d6(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id")
    return ops.sample_episode(events, ["user_id"], ["event_id"], 8, 4, seed=3)


@query("d6_sample_episode_large", """
select l_returnflag, l_orderkey, l_linenumber, case when rn <= 800 then 'support' else 'query' end as role
from (select *, row_number() over (partition by l_returnflag order by md5('4:' || l_orderkey || ':' || l_linenumber)) as rn from lineitem) where rn <= 1200""")
def d6_large(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber")
    return ops.sample_episode(lines, ["l_returnflag"], ["l_orderkey", "l_linenumber"], 800, 400, seed=4)


@query("d7_sample_episode_with_replacement", """
with n as (select user_id, count(*) as n from events group by user_id),
draws as (select user_id, i as draw, ('0x' || substr(md5('3:draw:' || user_id || ':' || i), 1, 8))::bigint % n + 1 as idx
  from n, range(1, 9) t(i)),
indexed as (select user_id, event_id, row_number() over (partition by user_id order by md5('3:' || event_id)) as idx from events)
select user_id, draw, event_id, case when draw <= 5 then 'support' else 'query' end as role
from draws join indexed using (user_id, idx)""")
def d7(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id")
    out = ops.sample_episode_with_replacement(events, ["user_id"], ["event_id"], 5, 3, seed=3)
    return out.withColumn("draw", F.col("draw").cast("bigint"))


@query("d7_sample_episode_with_replacement_hot", """
with n as (select user_id, count(*) as n from events group by user_id),
draws as (select user_id, i as draw, ('0x' || substr(md5('3:draw:' || user_id || ':' || i), 1, 8))::bigint % n + 1 as idx
  from n, range(1, 9) t(i)),
indexed as (select user_id, event_id, row_number() over (partition by user_id order by md5('3:' || event_id)) as idx from events)
select user_id, draw, event_id, case when draw <= 5 then 'support' else 'query' end as role
from draws join indexed using (user_id, idx)""")
def d7_hot(spark, sf):
    """Every dataset takes the path for large ones."""
    events = table(spark, sf, "events").select("user_id", "event_id")
    with low_limits(spark, 10):
        out = ops.sample_episode_with_replacement(events, ["user_id"], ["event_id"], 5, 3, seed=3)
    return out.withColumn("draw", F.col("draw").cast("bigint"))


@query("d8_weighted_order", f"""
with jobs as (select user_id, round(sum(value), 2) as weight from events group by user_id)
select user_id, row_number() over (order by -ln(greatest({unit("'5:' || user_id")}, 1e-18)) / greatest(weight, 1e-6), user_id) as position
from jobs""")
def d8(spark, sf):
    jobs = table(spark, sf, "events").groupBy("user_id").agg(F.round(F.sum("value"), 2).alias("weight"))
    return ops.weighted_order(jobs, "weight", ["user_id"], seed=5).select("user_id", "position")


@query("d9_shuffle_pool", """
with recursive sizes as (select user_id, count(*) as n, row_number() over (order by md5('2:' || user_id)) as k
  from events group by user_id),
fill as (select k, user_id, 0::bigint as pool, n as held from sizes where k = 1
  union all select s.k, s.user_id, case when f.held >= 900 then f.pool + 1 else f.pool end,
    case when f.held >= 900 then s.n else f.held + s.n end from fill f join sizes s on s.k = f.k + 1)
select event_id, pool, row_number() over (partition by pool order by md5('2:row:' || event_id)) as pool_position
from events join fill using (user_id)""")
def d9(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id")
    return ops.shuffle_pool(events, "user_id", ["event_id"], 900, seed=2).select("event_id", "pool", "pool_position")


@query("d10_interleave_datasets", """
with pool as (select 's' as kind, s_suppkey as id, s_acctbal as amount, null::varchar as segment from supplier
  union all select 'c', c_custkey, c_acctbal, c_mktsegment from customer where (select count(*) from supplier) < 128)
select kind, id, amount, segment from pool order by md5('4:' || kind || ':' || id) limit 64""")
def d10(spark, sf):
    suppliers = table(spark, sf, "supplier").select(
        F.lit("s").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("amount"))
    customers = table(spark, sf, "customer").select(
        F.lit("c").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("amount"),
        F.col("c_mktsegment").alias("segment"))
    out = ops.interleave_datasets([suppliers, customers], ["kind", "id"], 64, seed=4)
    if "segment" not in out.columns:
        out = out.withColumn("segment", F.lit(None).cast("string"))
    return out.select("kind", "id", "amount", "segment")
