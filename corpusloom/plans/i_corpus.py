"""Queries for section I: the fixed-width corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import corpus as ops
from corpusloom.session import new_run_dir
from .registry import query, table

K = "regexp_extract(props, '([0-9]+)', 1)::int"
CORPUS_SQL = f"""corpus as (select user_id, event_id, value::float as feat_0,
  case when event_id % 7 = 0 then null else {K}::float end as feat_1, hour(ts)::float as feat_2, null::float as feat_3,
  (case user_id % 3 when 0 then value when 1 then (event_type = 'error')::int
    else list_position(['click','error','purchase','signup','view'], event_type) - 1 end)::float as target,
  case user_id % 3 when 0 then 'regression' when 1 then 'binary' else 'multiclass' end as task_type from events)"""


def corpus(spark, sf):
    """Events as a corpus with one dataset per user, four slots (the last unused) and metadata."""
    events = table(spark, sf, "events")
    third = F.col("user_id") % 3
    names = F.array(*[F.lit(c) for c in ("click", "error", "purchase", "signup", "view")])
    target = (F.when(third == 0, F.col("value")).when(third == 1, (F.col("event_type") == "error").cast("double"))
              .otherwise(F.array_position(names, F.col("event_type")) - 1))
    task = F.when(third == 0, "regression").when(third == 1, "binary").otherwise("multiclass")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("float")
    rows = events.select(
        "user_id", "event_id", F.col("value").cast("float").alias("feat_0"),
        F.when(F.col("event_id") % 7 != 0, k).alias("feat_1"), F.hour("ts").cast("float").alias("feat_2"),
        F.lit(None).cast("float").alias("feat_3"), target.cast("float").alias("target"), task.alias("task_type"))
    meta = ops.source_meta({"task_type": F.col("task_type"), "n_features": F.lit(3), "dataset_id": F.col("user_id")})
    return rows.withColumn("_source_meta", F.when(F.col("user_id") % 10 == 9, "not json").otherwise(meta))


@query("i1_encode_fixed_width_prepared", """
with src as (select *, 'N' || c_nationkey as nation, coalesce(nullif(c_mktsegment, 'BUILDING'), 'nan') as seg from customer)
select c_custkey, if(wordy, c_nationkey, dense_rank() over (order by c_name) - 1)::float as feat_0,
  if(wordy, c_acctbal, c_nationkey)::float as feat_1, if(wordy, dense_rank() over (order by nation) - 1, c_acctbal)::float as feat_2,
  if(wordy, null, dense_rank() over (order by nation) - 1)::float as feat_3, null::float as feat_63, (dense_rank() over (order by seg) - 1)::float as target, 'multiclass' as task_type,
  count(*) over ()::bigint as n_samples from src, (select count(distinct c_name) > 200 as wordy from customer)""")
def i1(spark, sf):
    customer = table(spark, sf, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal",
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("nation"),
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"))
    out, _ = ops.encode_fixed_width(customer, "segment", "customer", keep=["c_custkey"])
    return out.select("c_custkey", "feat_0", "feat_1", "feat_2", "feat_3", "feat_63", "target",
                      F.get_json_object("_source_meta", "$.task_type").alias("task_type"),
                      F.get_json_object("_source_meta", "$.n_samples").cast("bigint").alias("n_samples"))


@query("i2_encode_fixed_width_raw", """
select o_orderkey, o_custkey::float as feat_0, (dense_rank() over (order by o_orderstatus) - 1)::float as feat_1,
  epoch(o_orderdate)::float as feat_2, (o_custkey % 100)::float as feat_3, (o_custkey % 2)::float as feat_4, null::float as feat_5,
  o_totalprice::float as target, 'numeric,categorical,datetime,numeric_coerced,boolean' as kinds from orders""")
def i2(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderkey").alias("row_index"), "o_custkey", "o_orderstatus", F.lit("x").alias("constant"),
        "o_orderdate", (F.col("o_custkey") % 100).cast("string").alias("text_number"),
        (F.col("o_custkey") % 2 == 1).alias("odd"), "o_totalprice")
    out, meta = ops.encode_fixed_width(orders, "o_totalprice", "orders", variant="raw", keep=["o_orderkey"])
    return out.select("o_orderkey", *[f"feat_{i}" for i in range(6)], "target", F.lit(",".join(meta["feature_types"])).alias("kinds"))


@query("i3_label_codes", """
select 'priority' as "column", v as value, (row_number() over (order by v) - 1) as code
  from (select distinct coalesce(nullif(o_orderpriority, '5-LOW'), 'nan') as v from orders)
union all select 'customer', v, (row_number() over (order by v) - 1) from (select distinct o_custkey::varchar as v from orders)""")
def i3(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"), F.col("o_custkey").cast("string").alias("customer"))
    return ops.label_codes(orders, ["priority", "customer"])


@query("i4_source_meta", f"""
with {CORPUS_SQL} select event_id, if(user_id % 10 = 9, null, task_type) as task_type, if(user_id % 10 = 9, null, 3) as n_features,
  if(user_id % 10 = 9, null, user_id) as dataset_id,
  if(user_id % 10 = 9, 'not json', '{{"task_type":"' || task_type || '","n_features":3,"dataset_id":' || user_id || '}}') as meta from corpus""")
def i4(spark, sf):
    parsed = ops.parse_source_meta("_source_meta", "task_type string, n_features int, dataset_id bigint")
    return corpus(spark, sf).select("event_id", F.col("_source_meta").alias("meta"), parsed.alias("m")).select("event_id", "meta", "m.*")


@query("i5_missingness_rate", f"""
with {CORPUS_SQL} select user_id, round(avg((feat_0 is null)::int + (feat_1 is null)::int + (feat_2 is null)::int) / 3, 6) as missingness_rate
from corpus group by user_id""")
def i5(spark, sf):
    rate = ops.missingness(["feat_0", "feat_1", "feat_2"])
    return corpus(spark, sf).groupBy("user_id").agg(F.round(rate, 6).alias("missingness_rate"))


@query("i6_encode_indexed", """
select c_custkey::bigint as id, c_nationkey::float as feature_0, c_acctbal::float as feature_1, null::float as feature_2,
  (dense_rank() over (order by c_mktsegment) - 1)::float as target, 'customer' as _dataset_id, 2 as _n_features from customer
union all select p_partkey, (dense_rank() over (order by p_brand) - 1)::float, p_size::float,
  case when p_type = 'SMALL' then -1.0 else (dense_rank() over (order by nullif(p_type, 'SMALL') nulls last) - 1) end::float, p_retailprice::float, 'part', 3 from part""")
def i6(spark, sf):
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey", "c_acctbal", "c_mktsegment")
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_size",
                                           F.nullif("p_type", F.lit("SMALL")).alias("p_type"), "p_retailprice")
    return ops.encode_indexed([("customer", customer, "c_mktsegment"), ("part", part, "p_retailprice")], keep=["id"])


@query("i7_union_align", """
select c_custkey as key, c_name as name, c_nationkey as nation, c_acctbal as balance, c_mktsegment as segment, '' as _source_meta from customer
union all select s_suppkey, s_name, s_nationkey, s_acctbal, null, '' from supplier""")
def i7(spark, sf):
    customer = table(spark, sf, "customer").toDF("key", "name", "nation", "balance", "segment")
    supplier = table(spark, sf, "supplier").toDF("key", "name", "nation", "balance")
    return ops.union_align([customer, supplier])


@query("i8_cap_total_rows", """
with sizes as (select user_id, count(*) as n from events group by user_id),
cum as (select *, sum(n) over (order by user_id) as c, (select count(*) * 6 // 10 from events) as cap from sizes),
keep as (select user_id, case when c <= cap then n when c - n <= cap and cap - (c - n) > 10 then cap - (c - n) else 0 end as left_rows from cum),
r as (select event_id, user_id, row_number() over (partition by user_id order by event_id) as rn from events)
select event_id, user_id from r join keep using (user_id) where rn <= left_rows""")
def i8(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id")
    cap = events.count() * 6 // 10
    return ops.cap_total_rows(events, "user_id", "user_id", ["event_id"], cap, min_part=10)


PACK_SQL = """sizes as (select user_id, count(*) as n, row_number() over (order by user_id) as k from events group by user_id),
pack as (select k, user_id, n, 0::bigint as shard_id, n as held from sizes where k = 1
  union all select s.k, s.user_id, s.n, if(p.held >= 700, p.shard_id + 1, p.shard_id), if(p.held >= 700, s.n, p.held + s.n)
  from pack p join sizes s on s.k = p.k + 1)"""


@query("i9_pack_shards", f"with recursive {PACK_SQL} select user_id, n, shard_id from pack")
def i9(spark, sf):
    sizes = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return ops.pack_shards(sizes, ["user_id"], "n", 700)


@query("i10_stringify_objects", """
select o_orderkey, o_orderstatus, o_orderdate::varchar as o_orderdate, o_totalprice > 100000 as is_big from orders""")
def i10(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", (F.col("o_totalprice") > 100000).alias("is_big"))
    return ops.stringify_objects(orders)


def _z(c: str) -> str:
    return f"""coalesce(if(count({c}) over w > 1 and stddev_pop({c}::double) over w > 1e-8,
  ({c}::double - avg({c}::double) over w) / stddev_pop({c}::double) over w, {c}), 0)"""


@query("i11_decode_for_training", f"""
with {CORPUS_SQL}, c as (select *, event_id % 4 as shard, if(user_id % 10 = 9, 0, case task_type when 'binary' then 1 when 'multiclass' then 2 else 0 end) as task
  from corpus), t as (select *, if(task = 0, target::double, null) as goal from c)
select event_id, task, {", ".join(f"round(({_z(f'feat_{i}')})::float::double, 3) as x{i}, (feat_{i} is not null)::int::float as m{i}" for i in range(4))},
  round((if(task = 0, (target::double - avg(goal) over w) / stddev_pop(goal) over w, target))::float::double, 3) as y
from t window w as (partition by shard)""")
def i11(spark, sf):
    df = corpus(spark, sf).withColumn("shard", F.col("event_id") % 4)
    out = ops.decode_for_training(df, "shard", width=4, keep=["event_id"])
    return out.select("event_id", "task", *[F.round(F.col("x")[i].cast("double"), 3).alias(f"x{i}") for i in range(4)],
                      *[F.col("mask")[i].alias(f"m{i}") for i in range(4)], F.round(F.col("y").cast("double"), 3).alias("y"))


@query("i12_prefix_mask", """
select event_id, array_to_string(list_transform(range(0, 12), lambda i: (i < user_id % 20)::int::varchar), '') as mask from events""")
def i12(spark, sf):
    events = table(spark, sf, "events").select("event_id", (F.col("user_id") % 20).alias("_n_features"))
    mask = F.array_join(F.transform(ops.prefix_mask("_n_features", 12), lambda x: x.cast("string")), "")
    return events.select("event_id", mask.alias("mask"))


@query("i13_shard_manifest", f"""
with recursive {PACK_SQL}
select shard_id, sum(n)::bigint as n_rows, count(*) as n_datasets,
  '[' || string_agg('{{"user_id":' || user_id || ',"n":' || n || '}}', ',' order by user_id) || ']' as datasets from pack group by shard_id""")
def i13(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id")
    return ops.shard_manifest(ops.assign_shards(events, "user_id", 700), "shard_id", "user_id")


@query("i14_verify_batch", """
select user_id as source_id, count(*) as n, 'status_' || max(event_id) as name from events
where event_type = 'signup' and event_id % 2 = 0 group by user_id having count(*) > 1
  and regexp_extract('status_' || max(event_id), '^(.*)_[0-9]+$', 1) = 'status'""")
def i14(spark, sf):
    events = table(spark, sf, "events")
    log = events.select(F.col("user_id").alias("source_id"), F.when(F.col("event_type") == "signup", "success").alias("status"),
                        F.when(F.col("event_id") % 2 == 0, "real").otherwise("synthetic").alias("source_type"), "event_id")
    ops.verify_batch(log.withColumn("_source_meta", F.lit("")), events.count())
    repeated = ops.duplicate_ids(log)
    real = log.filter("status = 'success' and source_type = 'real'")
    names = real.groupBy("source_id").agg(F.concat(F.lit("status_"), F.max("event_id").cast("string")).alias("name"))
    return repeated.join(ops.overflow_names(names, "name", ["status", "income"]), "source_id")


@query("a5_write_shards", f"""
with recursive {PACK_SQL} select shard_id, count(*) as n, min(event_id) as first_id, round(sum(value), 4) as total
from events join pack using (user_id) group by shard_id""")
def a5(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "value")
    path = new_run_dir(spark, "shards")
    ops.write_shards(ops.assign_shards(events, "user_id", 700), path)
    back = ops.read_shards(spark, path, ["shard_id", "event_id", "value"])
    return back.groupBy(F.col("shard_id").cast("bigint").alias("shard_id")).agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.round(F.sum("value"), 4).alias("total"))


@query("a6_read_shards", "select l_quantity, l_discount, l_returnflag from lineitem where l_returnflag = 'A'")
def a6(spark, sf):
    return ops.read_shards(spark, f"{sf}/lineitem.parquet", ["l_quantity", "l_discount", "l_returnflag"],
                           F.col("l_returnflag") == "A")
