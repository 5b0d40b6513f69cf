"""Queries for section A: readers and writers."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators.prepare import prepare_table
from corpusloom.operators.shards import ShardTable
from corpusloom.session import new_run_dir
from corpusloom.sources import tables as ops
from .registry import query, table


@query("a1_read_table", " union all ".join(
    f"select '{kind}' as kind, o_orderkey, o_orderpriority, o_totalprice, nullif(o_orderstatus, 'F') as o_orderstatus from orders"
    for kind in ("csv", "tsv", "parquet", "jsonl")))
def a1(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice",
                                               F.nullif("o_orderstatus", F.lit("F")).alias("o_orderstatus"))
    root, out = new_run_dir(spark, "formats"), None
    for kind in ("csv", "tsv", "parquet", "jsonl"):
        ops.write_table(orders, f"{root}/orders.{kind}")
        schema = orders.schema if kind in ("tsv", "jsonl") else None
        back = ops.read_table(spark, f"{root}/orders.{kind}", schema=schema).select(
            F.lit(kind).alias("kind"), F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "o_orderpriority", "o_totalprice", "o_orderstatus")
        out = back if out is None else out.unionByName(back)
    return out


@query("a2_next_index", """
select c_nationkey, coalesce(max(try_cast(nullif(regexp_extract(n, '^Customer#([0-9]+)$', 1), '') as bigint)) + 1, 7) as next_index
from (select c_nationkey, case when c_nationkey = 3 then 'x' || c_name else c_name end as n from customer) group by c_nationkey""")
def a2(spark, sf):
    names = table(spark, sf, "customer").select(
        "c_nationkey", F.when(F.col("c_nationkey") == 3, F.concat(F.lit("x"), "c_name")).otherwise(F.col("c_name")).alias("name"))
    return ops.next_index(names, "name", r"^Customer#([0-9]+)$", default=7, groups=["c_nationkey"])


@query("a3_file_inventory", """
select event_type, 'event_id|user id|note, with comma' as columns, count(*) as row_count from events group by event_type""")
def a3(spark, sf):
    events = table(spark, sf, "events").select(
        "event_type", "event_id", F.col("user_id").alias("user id"),
        F.concat(F.col("props"), F.lit("\nsecond line")).alias("note, with comma"))
    root = new_run_dir(spark, "inventory")
    # any cell may hold a line break, so records are not lines
    events.hint("rebalance", "event_type").write.partitionBy("event_type").option("header", True).option("escape", '"').csv(root)
    found = ops.file_inventory(spark, root)
    kind = F.regexp_extract("path", "event_type=([a-z]+)", 1)
    return found.groupBy(kind.alias("event_type")).agg(F.array_join(F.first("columns"), "|").alias("columns"),
                                                       F.sum("row_count").alias("row_count"))


@query("a4_write_prepared", """
select o_orderkey, o_totalprice, o_orderstatus as target from orders""")
def a4(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    path = new_run_dir(spark, "prepared")
    prepare_table(orders, ["o_orderkey"], title="Orders", path=path)
    card = ops.read_artifact(spark, f"{path}/dataset_card.json")
    back = spark.read.parquet(f"{path}/rows").filter(F.col("split").isin(list(card["rows"])))
    return back.select("o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("target"))


@query("a8_catalog_source", """
select c_custkey as id, c_name as title, c_mktsegment as task_type, c_nationkey % 2 = 0 as recommended, c_custkey * 10 as est_rows from customer""")
def a8(spark, sf):
    """Customers as catalog documents of a hundred records, one JSON document per file."""
    records = table(spark, sf, "customer").select(
        F.floor(F.col("c_custkey") / 100).alias("doc"), F.struct(
            F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("task_type"),
            (F.col("c_nationkey") % 2 == 0).alias("recommended"), (F.col("c_custkey") * 10).alias("est_rows")).alias("r"))
    docs = records.groupBy("doc").agg(F.to_json(F.struct(F.lit(1).alias("version"), F.collect_list("r").alias("datasets"))).alias("value"))
    root = new_run_dir(spark, "catalog")
    docs.write.partitionBy("doc").text(root)
    return ops.catalog_source(spark, root, "id bigint, title string, task_type string, recommended boolean, est_rows bigint")


@query("a7_log_source_sink", """
select 'json' as kind, event_id::varchar as event_id, nullif(event_type, 'view') as event_type, null::varchar as extra from events
union all select 'tsv', event_id::varchar, case when event_type = 'view' then '' else event_type end, '' from events""")
def a7(spark, sf):
    events = table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("event_id"), F.nullif("event_type", F.lit("view")).alias("event_type"))
    root = new_run_dir(spark, "log")
    early, late = events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1")
    for part in (early, late):
        ops.append_log(part, f"{root}/log.jsonl")
        ops.append_log(part, f"{root}/log.tsv", ["event_id", "event_type", "extra"])
    as_json = ops.read_json_log(spark, f"{root}/log.jsonl", "event_id string, event_type string, extra string")
    as_tsv = ops.read_tsv_log(spark, f"{root}/log.tsv", ["event_id", "event_type", "extra"])
    return as_json.withColumn("kind", F.lit("json")).unionByName(as_tsv.withColumn("kind", F.lit("tsv")))


@query("a5_shard_table", """
select user_id % 8 as shard_id, event_id, value, event_type from events
where user_id % 8 >= 2 and event_id >= 100 and value <= 60""")
def a5_table(spark, sf):
    events = table(spark, sf, "events").select((F.col("user_id") % 8).alias("shard_id"), "event_id", "value", "event_type")
    shards = ShardTable(spark, new_run_dir(spark, "shard-table"), events.schema)
    for batch in (0, 1, 0):  # the third is a repeat and changes nothing
        shards.write(events.filter(F.col("event_id") % 2 == batch), batch)
    return shards.read(events.columns, {"shard_id": (2, None), "event_id": (100, None), "value": (None, 60.0)})


@query("i13_shard_table_manifest", """
select user_id % 8 as shard_id, count(*) as n_rows, count(distinct event_id % 2) as n_batches, 0 as n_broken from events group by 1""")
def i13_table(spark, sf):
    events = table(spark, sf, "events").select((F.col("user_id") % 8).alias("shard_id"), "event_id", "ts", "props")
    shards = ShardTable(spark, new_run_dir(spark, "shard-manifest"), events.schema)
    for batch in (0, 1):
        shards.write(events.filter(F.col("event_id") % 2 == batch), batch)
    return shards.manifest().withColumn("n_broken", F.lit(shards.broken().count()))
