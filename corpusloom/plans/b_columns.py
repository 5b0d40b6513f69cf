"""Queries for section B: names, selection, coercion."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.text import category, normalize_name, number_or_null
from corpusloom.operators import columns as ops
from .registry import query, table
from .sqltext import norm, number


@query("b1_normalize_name", f"""
select p_partkey, {norm("p_name || ' / ' || p_brand")} as name, {norm("'##' || substr(p_type, 1, 0)")} as empty_name
from part""")
def b1(spark, sf):
    part = table(spark, sf, "part")
    return part.select("p_partkey", normalize_name(F.concat_ws(" / ", "p_name", "p_brand")).alias("name"),
                       normalize_name(F.concat(F.lit("##"), F.substring("p_type", 1, 0))).alias("empty_name"))


@query("b2_make_unique", """
select o_orderkey as a, o_custkey as a_1, o_totalprice as a_2, o_orderstatus as a_1_1, o_orderpriority as b, 1 as a_3 from orders""")
def b2(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority", F.lit(1))
    return orders.toDF(*ops.make_unique(["a", "a_1", "a", "a_1", "b", "a"]))


@query("b3_normalize_columns", """
select o_orderkey as order_key, o_custkey as order_key_1, o_orderstatus as status, o_totalprice as total_price,
  o_orderpriority as "column" from orders""")
def b3(spark, sf):
    orders = table(spark, sf, "orders").drop("o_orderdate")
    return ops.normalize_columns(orders.toDF("Order Key", "order-key!", " STATUS ", "total.price", "??"))[0]


@query("b4_keep_scalar_columns", "select vec_id, label from embeddings")
def b4(spark, sf):
    return ops.keep_scalar_columns(table(spark, sf, "embeddings"))[0]


@query("b5_drop_null_target", "select event_id, event_type from events where nullif(event_type, 'error') is not null")
def b5(spark, sf):
    events = table(spark, sf, "events").select("event_id", F.nullif("event_type", F.lit("error")).alias("event_type"))
    return ops.drop_null_target(events, "event_type")


@query("b6_drop_identifier_columns", "select user_id, event_type, value, props from events")
def b6(spark, sf):
    return ops.drop_identifiers_by_value(table(spark, sf, "events").drop("ts"))


@query("b6_drop_identifier_names", "select event_type, value, props from events")
def b6_names(spark, sf):
    return ops.drop_identifiers_by_name(table(spark, sf, "events").drop("ts"))


@query("b7_drop_allnull_and_constant", "select c_custkey, c_acctbal, c_mktsegment from customer")
def b7(spark, sf):
    customer = table(spark, sf, "customer").select(
        "c_custkey", "c_acctbal", "c_mktsegment", F.substring("c_name", 1, 9).alias("prefix"),
        F.when(F.col("c_custkey") < 0, F.col("c_name")).alias("nothing"))
    return ops.drop_empty_and_constant(customer)


@query("b8_split_numeric_categorical", """
select 'numeric' as kind, 'o_orderkey' as "column", count(distinct o_orderkey) as n_distinct from orders
union all select 'numeric', 'o_custkey', count(distinct o_custkey) from orders
union all select 'numeric', 'o_totalprice', count(distinct o_totalprice) from orders
union all select 'categorical', 'o_orderpriority', count(distinct o_orderpriority) from orders
union all select 'categorical', 'is_open', count(distinct o_orderstatus = 'O') from orders
union all select 'categorical', 'o_orderdate', count(distinct o_orderdate) from orders""")
def b8(spark, sf):
    orders = table(spark, sf, "orders").withColumn("is_open", F.col("o_orderstatus") == "O")
    numeric, categorical = ops.split_numeric_categorical(orders, target="o_orderstatus")
    names = [("numeric", c) for c in numeric] + [("categorical", c) for c in categorical]
    counts = orders.agg(*[F.count_distinct(F.col(c)).alias(c) for _, c in names])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.lit(c).alias("column"), F.col(c).alias("n_distinct"))
        for kind, c in names])))


_CELL = "case event_id % 4 when 0 then value::varchar when 1 then props when 2 then (event_id % 50) || 'd' else ' ' || event_id || ' ' end"


@query("b9_to_number_or_null", f"select event_id, {number(f'({_CELL})')} as number from events")
def b9(spark, sf):
    four = F.col("event_id") % 4
    cell = (F.when(four == 0, F.col("value").cast("string")).when(four == 1, F.col("props"))
            .when(four == 2, F.concat((F.col("event_id") % 50).cast("string"), F.lit("d")))
            .otherwise(F.concat(F.lit(" "), F.col("event_id").cast("string"), F.lit(" "))))
    return table(spark, sf, "events").select("event_id", number_or_null(cell).alias("number"))


@query("b10_to_category", """
select event_id, coalesce(nullif(event_type, 'view'), '__MISSING__') as event_type, user_id::varchar as user_id
from events""")
def b10(spark, sf):
    events = table(spark, sf, "events")
    return events.select("event_id", category(F.nullif("event_type", F.lit("view"))).alias("event_type"),
                         category("user_id").alias("user_id"))


@query("b11_filter_catalog", """
select p_partkey, p_name, p_size from part
where p_type = 'ECONOMY' and p_size >= 10 and p_size <= 40 and lower(p_name) like '%ring%'
  and coalesce(nullif(p_retailprice, 900), 0) >= 905""")
def b11(spark, sf):
    part = table(spark, sf, "part").withColumn("usability", F.nullif("p_retailprice", F.lit(900.0)))
    found = ops.filter_catalog(part, equals={"p_type": "ECONOMY", "p_brand": None},
                               minimum={"p_size": 10, "p_retailprice": 0}, maximum={"p_size": 40},
                               name_contains=("p_name", "RING"), usability=("usability", 905))
    return found.select("p_partkey", "p_name", "p_size")


@query("b12_cap_columns", "select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag from lineitem")
def b12(spark, sf):
    return ops.cap_columns(table(spark, sf, "lineitem"), 4, keep=["l_returnflag"])


@query("b13_limit_rows", """
select event_id, user_id, value from events order by value desc, event_id limit 200""")
def b13(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "value")
    return ops.limit_rows(events, 200, [F.desc("value"), "event_id"])
