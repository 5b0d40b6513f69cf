"""Queries for section H: label rules, bins, noise, blending."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import augment as ops
from .registry import low_limits, query, table
from .sqltext import unit

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
KEY_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
WEIGHTS = {"l_quantity": 0.5, "l_discount": -30.0, "l_tax": 12.5}
SCORE = "0.5 * l_quantity + -30.0 * l_discount + 12.5 * l_tax"


def line(spark, sf):
    return table(spark, sf, "lineitem").select(*KEYS, "l_quantity", "l_discount", "l_tax", "l_returnflag")


def keyed(df, *columns):
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *columns)


@query("h1_weighted_score", f"select {KEY_SQL}, round({SCORE} + l_linenumber, 6) as score from lineitem")
def h1(spark, sf):
    return keyed(line(spark, sf), F.round(ops.weighted_score(WEIGHTS, "l_linenumber"), 6).alias("score"))


@query("h2_median_threshold_label", f"""
with s as (select *, {SCORE} as score from lineitem) select {KEY_SQL}, (score > m)::int as label from s, (select median(score) as m from s)""")
def h2(spark, sf):
    df = line(spark, sf).withColumn("score", ops.weighted_score(WEIGHTS))
    return keyed(ops.median_threshold_label(df, "score"), "label")


@query("h3_quantile_digitize", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey,
  len(list_filter(th, lambda t: t <= l_extendedprice))::int as label
from lineitem, (select quantile_cont(l_extendedprice, [0.2, 0.4, 0.6, 0.8]) as th from lineitem)""")
def h3(spark, sf):
    return keyed(ops.quantile_digitize(line(spark, sf), "l_extendedprice", 5), "label")


@query("h3_quantile_digitize_hot", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey,
  len(list_filter(th, lambda t: t <= l_extendedprice))::int as label
from lineitem, (select quantile_cont(l_extendedprice, [0.2, 0.4, 0.6, 0.8]) as th from lineitem)""")
def h3_hot(spark, sf):
    with low_limits(spark, 40):
        return h3(spark, sf)


@query("h4_quadratic_score", f"""
select {KEY_SQL}, round(0.3 * l_quantity * l_quantity - 1.2 * l_quantity * l_discount + 2.0 * l_tax * l_discount + 0.1 * l_tax * l_tax, 5) as interaction,
  round(0.3 * l_quantity * l_quantity - 1.2 * l_quantity * l_discount + 2.0 * l_tax * l_discount + 0.1 * l_tax * l_tax + ({SCORE}), 5) as quadratic
from lineitem""")
def h4(spark, sf):
    columns, matrix = ["l_quantity", "l_discount", "l_tax"], [[0.3, -1.2, 0], [0, 0, 0], [0, 2.0, 0.1]]
    return keyed(line(spark, sf), F.round(ops.quadratic_score(columns, matrix), 5).alias("interaction"),
                 F.round(ops.quadratic_score(columns, matrix, WEIGHTS), 5).alias("quadratic"))


@query("h5_polynomial_score", f"""
select {KEY_SQL}, round(0.5 * l_quantity - 0.02 * pow(l_quantity, 2) + 4.0 * pow(l_tax, 2) + 0.001 * pow(l_quantity, 3), 5) as score from lineitem""")
def h5(spark, sf):
    terms = [{"l_quantity": 0.5}, {"l_quantity": -0.02, "l_tax": 4.0}, {"l_quantity": 0.001}]
    return keyed(line(spark, sf), F.round(ops.polynomial_score(terms), 5).alias("score"))


@query("h6_additive_response", f"""
select {KEY_SQL}, round(l_quantity * 0.4 + l_discount * l_discount * -2.0 + sin(l_tax * 2.1) * 0.7 + abs(l_linenumber - 4) * 1.5, 5) as score from lineitem""")
def h6(spark, sf):
    df = line(spark, sf).withColumn("centred", F.col("l_linenumber") - 4)
    terms = {"l_quantity": ("id", 0.4), "l_discount": ("sq", -2.0), "l_tax": ("sin", 0.7), "centred": ("abs", 1.5)}
    return keyed(df, F.round(ops.additive_response(terms), 5).alias("score"))


@query("h7_tree_rule_label", f"""
with a as (select *, if(l_quantity <= lo + 0.4 * (hi - lo), 'rL', 'rR') as node
  from lineitem, (select min(l_quantity) as lo, max(l_quantity) as hi from lineitem)),
b as (select node, min(l_extendedprice) as lo2, max(l_extendedprice) as hi2, count(*) as n2 from a group by node),
leaf as (select a.*, if(n2 < 2 or lo2 >= hi2, a.node, a.node || if(l_extendedprice <= lo2 + 0.3 * (hi2 - lo2), 'L', 'R')) as leaf
  from a join b using (node))
select {KEY_SQL}, ('0x' || substr(md5('5:' || leaf), 1, 8))::bigint % 4 as label from leaf""")
def h7(spark, sf):
    return keyed(ops.tree_rule_label(line(spark, sf), ["l_quantity", "l_extendedprice"], [0.4, 0.3], 4, seed=5), "label")


@query("h8_structural_columns", f"""
with a as (select *, 0.5 * l_quantity + 2.0 * l_tax as c1 from lineitem), b as (select *, -1.5 * c1 + 3.0 * l_discount as c2 from a)
select {KEY_SQL}, round(c1, 6) as c1, round(c2, 6) as c2, round(0.25 * c1 + 0.75 * c2, 6) as c3 from b""")
def h8(spark, sf):
    out = ops.structural_columns(line(spark, sf), {"c1": {"l_quantity": 0.5, "l_tax": 2.0}, "c2": {"c1": -1.5, "l_discount": 3.0},
                                                   "c3": {"c1": 0.25, "c2": 0.75}})
    return keyed(out, *[F.round(c, 6).alias(c) for c in ("c1", "c2", "c3")])


def _bin_sql(column: str, words: list[str], name: str) -> str:
    k = len(words)
    probs = ", ".join(f"{i}::double / {k}" for i in range(k + 1))
    return f"""(select list_sort(list_distinct(quantile_cont({column}, [{probs}]))) as e_{name} from lineitem)""", \
        f"""[{", ".join(f"'{w}'" for w in words)}][least(len(list_filter(e_{name}[2:], lambda t: t <= {column})), {k - 1}) + 1] as {name}"""


_A, _AC = _bin_sql("l_extendedprice", [f"v{i}" for i in range(6)], "price_bin")
_B, _BC = _bin_sql("l_linenumber", [f"v{i}" for i in range(9)], "number_bin")
_C, _CC = _bin_sql("l_quantity", list(ops.ORDINAL_WORDS[3]), "often")
_D, _DC = _bin_sql("l_tax", list(ops.ORDINAL_WORDS[0]), "tax_level")


@query("h9_bin_to_categories", f"select {KEY_SQL}, {_AC}, {_BC} from lineitem, {_A}, {_B}")
def h9(spark, sf):
    out = ops.bin_to_categories(line(spark, sf), "l_extendedprice", 6, "price_bin")
    return keyed(ops.bin_to_categories(out, "l_linenumber", 9, "number_bin"), "price_bin", "number_bin")


@query("h10_bin_to_ordinal_words", f"select {KEY_SQL}, {_CC}, {_DC} from lineitem, {_C}, {_D}")
def h10(spark, sf):
    out = ops.bin_to_words(line(spark, sf), "l_quantity", ops.ORDINAL_WORDS[3], "often")
    return keyed(ops.bin_to_words(out, "l_tax", ops.ORDINAL_WORDS[0], "tax_level"), "often", "tax_level")


@query("h11_binary_indicator", f"select {KEY_SQL}, (l_extendedprice > m)::int as flag from lineitem, (select median(l_extendedprice) as m from lineitem)")
def h11(spark, sf):
    return keyed(ops.binary_indicator(line(spark, sf), "l_extendedprice", "flag"), "flag")


@query("h12_inject_missing", f"""
select event_id, case when {unit("'8:value:' || event_id")} >= 0.15 then value end as value,
  case when {unit("'8:user_id:' || event_id")} >= 0.15 then user_id end as user_id from events""")
def h12(spark, sf):
    events = table(spark, sf, "events").select("event_id", "value", "user_id")
    out = ops.inject_missing(events, ["value", "user_id"], 0.15, ["event_id"], seed=8)
    return ops.inject_missing(out, ["value"], 0.005, ["event_id"], seed=9)


@query("h13_inject_drift", """
with r as (select *, row_number() over (order by o_orderdate, o_orderkey) as rn, count(*) over () as n from orders)
select o_orderkey, round(o_totalprice + if(rn > n // 2, 100.5, 0), 4) as o_totalprice, (o_custkey + if(rn > n // 2, -3.0, 0))::double as o_custkey from r""")
def h13(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", F.col("o_custkey").cast("double").alias("o_custkey"))
    out = ops.inject_drift(orders, {"o_totalprice": 100.5, "o_custkey": -3.0}, ["o_orderdate", "o_orderkey"])
    return out.select("o_orderkey", F.round("o_totalprice", 4).alias("o_totalprice"), "o_custkey")


@query("h14_mixup", """
with a as (select *, row_number() over (order by md5('6:row:' || event_id)) as p from events),
b as (select value as v2, event_type as t2, row_number() over (order by md5('6:mate:' || event_id)) as p from events)
select event_id, props, round(0.7 * value + 0.3 * v2, 6) as value, event_type, t2 as event_type_partner, 0.7::double as mix_share
from a join b using (p)""")
def h14(spark, sf):
    events = table(spark, sf, "events").select("event_id", "props", "value", "event_type")
    out = ops.mixup(events, ["value"], "event_type", 0.7, ["event_id"], seed=6)
    return out.withColumn("value", F.round("value", 6))


@query("h15_zscore_by_dataset", """
with e as (select event_id, user_id, case when event_id % 9 = 0 then null else value end as x, 1.0 as one from events)
select event_id, round(coalesce((x - avg(x) over w) / if(stddev_pop(x) over w < 1e-8, 1, stddev_pop(x) over w), 0), 6) as value, 0.0::double as one
from e window w as (partition by user_id)""")
def h15(spark, sf):
    x = F.when(F.col("event_id") % 9 != 0, F.col("value"))
    events = table(spark, sf, "events").select("event_id", "user_id", x.alias("value"), F.lit(1.0).alias("one"))
    out = ops.zscore_by_dataset(events, ["user_id"], ["value", "one"])
    return out.select("event_id", F.round("value", 6).alias("value"), "one")
