"""Queries over fifty tables of different width at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import catalogue as ops
from corpusloom.operators.infer import RANKED_TARGET_NAMES
from corpusloom.session import new_run_dir
from .registry import query, table

# per source: dataset number, and (column, Spark and DuckDB expression, tables that have it)
EVENTS = [("event_id", "event_id", "true"), ("user_id", "user_id", "true"), ("amount", "if(event_id % 7 = 0, null, event_id % 1000)", "true"),
          ("flat", "3", "d % 4 = 1"), ("void", "nullif(1, 1)", "d % 4 = 2"), ("target", "if(event_id % 17 = 0, null, event_type)", "true")]
ORDERS = [("o_orderkey", "o_orderkey", "true"), ("priority", "o_orderpriority", "d % 3 > 0"), ("label", "o_orderstatus", "true")]
SOURCES = (("events", "user_id % 25", EVENTS), ("orders", "o_custkey % 25", ORDERS))

NAMED = {n: RANKED_TARGET_NAMES.index(n) + 1 for n in ("target", "label")}
CELLS = " union all ".join(
    f"select '{source}_' || d as dataset, '{name}' as col, {place} as place, ({value})::varchar as value "
    f"from (select *, {number} as d from {source}) where {here}"
    for source, number, columns in SOURCES for place, (name, value, here) in enumerate(columns))
PROFILE = f"""cells as ({CELLS}), counted as (select dataset, col, place, value, count(*) as cnt from cells group by all),
prof as (select dataset, col as "column", row_number() over (partition by dataset order by place)::int as position, sum(cnt)::bigint as n_rows,
  coalesce(sum(cnt) filter (value is not null), 0)::bigint as n_valid, count(value) as n_distinct,
  coalesce(max(cnt) filter (value is not null), 0) as top_count, coalesce(min(cnt) filter (value is not null), 0) as least_count,
  coalesce(sum(cnt * length(value)), 0)::bigint as n_chars, coalesce(bool_and(value ~ '^[0-9]+$'), false) as prefer_numeric
  from counted group by dataset, col, place)"""


def catalogue_rows(spark, sf):
    """The tables as folders of JSON lines, read back as cells."""
    root = new_run_dir(spark, "catalogue")
    for source, number, columns in SOURCES:
        df = table(spark, sf, source).withColumn("d", F.expr(number))
        # a row is written with the columns that its table has, nulls included
        line = F.concat_ws(",", *[F.when(F.expr(here), F.regexp_replace(F.to_json(
            F.struct(F.expr(value).alias(name)), {"ignoreNullFields": "false"}), r"^\{|\}$", "")) for name, value, here in columns])
        lines = df.select(F.concat(F.lit("{"), line, F.lit("}")).alias("value"), F.concat(F.lit(f"{source}_"), "d").alias("dataset"))
        lines.hint("rebalance", "dataset").write.mode("append").partitionBy("dataset").text(root)
    return ops.json_rows(spark, root, r"dataset=([^/]+)/")


@query("c1_catalogue_profile", f"with {PROFILE} select * from prof")
def c1_catalogue(spark, sf):
    return ops.catalogue_profile(catalogue_rows(spark, sf)).select(
        "dataset", "column", "position", "n_rows", "n_valid", "n_distinct", "top_count", "least_count", "n_chars", "prefer_numeric")


@query("c10_catalogue_targets", f"""
with {PROFILE} select dataset, "column" as target_column, if(n_distinct <= 2, 'binary', 'multiclass') as task_type
from prof where "column" in ('target', 'label')""")
def c10_catalogue(spark, sf):
    return ops.catalogue_targets(ops.catalogue_profile(catalogue_rows(spark, sf))).drop("candidates")


@query("c15_catalogue_ranking", f"""
with {PROFILE}, s as (select *, case "column" when 'target' then 101 - {NAMED['target']} when 'label' then 101 - {NAMED['label']} end as named,
  if(position = max(position) over (partition by dataset), 10, null) as ending,
  case when n_distinct between 2 and 20 then 5 when n_distinct >= 2 and n_distinct < 0.05 * n_rows then 3 end as few from prof)
select dataset, "column", position, (coalesce(named, 0) + coalesce(ending, 0) + coalesce(few, 0))::bigint as score, n_distinct
from s where coalesce(named, ending, few) is not null""")
def c15_catalogue(spark, sf):
    return ops.catalogue_ranking(ops.catalogue_profile(catalogue_rows(spark, sf)))


@query("j11_catalogue_verdicts", f"""
with {PROFILE}, t as (select dataset, max(n_rows) as n_rows, count(*) as n_cols,
  max("column") filter ("column" in ('target', 'label')) as target_column,
  max(n_distinct) filter ("column" in ('target', 'label')) as classes, max(least_count) filter ("column" in ('target', 'label')) as least,
  min_by("column", position) filter (prefer_numeric and n_distinct < 2) as constant,
  min_by("column", position) filter (n_valid = 0) as nothing from prof group by dataset),
g as (select *, case when constant is not null then 'gate_fail: constant column ' || constant
  when nothing is not null then 'gate_fail: all-null column ' || nothing
  when classes < 2 then 'gate_fail: target has < 2 classes'
  when least / n_rows < 0.01 then printf('gate_fail: minority_frac=%.4f', least / n_rows)
  when n_rows < 100 then printf('gate_fail: only %d rows', n_rows) end as reason from t),
s as (select *, case when n_rows < 50 then 'too_small' when n_cols < 3 then 'too_few_cols' when reason is not null then 'gate_fail' else 'ok' end as status from g)
select dataset, n_rows, n_cols, target_column, if(classes <= 2, 'binary', 'multiclass') as task_type, status,
  case status when 'too_small' then printf('only %d rows', n_rows) when 'too_few_cols' then printf('only %d columns', n_cols)
    when 'gate_fail' then reason end as error from s""")
def j11_catalogue(spark, sf):
    rows = catalogue_rows(spark, sf)
    facts = ops.table_facts(rows)
    profile = ops.catalogue_profile(rows, facts)
    return ops.catalogue_verdicts(facts, profile, ops.catalogue_targets(profile))
