"""Queries for section C: profiles, task, target and domain inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.text import name_tokens
from corpusloom.operators import infer, profile as ops
from .registry import query, table
from .sqltext import date, norm, profile, text_list, values

CUSTOMER_SRC = """select c_custkey, c_name, c_nationkey, c_acctbal, nullif(c_mktsegment, 'BUILDING') as c_mktsegment
  from customer"""
CUSTOMER = profile(CUSTOMER_SRC, ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
                   ["c_custkey", "c_nationkey", "c_acctbal"])
ORDERS = profile("select * from orders",
                 ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
                 ["o_orderkey", "o_custkey", "o_totalprice"])
DOCUMENTS = profile("select doc_id, text, lang, source, n_chars from documents",
                    ["doc_id", "text", "lang", "source", "n_chars"], ["doc_id", "n_chars"])
RATIOS = """round(missing_ratio, 6) as missing_ratio, round(unique_ratio, 6) as unique_ratio,
  round(top_frequency_ratio, 6) as top_frequency_ratio, round(avg_string_length, 6) as avg_string_length,
  round(parse_numeric_ratio, 6) as parse_numeric_ratio, round(parse_datetime_ratio, 6) as parse_datetime_ratio"""


def customer(spark, sf):
    return table(spark, sf, "customer").withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING")))


def rounded(*names):
    return [F.round(n, 6).alias(n) for n in names]


@query("c1_column_profile", f"{CUSTOMER} select col as \"column\", n_rows, n_distinct, {RATIOS} from prof")
def c1(spark, sf):
    prof = ops.column_profile(customer(spark, sf))
    return prof.select("column", "n_rows", "n_distinct", *rounded(*ops.RATIO_NAMES))


@query("c2_datetime_parse_ratio", f"""
with src as (select o_orderdate::varchar as full_text, strftime(o_orderdate, '%m/%d/%Y') as us_text,
  strftime(o_orderdate, '%Y') as year_text,
  case when o_orderkey % 3 = 0 then strftime(o_orderdate, '%Y/%m/%d') when o_orderkey % 3 = 1 then 'n/a' end as mixed
  from orders),
cells as (select 'full_text' as c, full_text as v from src union all select 'us_text', us_text from src
  union all select 'year_text', year_text from src union all select 'mixed', mixed from src)
select c as "column", round(count({date('v')}) / count(v), 6) as ratio from cells group by c""")
def c2(spark, sf):
    orders = table(spark, sf, "orders")
    third = F.col("o_orderkey") % 3
    src = orders.select(
        F.col("o_orderdate").cast("string").alias("full_text"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("us_text"),
        F.date_format("o_orderdate", "yyyy").alias("year_text"),
        F.when(third == 0, F.date_format("o_orderdate", "yyyy/MM/dd")).when(third == 1, "n/a").alias("mixed"))
    ratios = ops.datetime_parse_ratio(src, src.columns)
    return ratios.select("column", F.round("ratio", 6).alias("ratio"))


@query("c3_type_probabilities", f"""{ORDERS} select col as "column", round(p1, 6) as p_numeric,
  round(p2, 6) as p_categorical, round(p3, 6) as p_text, round(p4, 6) as p_identifier, round(p5, 6) as p_datetime
  from prob""")
def c3(spark, sf):
    prob = ops.type_probabilities(ops.column_profile(table(spark, sf, "orders")))
    return prob.select("column", *rounded(*[f"p_{k}" for k in ops.TYPE_NAMES]))


@query("c4_profile_vector", CUSTOMER + " " + " union all ".join(
    f"select col as \"column\", {i} as slot, round({name}, 6) as amount from prob" for i, name in enumerate(
        ["missing_ratio", "unique_ratio", "top_frequency_ratio", "avg_string_length", "parse_numeric_ratio",
         "parse_datetime_ratio", "p1", "p2", "p3", "p4", "p5"])))
def c4(spark, sf):
    prob = ops.type_probabilities(ops.column_profile(customer(spark, sf)))
    return (prob.select("column", F.posexplode(ops.profile_vector()).alias("slot", "amount"))
            .withColumn("amount", F.round("amount", 6)))


_DOMINANT = """case when p1 >= greatest(p2,p3,p4,p5) then 'numeric' when p2 >= greatest(p3,p4,p5) then 'categorical'
  when p3 >= greatest(p4,p5) then 'text' when p4 >= p5 then 'identifier' else 'datetime' end"""


def schema_text_sql(kind: str) -> str:
    return f"""printf('name %s feature_kind %s dominant_type %s missing_ratio %.3f unique_ratio %.3f top_frequency_ratio %.3f avg_length %.3f numeric_parse_ratio %.3f datetime_parse_ratio %.3f',
  col, {kind}, {_DOMINANT}, missing_ratio, unique_ratio, top_frequency_ratio, avg_string_length,
  parse_numeric_ratio, parse_datetime_ratio)"""


@query("c5_schema_text", f"""{ORDERS} select col as "column",
  {schema_text_sql("if(prefer_numeric, 'numeric', 'categorical')")} as schema_text from prob""")
def c5(spark, sf):
    prob = ops.type_probabilities(ops.column_profile(table(spark, sf, "orders")))
    kind = F.when(F.col("prefer_numeric"), "numeric").otherwise("categorical")
    return prob.select("column", ops.schema_text(kind).alias("schema_text"))


@query("c6_is_text_feature", f"""{DOCUMENTS} select col as "column",
  p3 >= greatest(p2, p4) and (avg_string_length >= 12 or unique_ratio >= 0.25) as is_text from prob""")
def c6(spark, sf):
    prob = ops.type_probabilities(ops.column_profile(table(spark, sf, "documents")))
    return prob.select("column", ops.is_text_feature().alias("is_text"))


@query("c7_name_tokens", """
with parts as (select p_partkey, list_filter(regexp_split_to_array(lower(p_name || '_' || p_brand || '-' || p_type || '.x'),
  '[^a-zA-Z0-9]+'), lambda x: x <> '') as parts from part)
select p_partkey, array_to_string(list_resize(parts[1:4], 4, ''), '|') as tokens from parts""")
def c7(spark, sf):
    name = F.concat(F.col("p_name"), F.lit("_"), F.col("p_brand"), F.lit("-"), F.col("p_type"), F.lit(".x"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(name_tokens(name), "|").alias("tokens"))


_NAMES_SQL = f"""
with names as (
  select distinct unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) as name from documents
  union select distinct lower(o_orderpriority) || case o_orderstatus when 'F' then ' Status/Result'
    when 'O' then ' sales price' else '' end from orders
  union select distinct case o_orderstatus when 'F' then 'Target' when 'O' then ' Y ' else 'labels' end from orders),
normed as (select name, {norm('name')} as n from names where name <> ''),
kw as (select * from {values(infer.TARGET_KEYWORD_WEIGHTS, 't(k, w)')}),
exact as (select * from {values(infer.EXACT_TARGET_SCORES, 't(k, w)')}),
hits as (select name, sum(w) as total, count(*) as n_hits from normed join kw on contains(n, k) group by name)
select normed.name, coalesce(exact.w, least(coalesce(hits.total, 0.0), 5.0))::double as name_score,
  case when exact.w is not null then 0 else coalesce(n_hits, 0) end as n_hits
from normed left join hits using (name) left join exact on exact.k = n"""


@query("c8_target_name_score", _NAMES_SQL)
def c8(spark, sf):
    orders = table(spark, sf, "orders")
    words = table(spark, sf, "documents").select(F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("name"))
    status = F.col("o_orderstatus")
    longer = orders.select(F.concat(F.lower("o_orderpriority"), F.when(status == "F", " Status/Result")
                                    .when(status == "O", " sales price").otherwise("")).alias("name"))
    exact = orders.select(F.when(status == "F", "Target").when(status == "O", " Y ").otherwise("labels").alias("name"))
    names = words.union(longer).union(exact).filter("name <> ''").distinct()
    scored = infer.target_name_score(names, "name")
    return scored.select("name", "name_score", F.size("keyword_hits").cast("bigint").alias("n_hits"))


_TASK_A = """case when n_valid = 0 then 'multiclass' when n_distinct <= 2 then 'binary'
  when parse_numeric_ratio < 0.95 then 'multiclass'
  when integer_like and n_distinct <= least(32, greatest(3, n_valid // 20)) then 'multiclass'
  when unique_ratio <= 0.1 and n_distinct <= 64 then 'multiclass' else 'regression' end"""

_SCORED = f""", kw as (select * from {values(infer.TARGET_KEYWORD_WEIGHTS, 't(k, w)')}),
exact as (select * from {values(infer.EXACT_TARGET_SCORES, 't(k, w)')}),
hits as (select col, sum(w) as total, list(k order by w desc, k) as ks from prof join kw on contains({norm('col')}, k) group by col),
t as (select prof.*, {_TASK_A} as task_type, coalesce(exact.w, least(coalesce(hits.total, 0.0), 5.0)) as name_score,
  {norm('col')} in ('id','index','row_id','row_number','record_id','customer_id') or regexp_matches({norm('col')}, '(_id|_key|_uuid)$') as id_like
  from prof left join hits using (col) left join exact on exact.k = {norm('col')}),
scored as (select *, name_score
  - case when id_like then 5.0 when unique_ratio >= 0.98 and n_valid >= 32 and name_score = 0 then 2.5 else 0 end
  + case when n_distinct <= 1 then -10.0 when task_type = 'binary' then 3.0
      when task_type = 'multiclass' and n_distinct <= 16 then 2.5 else 1.0 end
  - case when task_type <> 'regression' and n_distinct > greatest(64, floor(n_valid * 0.2)) and name_score = 0 then 2.0 else 0 end
  - case when task_type <> 'regression' and avg_string_length > 48 and name_score = 0 then 1.5 else 0 end as score
  from t)"""


@query("c9_score_target_candidate", f"""{DOCUMENTS}{_SCORED}
select col as "column", task_type, round(score::double, 6) as score, round(name_score::double, 6) as name_score, n_distinct
from scored""")
def c9(spark, sf):
    scored = infer.score_targets(ops.column_profile(table(spark, sf, "documents")))
    return scored.select("column", "task_type", *rounded("score", "name_score"), "n_distinct")


@query("c10_resolve_target", f"""{ORDERS}{_SCORED}, top as (select * from scored order by score desc, position limit 1)
select o_orderkey, o_orderstatus as target, top.col as target_column, top.task_type from orders, top
where top.col = 'o_orderstatus'""")
def c10(spark, sf):
    orders = table(spark, sf, "orders")
    found = infer.resolve_target(orders)
    return orders.select("o_orderkey", F.col(found.column).alias("target"), F.lit(found.column).alias("target_column"),
                         F.lit(found.task_type).alias("task_type"))


LINE_SRC = """select l_linenumber, l_quantity, l_discount, l_extendedprice, l_returnflag, l_linestatus,
  l_quantity > 25 as is_large, case when l_orderkey < 0 then l_tax end as nothing, l_tax::varchar as tax_text from lineitem"""
LINE_COLUMNS = ["l_linenumber", "l_quantity", "l_discount", "l_extendedprice", "l_returnflag", "l_linestatus",
                "is_large", "nothing", "tax_text"]
LINE = profile(LINE_SRC, LINE_COLUMNS, ["l_linenumber", "l_quantity", "l_discount", "l_extendedprice", "nothing"])


def line_profile(spark, sf):
    line = table(spark, sf, "lineitem").select(
        "l_linenumber", "l_quantity", "l_discount", "l_extendedprice", "l_returnflag", "l_linestatus",
        (F.col("l_quantity") > 25).alias("is_large"),
        F.when(F.col("l_orderkey") < 0, F.col("l_tax")).alias("nothing"),
        F.col("l_tax").cast("string").alias("tax_text"))
    return ops.column_profile(line, LINE_COLUMNS)


@query("c11_infer_task_a", f'{LINE} select col as "column", {_TASK_A} as task_type from prof')
def c11(spark, sf):
    return line_profile(spark, sf).select("column", infer.infer_task("A").alias("task_type"))


@query("c12_infer_task_b", f"""{LINE} select col as "column", case when n_distinct <= 2 then 'binary'
  when n_distinct <= 20 and n_distinct < n_rows * 0.05 then 'multiclass' else 'regression' end as task_type from prof""")
def c12(spark, sf):
    return line_profile(spark, sf).select("column", infer.infer_task("B").alias("task_type"))


@query("c13_infer_task_c", f"""{LINE} select col as "column", case when n_valid = 0 then 'regression'
  when not prefer_numeric or n_numeric < n_valid or n_distinct <= 20
    then if(n_distinct = 2, 'binary', 'multiclass') else 'regression' end as task_type from prof""")
def c13(spark, sf):
    return line_profile(spark, sf).select("column", infer.infer_task("C").alias("task_type"))


@query("c14_infer_task_def", f"""{LINE} select col as "column",
  case when n_distinct = 2 then 'binary' when n_numeric = n_valid and n_distinct > 20 then 'regression'
    else 'multiclass' end as rule_d,
  case when col like 'l\\_r%' escape '\\' or n_distinct <= 20 then if(n_distinct <= 2, 'binary', 'multiclass')
    else 'regression' end as rule_e,
  case when prefer_numeric or n_distinct = 0 then 'regression' when n_distinct = 2 then 'binary'
    else 'multiclass' end as rule_f from prof""")
def c14(spark, sf):
    prof = line_profile(spark, sf).withColumns({
        "nominal": F.col("column").startswith("l_r"),
        "n_classes": F.when(~F.col("prefer_numeric"), F.col("n_distinct"))})
    return prof.select("column", *[infer.infer_task(r).alias(f"rule_{r.lower()}") for r in "DEF"])


_LABELS = profile("select doc_id, quality, toxic, nullif(quality, 0) as Class from labels",
                  ["doc_id", "quality", "toxic", "Class"], ["doc_id", "quality", "toxic", "Class"])


@query("c15_rank_target_candidates", f"""{_LABELS}, s as (select col as "column", n_distinct, position,
  case when list_position({text_list(infer.RANKED_TARGET_NAMES)}, lower(col)) is not null
    then 101 - list_position({text_list(infer.RANKED_TARGET_NAMES)}, lower(col)) end as a,
  case when position = 4 then 10 end as b,
  case when n_distinct between 2 and 20 then 5 when n_distinct / n_rows < 0.05 and n_distinct >= 2 then 3 end as c
  from prof)
select "column", n_distinct, (coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0))::bigint as score
from s where coalesce(a, b, c) is not null""")
def c15(spark, sf):
    labels = table(spark, sf, "labels").withColumn("Class", F.nullif("quality", F.lit(0)))
    return infer.rank_target_candidates(ops.column_profile(labels)).select("column", "n_distinct", "score")


_GUESS_CELLS = """select user_id, event_id as position, case if(event_id % 23 in (3, 7, 11) and event_id % 5 <> 0, 0, event_id % 23)
  when 3 then event_type || '_class' when 7 then 'Churn' when 11 then 'churn' when 15 then event_type || 'Date'
  else event_type || '_' || (event_id % 7) end as name from events"""


@query("c16_guess_target_column", f"""
with cells as ({_GUESS_CELLS}),
k as (select user_id, position, name, list_position({text_list([n.lower() for n in infer.GUESSED_TARGET_NAMES])}, lower(name)) as idx
  from cells),
known as (select user_id, name from (select *, row_number() over (partition by user_id order by idx,
  if({text_list(infer.GUESSED_TARGET_NAMES)}[idx] = name, 0, 1), position desc) as rn from k where idx is not null) where rn = 1),
sub as (select user_id, min_by(name, position) as name from cells
  where regexp_matches(lower(name), 'target|label|class|output|y_') group by user_id),
last as (select user_id, max_by(name, position) as name, count(*) as n from cells group by user_id)
select last.user_id, coalesce(known.name, sub.name,
  case when n > 2 and not regexp_matches(lower(last.name), 'id|index|name|date|time') then last.name end) as target_column
from last left join known using (user_id) left join sub using (user_id)""")
def c16(spark, sf):
    events = table(spark, sf, "events")
    slot = F.expr("if(event_id % 23 in (3, 7, 11) and event_id % 5 <> 0, 0, event_id % 23)")
    name = (F.when(slot == 3, F.concat("event_type", F.lit("_class"))).when(slot == 7, "Churn")
            .when(slot == 11, "churn").when(slot == 15, F.concat("event_type", F.lit("Date")))
            .otherwise(F.concat("event_type", F.lit("_"), (F.col("event_id") % 7).cast("string"))))
    cells = events.select(
        "user_id", F.col("event_id").alias("position"), name.alias("name"))
    return infer.guess_target_column(cells, "user_id", "position", "name")


@query("c17_normalize_real_dataset", """
select o_orderkey, (dense_rank() over (order by o_orderpriority) - 1)::double as target, 'multiclass' as task_type
from orders where o_orderpriority <> '5-LOW'
union all select o_orderkey, null, 'multiclass' from orders where o_orderpriority = '5-LOW'""")
def c17(spark, sf):
    orders = table(spark, sf, "orders").withColumn("o_orderpriority", F.nullif("o_orderpriority", F.lit("5-LOW")))
    out, _, task = infer.normalize_real_dataset(orders, preferred="o_orderpriority")
    return out.select("o_orderkey", "target", F.lit(task).alias("task_type"))


@query("c18_detect_temporal_columns", f"""
select 'o_orderdate' as "column", count(*) as n from orders
union all select 'day_text', count(*) from (select case when o_orderkey % 10 = 0 then 'unknown'
  else strftime(o_orderdate, '%Y-%m-%d') end as t from orders) having count({date('t')}) / count(t) >= 0.8
union all select 'order_year', count(*) from orders""")
def c18(spark, sf):
    orders = table(spark, sf, "orders").withColumns({
        "day_text": F.when(F.col("o_orderkey") % 10 == 0, "unknown").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")),
        "order_year": F.year("o_orderdate")}).drop("o_custkey")
    found = infer.temporal_columns(orders)
    rows = F.array(*[F.lit(c) for c in found])
    return orders.select(F.explode(rows).alias("column")).groupBy("column").agg(F.count(F.lit(1)).alias("n"))


@query("c19_classify_domain", f"""
with scored as (select doc_id, pos, d, len(list_filter(ws, lambda w: contains(lower(text), w))) as s
  from documents, (values {", ".join(f"({i}, '{d}', {text_list(ws)})" for i, (d, ws) in enumerate(infer.DOMAIN_KEYWORDS.items()))}) as k(pos, d, ws))
select doc_id, case when max(s) > 0 then arg_min(d, pos - s * 100) else 'unknown' end as domain from scored group by doc_id""")
def c19(spark, sf):
    return infer.classify_domain(table(spark, sf, "documents").select("doc_id", "text"), "text").select("doc_id", "domain")


@query("c20_validate_table", """
select true as ok, '' as reason, count(*) as n_rows, 5::bigint as n_cols from documents
union all select count(distinct c_name) < 200, if(count(distinct c_name) < 200, '', 'only 1 usable columns'), count(*), 2::bigint from customer
union all select false, 'too small: (' || n || ', 2)', 0, 0 from (select count(*) as n from region)""")
def c20(spark, sf):
    good = infer.validate_table(table(spark, sf, "documents"))
    bad = infer.validate_table(table(spark, sf, "customer").select("c_custkey", "c_name"))
    small = infer.validate_table(table(spark, sf, "region"))
    return good.union(bad).union(small)


@query("c21_raw_text_values", """
select conv_id, turn, coalesce(nullif(role, 'system'), '') || '|' || coalesce(nullif(text, ''), '') as raw_text
from conversations""")
def c21(spark, sf):
    rows = table(spark, sf, "conversations").withColumns({
        "role": F.nullif("role", F.lit("system")), "text": F.nullif("text", F.lit(""))})
    out = infer.raw_text_values(rows, ["role", "text"])
    return out.select("conv_id", "turn", F.array_join("raw_text", "|").alias("raw_text"))
