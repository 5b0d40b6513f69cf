"""Queries for section J: quality gates per dataset."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import gates as ops
from .i_corpus import K
from .registry import query, table

# one dataset per user; some break a gate on purpose
GATE_SQL = f"""g as (select user_id, event_id, if(user_id % 7 = 1, 5.0, value) as f0,
  if(user_id % 7 = 2, null, {K}::double) as f1, if(user_id % 7 = 6, 1.0, event_id % 3)::double as f2,
  case when user_id % 7 = 3 then 'same' when event_id % 6 = 0 then null else event_type end as target,
  if(user_id % 2 = 0, 'multiclass', 'regression') as task_type from events)"""


def datasets(spark, sf):
    events = table(spark, sf, "events")
    seven = F.col("user_id") % 7
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("double")
    target = F.when(seven == 3, "same").when(F.col("event_id") % 6 != 0, F.col("event_type"))
    return events.select(
        "user_id", "event_id", F.when(seven == 1, 5.0).otherwise(F.col("value")).alias("f0"),
        F.when(seven != 2, k).alias("f1"), F.when(seven == 6, 1.0).otherwise((F.col("event_id") % 3).cast("double")).alias("f2"),
        target.alias("target"), F.when(F.col("user_id") % 2 == 0, "multiclass").otherwise("regression").alias("task_type"))


_CONST = "case when count(distinct f0) <= 1 then 'f0' when count(distinct f1) <= 1 then 'f1' when count(distinct f2) <= 1 then 'f2' end"
_CONST2 = """case when count(f0) <= 1 or stddev_pop(f0) < 1e-10 then 'f0' when count(f1) <= 1 or stddev_pop(f1) < 1e-10 then 'f1'
  when count(f2) <= 1 or stddev_pop(f2) < 1e-10 then 'f2' end"""


@query("j1_constant_column_gate", f"""
with {GATE_SQL} select user_id, {_CONST} as pod, {_CONST2} as corpus from g group by user_id""")
def j1(spark, sf):
    df, columns = datasets(spark, sf), ["f0", "f1", "f2"]
    pod = ops.column_gates(df, ["user_id"], columns, columns).select("user_id", F.col("constant_column").alias("pod"))
    other = ops.column_gates(df, ["user_id"], columns, columns, "corpus").select("user_id", F.col("constant_column").alias("corpus"))
    return pod.join(other, "user_id")


@query("j2_all_null_gate", f"with {GATE_SQL} select user_id, case when count(f1) = 0 then 'f1' end as null_column from g group by user_id")
def j2(spark, sf):
    return ops.column_gates(datasets(spark, sf), ["user_id"], [], ["f0", "f1", "f2"]).select("user_id", "null_column")


@query("j3_class_count_gate", f"with {GATE_SQL} select user_id, count(distinct target) as n_classes, count(distinct target) < 2 as fails from g group by user_id")
def j3(spark, sf):
    out = ops.class_gates(datasets(spark, sf), ["user_id"], "target")
    return out.select("user_id", "n_classes", (F.col("n_classes") < 2).alias("fails"))


@query("j4_minority_gate", """
with c as (select source, toxic, count(*) as n from labels join documents using (doc_id) group by all)
select source, round(min(n) filter (where toxic is not null) / sum(n), 6) as pod,
  round(min(n) filter (where toxic is not null) / sum(n) filter (where toxic is not null), 6) as corpus
from (select source, nullif(toxic * 10 + quality, 10) as toxic, count(*) as n from labels join documents using (doc_id) group by all) group by source""")
def j4(spark, sf):
    labels = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    df = labels.select("source", F.nullif(F.col("toxic") * 10 + F.col("quality"), F.lit(10)).alias("label"))
    pod = ops.class_gates(df, ["source"], "label").select("source", F.round("minority_share", 6).alias("pod"))
    other = ops.class_gates(df, ["source"], "label", "corpus").select("source", F.round("minority_share", 6).alias("corpus"))
    return pod.join(other, "source")


@query("j5_duplicate_gate", """
select source, count(*) as n_rows, round(1 - count(distinct text) / count(*), 6) as duplicate_share from documents group by source
union all select 'all', count(*), round(1 - count(distinct text) / count(*), 6) from documents""")
def j5(spark, sf):
    docs = table(spark, sf, "documents").select("source", "text")
    by_source = ops.duplicate_share(docs, ["source"], ["text"])
    whole = ops.duplicate_share(docs.withColumn("source", F.lit("all")), ["source"], ["text"])
    return by_source.unionByName(whole).withColumn("duplicate_share", F.round("duplicate_share", 6))


@query("j6_min_rows_gate", "select user_id, count(*) as n_rows, count(*) < 60 as fails from events group by user_id")
def j6(spark, sf):
    out = ops.column_gates(datasets(spark, sf), ["user_id"], [], [])
    return out.select("user_id", "n_rows", (F.col("n_rows") < 60).alias("fails"))


def _corr(a: str, b: str) -> str:
    x = {"l_doubled": "l_quantity * 2 + 1", "l_gap": "nullif(l_discount, 0)", "l_one": "1.0"}
    left, right = x.get(a, a), x.get(b, b)
    return f"""select '{a}' as "left", '{b}' as "right", round(if(isnan(c), null, c), 6) as correlation
  from (select corr({left}, {right}) as c from lineitem)"""


_CORR = ["l_quantity", "l_extendedprice", "l_tax", "l_gap", "l_doubled", "l_one"]


@query("j7_max_pairwise_correlation", " union all ".join(_corr(a, b) for i, a in enumerate(_CORR) for b in _CORR[i + 1:]))
def j7(spark, sf):
    line = table(spark, sf, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_tax", F.nullif("l_discount", F.lit(0.0)).alias("l_gap"),
        (F.col("l_quantity") * 2 + 1).alias("l_doubled"), F.lit(1.0).alias("l_one"))
    out = ops.pairwise_correlations(line, _CORR)
    return out.withColumn("correlation", F.round("correlation", 6))


_MANY = [f"l_quantity + {i} * l_tax" for i in range(52)]


@query("j7_max_correlation_note", f"""
with c as (select list_max([{", ".join(f"abs(corr({a}, {b}))" for i, a in enumerate(_MANY) for b in _MANY[i + 1:])}]) as m from lineitem)
select round(m, 6) as max_correlation, if(m > 0.99, printf('SOFT_WARN: max_corr=%.3f', m), '') as note from c""")
def j7_note(spark, sf):
    line = table(spark, sf, "lineitem").select(*[F.expr(x).alias(f"c{i}") for i, x in enumerate(_MANY)])
    return ops.max_pairwise_correlation(line, line.columns).withColumn("max_correlation", F.round("max_correlation", 6))


def _labelled(spark, sf):
    """Documents with a label that their length decides, and one that a hash draws."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source")
    return docs.withColumns({"long": (F.col("n_chars") > 1500).cast("int"), "drawn": F.crc32(F.md5(F.col("doc_id").cast("string"))) % 2,
                             "twice": 2.0 * F.col("n_chars")})


@query("j8_utility_score", """
select count(*) as n_rows, true as separable, true as drawn, true as by_text, true as real, 0.0::double as few, '' as few_note,
  'SOFT_WARN: no usable features' as bare_note, 'SOFT_WARN: utility_check_error' as error_note, true as alone from documents""")
def j8(spark, sf):
    rows = _labelled(spark, sf)
    fit = {"folds": 2, "trees": 10, "depth": 5}
    separable, _ = ops.utility_check(rows, ["n_chars", "lang"], "long", "binary", ["doc_id"], **fit)
    drawn, _ = ops.utility_check(rows, ["n_chars", "source"], "drawn", "binary", ["doc_id"], **fit)
    by_text, _ = ops.utility_check(rows, ["lang"], "lang", "multiclass", ["doc_id"], **fit)
    real, _ = ops.utility_check(rows, ["n_chars"], "twice", "regression", ["doc_id"], **fit)
    few, few_note = ops.utility_check(rows.limit(29), ["n_chars"], "long", "binary", ["doc_id"])
    _, bare_note = ops.utility_check(rows, [], "long", "binary", ["doc_id"])
    _, error_note = ops.utility_check(rows, ["no such column"], "long", "binary", ["doc_id"])
    # one class only: no AUC, so the accuracy, which is 1
    alone, _ = ops.utility_check(rows.withColumn("one", F.lit("x")), ["n_chars"], "one", "binary", ["doc_id"], **fit)
    return rows.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(separable >= 0.95).alias("separable"), F.lit(0.25 <= drawn <= 0.75).alias("drawn"),
        F.lit(by_text >= 0.99).alias("by_text"), F.lit(real >= 0.5).alias("real"), F.lit(few).alias("few"),
        F.lit(few_note).alias("few_note"), F.lit(bare_note).alias("bare_note"), F.lit(error_note[:30]).alias("error_note"),
        F.lit(alone == 1.0).alias("alone"))


@query("j13_check_table", """
select false as passed, 0.0::double as score, 'gate_fail: constant column same' as notes, true as good_passed, true as good_score,
  'SOFT_WARN: max_corr=1.000' as good_notes from (select count(*) from documents)""")
def j13(spark, sf):
    rows = _labelled(spark, sf).withColumn("same", F.lit(1))
    bad = ops.check_table(rows, ["n_chars", "same"], "long", "binary", ["doc_id"])
    good = ops.check_table(rows, ["n_chars", "twice"], "long", "binary", ["doc_id"], folds=2, trees=10)
    return rows.agg(F.count(F.lit(1))).select(
        F.lit(bad[0]).alias("passed"), F.lit(bad[1]).alias("score"), F.lit(bad[2]).alias("notes"),
        F.lit(good[0]).alias("good_passed"), F.lit(good[1] >= 0.95).alias("good_score"), F.lit(good[2]).alias("good_notes"))


_SCORES = """s as (select user_id, if(user_id % 2 = 0, 'regression', 'binary') as task_type,
  round(if(user_id % 2 = 0, avg(value) / 9.7 - 2, avg(value) / 24.7), 4) as score from events group by user_id)"""


@query("j9_utility_floor", f"""
with {_SCORES} select user_id, task_type, score, case when task_type = 'regression' and score <= 0 then printf('SOFT_WARN: R2=%.3f', score)
  when task_type <> 'regression' and score < 0.55 then printf('SOFT_WARN: AUC=%.3f', score) else '' end as note
from s where if(task_type = 'regression', score >= -1.0, score >= 0.5)""")
def j9(spark, sf):
    even = F.col("user_id") % 2 == 0
    scores = table(spark, sf, "events").groupBy("user_id").agg(F.avg("value").alias("m")).select(
        "user_id", F.when(even, "regression").otherwise("binary").alias("task_type"),
        F.round(F.when(even, F.col("m") / 9.7 - 2).otherwise(F.col("m") / 24.7), 4).alias("score"))
    return ops.utility_floor(scores)


VERDICT_SQL = f"""{GATE_SQL},
cls as (select user_id, target, count(*) as n from g where target is not null group by all),
cs as (select user_id, count(*) as n_classes, min(n) as least from cls group by user_id),
st as (select user_id, count(*) as n, {_CONST} as const, case when count(f0) = 0 then 'f0' when count(f1) = 0 then 'f1' when count(f2) = 0 then 'f2' end as nul,
  any_value(task_type) as task_type, 1 - count(distinct (round(f0 / 100) is null, coalesce(f2, -1), coalesce(target, '?'))) / count(*) as dup from g group by user_id),
verdict as (select user_id, coalesce(case when const is not null then 'gate_fail: constant column ' || const end,
  case when nul is not null then 'gate_fail: all-null column ' || nul end,
  case when task_type = 'multiclass' and coalesce(n_classes, 0) < 2 then 'gate_fail: target has < 2 classes' end,
  case when task_type = 'multiclass' and least / n < 0.01 then printf('gate_fail: minority_frac=%.4f', least / n) end,
  case when dup >= 0.50 and user_id % 4 <> 1 then printf('gate_fail: dupe_frac=%.2f', dup) end,
  case when n < 60 then 'gate_fail: only ' || n || ' rows' end, '') as reason from st left join cs using (user_id))"""


def verdicts(spark, sf):
    # users with id % 4 = 1 get a column that makes their rows unique
    df = datasets(spark, sf)
    unique = F.when(F.col("user_id") % 4 == 1, F.col("event_id")).otherwise(0)
    df = df.withColumn("mark", unique)
    return ops.gate_verdict(df, ["user_id"], "target", "task_type", ["f0", "f1", "f2"], ["f0", "f1", "f2", "target"],
                            min_rows=60, duplicate_columns=["f2", "target", "mark"])


@query("j10_gate_verdict", f"with {VERDICT_SQL} select user_id, reason = '' as passed, reason from verdict")
def j10(spark, sf):
    return verdicts(spark, sf)


INGEST_SQL = f"""{VERDICT_SQL},
t as (select user_id, if(user_id % 11 = 5, 0, count(*)) as n_rows, if(user_id % 11 = 6, 2, 5) as n_cols, if(user_id % 11 = 7, null, 'target') as target_column,
  if(user_id % 11 = 8, 'only 1 features', null) as encode_error, avg(value) / 40 as score from events group by user_id),
ing as (select t.user_id, score, reason, encode_error, n_rows, n_cols, case when n_rows = 0 then 'empty' when n_rows < 55 then 'too_small' when n_cols < 3 then 'too_few_cols'
  when target_column is null then 'no_target' when encode_error is not null then 'encode_failed' when reason <> '' then 'gate_fail' else 'ok' end as status
  from t join verdict using (user_id))"""


def ingested(spark, sf):
    eleven = F.col("user_id") % 11
    facts = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m")).select(
        "user_id", F.when(eleven == 5, 0).otherwise(F.col("n")).alias("n_rows"), F.when(eleven == 6, 2).otherwise(5).alias("n_cols"),
        F.when(eleven != 7, "target").alias("target_column"), F.when(eleven == 8, "only 1 features").alias("encode_error"),
        (F.col("m") / 40).alias("score"))
    joined = facts.join(verdicts(spark, sf).select("user_id", "reason"), "user_id")
    return ops.ingest_verdict(joined, "n_rows", "n_cols", "target_column", "encode_error", "reason", min_rows=55)


@query("j11_ingest_verdict", f"""
with {INGEST_SQL} select user_id, status, case status when 'empty' then 'no rows' when 'too_small' then 'only ' || n_rows || ' rows'
  when 'too_few_cols' then 'only ' || n_cols || ' columns' when 'no_target' then 'could not identify target column'
  when 'encode_failed' then encode_error when 'gate_fail' then reason end as error from ing""")
def j11(spark, sf):
    return ingested(spark, sf).select("user_id", "status", "error")


@query("j12_gate_report", f"""
with {INGEST_SQL} select user_id % 4 as run, count_if(status = 'ok')::bigint as n_ok, count_if(status = 'gate_fail')::bigint as n_gate_fail,
  count_if(status not in ('ok', 'gate_fail'))::bigint as n_error, round(coalesce(avg(score) filter (where status = 'ok' and score > 0), 0), 6) as mean_score
from ing group by 1""")
def j12(spark, sf):
    report = ops.gate_report(ingested(spark, sf).withColumn("run", F.col("user_id") % 4), ["run"])
    return report.withColumn("mean_score", F.round("mean_score", 6))
