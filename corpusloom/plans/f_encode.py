"""Queries for section F: frozen schema and encoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.hashing import hash_token
from corpusloom.functions.text import SPACE_CLASS, tokenize_text
from corpusloom.operators import encode as ops, sampling
from corpusloom.operators.infer import ordered_codes
from .c_profile import schema_text_sql
from .d_sampling import split_sql
from .e_features import EV_SQL, sample_events
from .registry import low_limits, query, table
from .sqltext import profile

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def line(spark, sf):
    return table(spark, sf, "lineitem").withColumn("l_discount", F.nullif("l_discount", F.lit(0.0)))


def _stat_sql(c: str, x: str) -> str:
    return f"""select '{c}' as "column", round(any_value(f), 6) as fill, round(avg(coalesce({x}, f)), 6) as mean,
  round(stddev_pop(coalesce({x}, f)), 6) as std from lineitem, (select median({x}) as f from lineitem)"""


@query("f1_numeric_stats", " union all ".join(
    _stat_sql(c, "nullif(l_discount, 0)" if c == "l_discount" else c) for c in LINE_NUMBERS))
def f1(spark, sf):
    df = line(spark, sf)
    stats = ops.numeric_stats(df, LINE_NUMBERS)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.round(F.lit(s[k]), 6).alias(k) for k in ("fill", "mean", "std")])
                     for c, s in stats.items()])
    return spark.range(1).select(F.inline(rows))


@query("f1_numeric_stats_hot", " union all ".join(
    _stat_sql(c, "nullif(l_discount, 0)" if c == "l_discount" else c) for c in LINE_NUMBERS))
def f1_hot(spark, sf):
    with low_limits(spark, 40):
        return f1(spark, sf)


def _schema(spark, sf):
    df = sample_events(spark, sf)
    return df, ops.build_schema(df, "event_type", "multiclass", ["value"], ["bucket", "props", "user_text"])


_VOCAB = """select '{c}' as "column", v as value, (row_number() over (order by v) - 1) as code
  from (select distinct coalesce({c}, '__MISSING__') as v from ev)"""


@query("f2_category_vocabulary", f"with {EV_SQL} " + " union all ".join(_VOCAB.format(c=c) for c in ("bucket", "props", "user_text")))
def f2(spark, sf):
    _, schema = _schema(spark, sf)
    return schema.vocabulary.filter("column <> 'event_type'").select("column", "value", "code")


@query("f3_target_classes", f"with {EV_SQL} {_VOCAB.format(c='event_type')}")
def f3(spark, sf):
    _, schema = _schema(spark, sf)
    return schema.vocabulary.filter("column = 'event_type'").select("column", "value", "code")


@query("f4_encode_numeric", """
with s as (select median(nullif(l_discount, 0)) as f from lineitem),
t as (select avg(coalesce(nullif(l_discount, 0), f)) as m, stddev_pop(coalesce(nullif(l_discount, 0), f)) as sd from lineitem, s),
p as (select avg(l_extendedprice) as pm, stddev_pop(l_extendedprice) as ps from lineitem)
select l_orderkey, l_linenumber, l_partkey, round(((coalesce(nullif(l_discount, 0), f) - m) / sd)::float::double, 4) as discount,
  round(((l_extendedprice - pm) / ps)::float::double, 4) as price from lineitem, s, t, p""")
def f4(spark, sf):
    df = line(spark, sf)
    stats = ops.numeric_stats(df, ["l_discount", "l_extendedprice"])
    x = ops.encode_numeric(df, stats)
    return df.select("l_orderkey", "l_linenumber", "l_partkey",
                     F.round(x["l_discount"].cast("double"), 4).alias("discount"),
                     F.round(x["l_extendedprice"].cast("double"), 4).alias("price"))


@query("f5_encode_categorical", f"""
with {EV_SQL}, vb as (select v, row_number() over (order by v) as i from (select distinct coalesce(bucket, '__MISSING__') as v from ev)),
vp as (select v, row_number() over (order by v) as i from (select distinct props as v from ev)),
late as (select event_id, if(event_id % 3 = 0, 'new ' || bucket, bucket) as bucket, if(event_id % 4 = 0, 'new ' || props, props) as props from ev)
select event_id, coalesce(vb.i, 0) as bucket, coalesce(vp.i, 0) as props,
  coalesce((select i from vb where v = '__MISSING__'), 0) as absent
from late left join vb on vb.v = coalesce(bucket, '__MISSING__') left join vp on vp.v = props""")
def f5(spark, sf):
    df = sample_events(spark, sf).select("event_id", "bucket", "props", "event_type")
    vocabulary = ordered_codes(df.withColumn("absent", F.col("bucket")), ["bucket", "props", "absent"], missing="__MISSING__")
    schema = ops.FrozenSchema("none", "regression", categorical=["bucket", "props", "absent"], vocabulary=vocabulary)
    # rows that come later hold values that the vocabulary has not seen
    late = df.withColumns({"bucket": F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("new "), "bucket")).otherwise(F.col("bucket")),
                           "props": F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("new "), "props")).otherwise(F.col("props"))})
    out = ops.encode(late, schema, keep=["event_id"])
    return out.select("event_id", *[F.col("x_cat")[i].alias(c) for i, c in enumerate(schema.categorical)])


@query("f6_encode_target", f"""
with {EV_SQL} select event_id, (dense_rank() over (order by event_type) - 1) as y from ev""")
def f6(spark, sf):
    df, schema = _schema(spark, sf)
    return ops.encode(df, schema, keep=["event_id"]).select("event_id", "y")


@query("f7_presence_masks", f"""
with {EV_SQL} select event_id, value is not null as value_here, bucket is not null as bucket_here, true as props_here from ev""")
def f7(spark, sf):
    df, schema = _schema(spark, sf)
    out = ops.encode(df, schema, keep=["event_id"])
    return out.select("event_id", F.col("num_mask")[0].alias("value_here"), F.col("cat_mask")[0].alias("bucket_here"),
                      F.col("cat_mask")[1].alias("props_here"))


_TOKEN = "case when {t} = '' then 0 else ('0x' || substr(sha1({t}), 1, 8))::bigint % 8191 + 1 end"


@query("f8_hash_token", f"""
select token, count(*) as n, any_value({_TOKEN.format(t='token')}) as token_id
from (select unnest(string_split(text, ' ')) as token from conversations) group by token""")
def f8(spark, sf):
    words = table(spark, sf, "conversations").select(F.explode(F.split("text", " ")).alias("token"))
    counted = words.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("token_id", hash_token("token"))


_SPACE = SPACE_CLASS.replace(r"\x0B", r"\x{0B}").replace(r"\x1C-\x1F", r"\x{1C}-\x{1F}")


@query("f9_tokenize_text", f"""
with parts as (select doc_id, list_filter(regexp_split_to_array(replace(lower(text), '_', ' '), '{_SPACE}+'), lambda x: x <> '') as p
  from documents)
select doc_id, slot - 1 as slot, case when slot <= len(p) then {_TOKEN.format(t='p[slot]')} else 0 end as token_id
from parts, range(1, 17) t(slot)""")
def f9(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.posexplode(tokenize_text("text")).alias("slot", "token_id")).withColumn(
        "slot", F.col("slot").cast("bigint"))


_FEATURES = profile(f"with {EV_SQL} select * from ev", ["value", "bucket", "props", "user_text"], ["value"])


@query("f10_feature_metadata", f"""{_FEATURES},
ids as (select col, array_to_string(list_transform(list_resize(list_filter(string_split(col, '_'), lambda x: x <> '')[1:4], 4, ''),
  lambda t: ({_TOKEN.format(t='t')})::varchar), ',') as name_ids from prob)
select col as "column", case when prefer_numeric then 'numeric'
    when p3 >= greatest(p2, p4) and (avg_string_length >= 12 or unique_ratio >= 0.25) then 'text' else 'categorical' end as kind,
  name_ids, {schema_text_sql("case when prefer_numeric then 'numeric' else 'categorical' end")} as schema_text,
  round(p2, 6) as p_categorical from prob join ids using (col)""")
def f10(spark, sf):
    _, schema = _schema(spark, sf)
    meta = ops.feature_metadata(schema)
    return meta.select("column", "kind", F.array_join(F.transform("name_ids", lambda t: t.cast("string")), ",").alias("name_ids"),
                       "schema_text", F.round(F.col("profile_vector")[7], 6).alias("p_categorical"))


@query("f11_assemble_batches", """
with b as (select event_id, value, (row_number() over (order by md5('9:' || event_id)) - 1) // 64 as batch_id from events)
select batch_id, count(*) as n, round(avg(value), 6) as mean_value, min(event_id) as first_id from b group by batch_id""")
def f11(spark, sf):
    events = table(spark, sf, "events").select("event_id", "value")
    batches = ops.assemble_batches(events, 64, ["event_id"], seed=9, collect=["event_id", "value"])
    mean = F.aggregate("value", F.lit(0.0), lambda a, x: a + x) / F.size("value")
    return batches.select("batch_id", F.size("event_id").cast("bigint").alias("n"), F.round(mean, 6).alias("mean_value"),
                          F.array_min("event_id").alias("first_id"))


@query("f12_encode_csv", f"""
with src as (select event_id, value, props, event_type from events),
{split_sql('src', 'event_type', 'event_id', '0.2', '0.0')},
rows as (select * exclude (split), case split when 'train' then 'train' else 'val' end as split from split_rows),
s as (select avg(value) as m, stddev_pop(value) as sd from rows where split = 'train')
select event_id, split, round(((value - m) / sd)::float::double, 4) as value, dense_rank() over (order by props) - 1 as props,
  dense_rank() over (order by event_type) - 1 as event_type from rows, s""")
def f12(spark, sf):
    events = table(spark, sf, "events").select("event_id", "value", "props", "event_type")
    rows = sampling.split_table(events, "event_type", "multiclass", ["event_id"], 7, 0.2, 0.0, label="part")
    train, val = (rows.filter(F.col("part") == p).drop("part") for p in ("train", "val"))
    out = ops.encode_csv(train, val, "event_type", "multiclass", ["value"], ["props"])
    return out.withColumn("value", F.round(F.col("value").cast("double"), 4))


@query("f13_dataset_card", f"""
with {split_sql('events', 'event_type', 'event_id', '0.2', '0.5')},
c as (select split, count(*) as n from split_rows group by split)
select '{{"test":' || max(n) filter (where split = 'test') || ',"train":' || max(n) filter (where split = 'train')
  || ',"val":' || max(n) filter (where split = 'val') || '}}' as rows_json, 'events' as title from c""")
def f13(spark, sf):
    rows = sampling.split_table(table(spark, sf, "events").select("event_id", "event_type"), "event_type", "multiclass", ["event_id"])
    card = ops.dataset_card(rows, "split", {"title": "events", "target": "event_type"})
    return card.select(F.get_json_object("card", "$.rows").alias("rows_json"),
                       F.get_json_object(F.get_json_object("card", "$.facts"), "$.title").alias("title"))


@query("f14_content_fingerprint", """
with a as (select user_id, count(*) as n, min(event_id) as first_id from events group by user_id)
select user_id, sha256('{"user_id":' || user_id || ',"n":' || n || ',"first_id":' || first_id || '}') as sha256 from a""")
def f14(spark, sf):
    artifacts = table(spark, sf, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))
    return ops.content_fingerprint(artifacts, ["user_id", "n", "first_id"]).select("user_id", "sha256")
