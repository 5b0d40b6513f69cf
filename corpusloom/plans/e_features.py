"""Queries for section E: feature transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import features as ops
from corpusloom.session import new_run_dir
from .registry import query, table

EV_SQL = """ev as (select event_id, case when event_id % 11 = 0 then null else value end as value,
  case when event_id % 13 = 0 then null else floor(value / 10)::bigint::varchar end as bucket, props,
  user_id::varchar as user_text, event_type from events)"""
NUMERIC = ["value"]
CATEGORICAL = ["bucket", "props", "user_text", "event_type"]


def sample_events(spark, sf):
    events = table(spark, sf, "events")
    return events.select(
        "event_id", F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("value"),
        F.when(F.col("event_id") % 13 != 0, F.floor(F.col("value") / 10).cast("string")).alias("bucket"),
        "props", F.col("user_id").cast("string").alias("user_text"), "event_type")


def collapse_sql(column: str) -> str:
    """Scalar rule for one column: (value → keep, frequency) rows and whether it collapses."""
    return f"""{column}_v as (select coalesce({column}, '__MISSING__') as v, count(*) as c,
  count(*) / (select count(*) from ev) as f, count(*) >= greatest(2, floor((select count(*) from ev) * 0.01)) as keep
  from ev group by 1),
{column}_s as (select count(*) as d, count_if(keep) as k, count_if(keep) > 1 and count_if(keep) < count(*) as collapses from {column}_v)"""


@query("e1_missing_indicator", f"""
with {EV_SQL} select event_id, (value is null)::tinyint as value_is_missing, (bucket is null)::tinyint as bucket_is_missing,
  1::tinyint as absent_is_missing from ev""")
def e1(spark, sf):
    df = sample_events(spark, sf)
    spec = ops.TransformSpec(missing=[*ops.fit_missing(df, ["value", "bucket", "props"]), "absent"])
    return ops.apply_transforms(df, spec).select("event_id", "value_is_missing", "bucket_is_missing", "absent_is_missing")


_LOG_FIT = """count({c}) >= 16 and count(distinct {c}) >= 8 and min({c}) >= 0 and max({c}) > 0 and skewness({c}) >= 1.0"""


@query("e2_log1p_transform", f"""
with {EV_SQL}, fit as (select {_LOG_FIT.format(c='value')} as ok from ev),
fit2 as (select {_LOG_FIT.format(c='l_extendedprice')} as price_ok, {_LOG_FIT.format(c='l_quantity')} as quantity_ok from lineitem)
select event_id, round(ln(1 + greatest(coalesce(value, 0), 0)), 6) as value_log1p, price_ok, quantity_ok
from ev, fit, fit2 where ok""")
def e2(spark, sf):
    df = sample_events(spark, sf)
    fitted = ops.fit_log1p(df, ["value", "event_id"])
    other = ops.fit_log1p(table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"])
    out = ops.apply_transforms(df, ops.TransformSpec(log1p=fitted))
    return out.select("event_id", F.round("value_log1p", 6).alias("value_log1p"),
                      F.lit("l_extendedprice" in other).alias("price_ok"), F.lit("l_quantity" in other).alias("quantity_ok"))


@query("e3_rare_category_collapse", f"""
with {EV_SQL}, {collapse_sql('bucket')}, {collapse_sql('props')}, {collapse_sql('user_text')}
select event_id,
  case when (select collapses from bucket_s) then if(b.keep, b.v, '__RARE__') else bucket end as bucket,
  case when (select collapses from props_s) then if(p.keep, p.v, '__RARE__') else props end as props,
  case when (select collapses from user_text_s) then if(u.keep, u.v, '__RARE__') else user_text end as user_text
from ev join bucket_v b on b.v = coalesce(bucket, '__MISSING__') join props_v p on p.v = props
join user_text_v u on u.v = user_text""")
def e3(spark, sf):
    df = sample_events(spark, sf)
    values, collapse, _, _ = ops.fit_categories(df, ["bucket", "props", "user_text"])
    out = ops.apply_transforms(df, ops.TransformSpec(collapse=collapse, values=values))
    return out.select("event_id", "bucket", "props", "user_text")


@query("e4_frequency_encoding", f"""
with {EV_SQL}, {collapse_sql('props')}, {collapse_sql('user_text')}
select event_id, case when (select d >= 32 from props_s) then round(p.f, 8) end as props_frequency,
  case when (select d >= 32 or d / (select count(*) from ev) >= 0.2 from user_text_s) then round(u.f, 8) end as user_text_frequency
from ev join props_v p on p.v = props join user_text_v u on u.v = user_text""")
def e4(spark, sf):
    df = sample_events(spark, sf)
    values, _, frequency, _ = ops.fit_categories(df, ["props", "user_text", "event_type"])
    out = _with_frequencies(ops.apply_transforms(df, ops.TransformSpec(frequency=frequency, values=values)))
    return out.select("event_id", *[F.round(f"{c}_frequency", 8).alias(f"{c}_frequency") for c in ("props", "user_text")])


_E6 = f"""
with {EV_SQL}, {collapse_sql('bucket')}, {collapse_sql('props')}, {collapse_sql('user_text')}
select event_id, round(value, 4) as value, if((select collapses from bucket_s), if(b.keep, b.v, '__RARE__'), bucket) as bucket,
  if((select collapses from props_s), if(p.keep, p.v, '__RARE__'), props) as props, event_type,
  (value is null)::tinyint as value_is_missing,
  (case when (select collapses from bucket_s) then 0 when bucket is null then 1 else 0 end)::tinyint as bucket_is_missing,
  round(ln(1 + greatest(coalesce(value, 0), 0)), 6) as value_log1p,
  case when (select d >= 32 or d / (select count(*) from ev) >= 0.2 from props_s)
    then round(case when (select collapses from props_s) and not p.keep then 0.0 else p.f end, 8) end as props_frequency,
  case when (select d >= 32 or d / (select count(*) from ev) >= 0.2 from user_text_s)
    then round(case when (select collapses from user_text_s) and not u.keep then 0.0 else u.f end, 8) end as user_text_frequency
from ev join bucket_v b on b.v = coalesce(bucket, '__MISSING__') join props_v p on p.v = props
join user_text_v u on u.v = user_text"""


def _with_frequencies(df):
    """Frequency columns are there only if the fit asks for them."""
    absent = [c for c in ("props_frequency", "user_text_frequency") if c not in df.columns]
    return df.withColumns({c: F.lit(None).cast("double") for c in absent}) if absent else df


def _shape(df):
    return _with_frequencies(df).select("event_id", F.round("value", 4).alias("value"), "bucket", "props", "event_type",
                     "value_is_missing", "bucket_is_missing", F.round("value_log1p", 6).alias("value_log1p"),
                     F.round("props_frequency", 8).alias("props_frequency"),
                     F.round("user_text_frequency", 8).alias("user_text_frequency"))


@query("e5_transform_spec_replay", _E6)
def e5(spark, sf):
    df = sample_events(spark, sf)
    path = new_run_dir(spark, "spec")
    ops.fit_transforms(df, NUMERIC, CATEGORICAL).save(spark, path)
    return _shape(ops.apply_transforms(df, ops.TransformSpec.load(spark, path)))


@query("e6_apply_transforms", _E6)
def e6(spark, sf):
    df = sample_events(spark, sf)
    return _shape(ops.apply_transforms(df, ops.fit_transforms(df, NUMERIC, CATEGORICAL)))
