"""Queries for section G: time-series features."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import augment, timeseries as ops
from .registry import low_limits, query, table


def _calendar_sql(ts: str, head: str) -> str:
    pi2 = "2 * pi()"
    return f"""coalesce(year({ts}), 0)::int as {head}year, coalesce(month({ts}), 0)::int as {head}month,
  coalesce(quarter({ts}), 0)::int as {head}quarter, coalesce(week({ts}), 0)::int as {head}week_of_year,
  coalesce(day({ts}), 0)::int as {head}day_of_month, coalesce(isodow({ts}) - 1, 0)::int as {head}day_of_week,
  coalesce(hour({ts}), 0)::int as {head}hour, coalesce(minute({ts}), 0)::int as {head}minute,
  coalesce((isodow({ts}) >= 6)::int, 0) as {head}is_weekend, coalesce((day({ts}) = 1)::int, 0) as {head}is_month_start,
  coalesce(({ts}::date = last_day({ts}))::int, 0) as {head}is_month_end,
  round(sin({pi2} * coalesce(month({ts}), 0) / 12), 6) as {head}month_sin, round(cos({pi2} * coalesce(month({ts}), 0) / 12), 6) as {head}month_cos,
  round(sin({pi2} * coalesce(isodow({ts}) - 1, 0) / 7), 6) as {head}dow_sin, round(cos({pi2} * coalesce(isodow({ts}) - 1, 0) / 7), 6) as {head}dow_cos"""


def _rounded(df, skip=()):
    return df.select(*[F.round(F.col(f.name), 6).alias(f.name) if f.dataType.simpleString() == "double" and f.name not in skip
                       else F.col(f.name) for f in df.schema.fields])


@query("g1_calendar_features", f"""
select o_orderkey, {_calendar_sql("t", "d_")} from (select o_orderkey, case when o_orderkey % 17 = 0 then null
  else o_orderdate + interval 90 minute end as t from orders)""")
def g1(spark, sf):
    shifted = F.when(F.col("o_orderkey") % 17 != 0, F.col("o_orderdate") + F.expr("interval 90 minutes"))
    orders = table(spark, sf, "orders").select("o_orderkey", shifted.alias("t"))
    return _rounded(ops.calendar_features(orders, "t", prefix="d", drop_original=True))


@query("g1_calendar_events", f"select event_id, {_calendar_sql('ts', 'ts_')} from events")
def g1_events(spark, sf):
    events = table(spark, sf, "events").select("event_id", F.col("ts").cast("string").alias("ts"))
    return _rounded(ops.calendar_features(events, "ts", drop_original=True))


_X = "case when event_id % 10 = 0 then null else value end"


def events(spark, sf):
    """Events with a null in every tenth value."""
    df = table(spark, sf, "events").select("event_id", "ts", "user_id", "value")
    return df.withColumn("value", F.when(F.col("event_id") % 10 != 0, F.col("value")))


@query("g2_lag_features", f"""
select event_id, lag({_X}, 1) over w as value_lag1, lag({_X}, 7) over w as value_lag7 from events
window w as (partition by user_id order by ts, event_id)""")
def g2(spark, sf):
    out = ops.lag_features(events(spark, sf), "value", [1, 7], ["user_id"], ["ts", "event_id"])
    return out.select("event_id", "value_lag1", "value_lag7")


def _frame(w: int) -> str:
    return f"(partition by user_id order by ts, event_id rows between {w - 1} preceding and current row)"


def _rolling_sql(w: int, median: bool = True) -> str:
    stats = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max", "median": "median"}
    return ", ".join(f"round({f}(x) over {_frame(w)}, 6) as value_roll{w}_{s}" for s, f in stats.items()
                     if median or s != "median")


@query("g3_rolling_features", f"""
with e as (select *, {_X} as x from events) select event_id, {_rolling_sql(7)}, {_rolling_sql(28)} from e""")
def g3(spark, sf):
    out = ops.rolling_features(events(spark, sf), "value", [7, 28], ["user_id"], ["ts", "event_id"],
                               stats=["mean", "std", "min", "max", "median"])
    return _rounded(out.drop("ts", "user_id", "value"))


_PANEL = """round(avg(x) over (partition by user_id), 6) as value_entity_mean,
  round(coalesce(stddev_samp(x) over (partition by user_id), 0), 6) as value_entity_std,
  count(x) over (partition by user_id) as value_entity_count,
  case when x is not null then round((rank() over (partition by user_id order by x nulls last)
    + (count(x) over (partition by user_id, x) - 1) / 2) / count(x) over (partition by user_id), 6) end as value_entity_rank"""


@query("g4_panel_features", f"""
with e as (select event_id, user_id, round({_X}, 0) as x from events) select event_id, {_PANEL} from e""")
def g4(spark, sf):
    df = events(spark, sf).withColumn("value", F.round("value", 0))
    return _rounded(ops.panel_features(df, "value", "user_id").drop("ts", "user_id", "value"))


_DFT = f"""
series as (select user_id, x - avg(x) over (partition by user_id) as x, row_number() over (partition by user_id order by ts, event_id) - 1 as t,
  count(*) over (partition by user_id) as n from (select *, {_X} as x from events) where x is not null),
bins as (select user_id, k, sqrt(pow(sum(x * cos(2 * pi() * k * t / n)), 2) + pow(sum(x * sin(2 * pi() * k * t / n)), 2)) as size
  from series join (select user_id as u, unnest(range(0, count(*) // 2 + 1)) as k from series group by user_id) on u = user_id
  group by user_id, k),
tops as (select user_id, max(size) as top from bins group by user_id)"""


@query("g5_fft_features", f"""
with {_DFT},
spectra as (select user_id, k - 1 as bin, size / top as size from bins join tops using (user_id) where k between 1 and 4)
select event_id, {", ".join(f"(select round(size, 6) from spectra s where s.user_id = e.user_id and bin = {i}) as fft_{i}" for i in range(4))}
from events e""")
def g5(spark, sf):
    out = ops.fft_features(events(spark, sf), "value", "user_id", ["ts", "event_id"], k=4)
    return _rounded(out.select("event_id", *[f"fft_{i}" for i in range(4)]))


@query("g5_fft_features_hot", f"""
with src as (select event_id, ts, nullif(user_id % 4, 1) as user_id, if(user_id % 4 <> 2 and event_id % 17 <> 3, value, null) as value from events),
{_DFT.replace(_X, "value").replace("from events", "from src").replace("on u = user_id", "on u is not distinct from user_id")},
spectra as (select bins.user_id, k - 1 as bin, size / top as size from bins join tops on bins.user_id is not distinct from tops.user_id where k between 1 and 4)
select event_id, {", ".join(f"coalesce((select round(size, 6) from spectra s where s.user_id is not distinct from e.user_id and bin = {i}), 0) as fft_{i}" for i in range(4))}
from src e""")
def g5_hot(spark, sf):
    """Every series is spread over tasks; one has no entity, one has no values."""
    user = F.col("user_id") % 4
    src = table(spark, sf, "events").withColumns({
        "user_id": F.nullif(user, F.lit(1)), "value": F.when((user != 2) & (F.col("event_id") % 17 != 3), F.col("value"))})
    with low_limits(spark, 20):
        out = ops.fft_features(src, "value", "user_id", ["ts", "event_id"], k=4)
    return _rounded(out.select("event_id", *[f"fft_{i}" for i in range(4)]))


@query("g6_timeseries_to_table", f"""
with e as (select *, {_X} as x from events),
f as (select event_id, user_id, x as value, {_calendar_sql("ts", "ts_")}, lag(x, 1) over w as value_lag1, lag(x, 3) over w as value_lag3,
  {_rolling_sql(5, median=False)}, {_PANEL} from e window w as (partition by user_id order by ts, event_id))
select * from f where value is not null and value_lag1 is not null and value_lag3 is not null and value_roll5_std is not null""")
def g6(spark, sf):
    out = ops.timeseries_to_table(events(spark, sf), "ts", "value", "user_id", ["event_id"], lags=[1, 3], windows=[5],
                                  fft_components=0, drop_null_rows=True)
    return _rounded(out)


@query("g7_auto_timeseries", f"""
select event_id, value, lag(value, 1) over (order by ts, event_id) as value_lag1,
  round(avg(value) over (order by ts, event_id rows between 2 preceding and current row), 6) as value_roll3_mean,
  hour(ts)::int as ts_hour from events""")
def g7(spark, sf):
    df = table(spark, sf, "events").select("ts", "value", "event_id")
    out = ops.auto_timeseries(df, ["event_id"], lags=[1], windows=[3], fft_components=0)
    return _rounded(out.select("event_id", "value", "value_lag1", "value_roll3_mean", "ts_hour"))


_SUMMARY = """
s as (select user_id, value as x, row_number() over (partition by user_id order by ts, event_id) - 1 as t,
  lag(value, 1) over (partition by user_id order by ts, event_id) as x1, lag(value, 2) over (partition by user_id order by ts, event_id) as x2
  from events),
b as (select user_id, avg(x) as mean, stddev_pop(x) + 1e-8 as sd from s group by user_id),
summary as (select user_id, any_value(mean) as ts_mean, any_value(sd) as ts_std, min(x) as ts_min, max(x) as ts_max,
  max(x) - min(x) as ts_range, median(x) as ts_median, quantile_cont(x, 0.25) as ts_q25, quantile_cont(x, 0.75) as ts_q75,
  quantile_cont(x, 0.75) - quantile_cont(x, 0.25) as ts_iqr, avg(pow((x - mean) / sd, 3)) as ts_skewness,
  avg(pow((x - mean) / sd, 4)) - 3 as ts_kurtosis, covar_pop(t, x) / (var_pop(t) + 1e-8) as ts_trend_slope,
  case when count(*) > 1 then corr(x1, x) else 0 end as ts_acf1, case when count(*) > 2 then corr(x2, x) else 0 end as ts_acf2,
  avg(x * x) as ts_energy, count(case when sign(x - mean) <> sign(x1 - mean) then 1 end) / greatest(count(*) - 1, 1) as ts_zero_crossing_rate,
  arg_min(x, t) as ts_first, arg_max(x, t) as ts_last, arg_max(x, t) - arg_min(x, t) as ts_change
  from s join b using (user_id) group by user_id)"""
_SUMMARY_COLUMNS = ["ts_mean", "ts_std", "ts_min", "ts_max", "ts_range", "ts_median", "ts_q25", "ts_q75", "ts_iqr",
                    "ts_skewness", "ts_kurtosis", "ts_trend_slope", "ts_acf1", "ts_acf2", "ts_energy",
                    "ts_zero_crossing_rate", "ts_first", "ts_last", "ts_change"]


def summary(spark, sf):
    return ops.series_summary(table(spark, sf, "events"), "value", "user_id", ["ts", "event_id"])


@query("g8_series_summary", f"with {_SUMMARY} select user_id, {', '.join(f'round({c}, 6) as {c}' for c in _SUMMARY_COLUMNS)} from summary")
def g8(spark, sf):
    return summary(spark, sf).select("user_id", *[F.round(c, 6).alias(c) for c in _SUMMARY_COLUMNS])


@query("g8_series_summary_hot", f"with {_SUMMARY} select user_id, {', '.join(f'round({c}, 6) as {c}' for c in _SUMMARY_COLUMNS)} from summary")
def g8_hot(spark, sf):
    with low_limits(spark, 40):
        return g8(spark, sf)


@query("g9_series_label", f"""
with {_SUMMARY}, q as (select median(ts_mean) as m, quantile_cont(ts_mean, 0.25) as a, quantile_cont(ts_mean, 0.5) as b,
  quantile_cont(ts_mean, 0.75) as c from summary)
select user_id, (ts_mean > m)::int as label2, (ts_mean >= a)::int + (ts_mean >= b)::int + (ts_mean >= c)::int as label4,
  round(ts_mean::float::double, 4) as label_value from summary, q""")
def g9(spark, sf):
    means = summary(spark, sf).select("user_id", "ts_mean")
    out = augment.series_label(means, "ts_mean", 2, "label2")
    out = augment.series_label(out, "ts_mean", 4, "label4")
    out = augment.series_label(out, "ts_mean", None, "label_value")
    return out.select("user_id", "label2", "label4", F.round(F.col("label_value").cast("double"), 4).alias("label_value"))
