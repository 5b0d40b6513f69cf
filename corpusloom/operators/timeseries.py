"""Calendar, lag, rolling, panel and frequency features, and per-series summaries."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from corpusloom.functions.text import datetime_or_null
from corpusloom.session import stable
from .infer import temporal_columns
from .scale import (compute_once, exact_quantiles, hot_rows, largest_group, lookup_join, ordered_windows, positions,
                    running, small_side)

CALENDAR_PARTS = ("year", "month", "quarter", "week_of_year", "day_of_month", "day_of_week", "hour", "minute",
                  "is_weekend", "is_month_start", "is_month_end", "month_sin", "month_cos", "dow_sin", "dow_cos")


def calendar_features(df: DataFrame, ts: str, prefix: str | None = None, drop_original: bool = False) -> DataFrame:
    """Calendar parts of `ts`; strings are parsed, and a null timestamp gives zeros."""
    at = F.col(ts)
    if isinstance(df.schema[ts].dataType, T.StringType):
        at = datetime_or_null(ts)
    zero = F.lit(0)
    month = F.coalesce(F.month(at), zero)
    weekday = F.coalesce(F.weekday(at), zero)

    def flag(test: Column) -> Column:
        return F.coalesce(test.cast("int"), zero)

    def turn(part: Column, period: int) -> Column:
        return F.lit(2 * math.pi) * part / F.lit(period)

    parts = (F.coalesce(F.year(at), zero), month, F.coalesce(F.quarter(at), zero), F.coalesce(F.weekofyear(at), zero),
             F.coalesce(F.dayofmonth(at), zero), weekday, F.coalesce(F.hour(at), zero), F.coalesce(F.minute(at), zero),
             flag(F.weekday(at) >= 5), flag(F.dayofmonth(at) == 1), flag(F.to_date(at) == F.last_day(at)),
             F.sin(turn(month, 12)), F.cos(turn(month, 12)), F.sin(turn(weekday, 7)), F.cos(turn(weekday, 7)))
    head = (prefix or ts) + "_"
    out = df.withColumns({head + name: part for name, part in zip(CALENDAR_PARTS, parts)})
    return out.drop(ts) if drop_original else out


def lag_columns(value: str, lags: Sequence[int], prefix: str | None = None):
    def build(spec):
        return {f"{prefix or value}_lag{k}": F.lag(value, k).over(spec) for k in lags}
    return build


def _rolling(stat: str, value: str, frame) -> Column:
    x = F.col(value)
    if stat == "mean":
        return F.avg(x).over(frame)
    if stat == "std":
        return F.stddev_samp(x).over(frame)
    if stat == "min":
        return F.min(x).over(frame).cast("double")
    if stat == "max":
        return F.max(x).over(frame).cast("double")
    if stat == "median":
        kept = F.array_sort(F.collect_list(x).over(frame))
        size = F.size(kept)
        low, high = F.get(kept, ((size - 1) / 2).cast("int")), F.get(kept, (size / 2).cast("int"))
        return F.when(size > 0, (low + high) / 2)
    raise ValueError(f"Unknown rolling statistic {stat!r}.")


def rolling_columns(value: str, windows: Sequence[int], stats: Sequence[str] = ("mean", "std", "min", "max"),
                    prefix: str | None = None):
    def build(spec):
        return {f"{prefix or value}_roll{w}_{s}": _rolling(s, value, spec.rowsBetween(-(w - 1), 0))
                for w in windows for s in stats}
    return build


def lag_features(df: DataFrame, value: str, lags: Sequence[int], group: Sequence[str], order: Sequence,
                 prefix: str | None = None) -> DataFrame:
    return ordered_windows(df, group, order, max(lags), lag_columns(value, lags, prefix))


def rolling_features(df: DataFrame, value: str, windows: Sequence[int], group: Sequence[str], order: Sequence,
                     stats: Sequence[str] = ("mean", "std", "min", "max"), prefix: str | None = None) -> DataFrame:
    return ordered_windows(df, group, order, max(windows) - 1, rolling_columns(value, windows, stats, prefix))


def panel_features(df: DataFrame, value: str, entity: str, prefix: str | None = None,
                   hot: int | None = None) -> DataFrame:
    """Entity mean, sample std, count and percentile of the average rank.

    Below the limit one window per entity does it. Above, sums and value counts are aggregated
    and joined back, so a hot entity's rows stay spread out.
    """
    head = prefix or value
    limit = hot_rows(df.sparkSession) if hot is None else hot
    if largest_group(df, [entity]) <= limit:
        mine = W.partitionBy(entity)
        tied = W.partitionBy(entity, value)
        count = F.count(value).over(mine)
        # nulls sort last, so they do not shift the ranks of values
        rank = F.rank().over(mine.orderBy(F.asc_nulls_last(value))) + (F.count(value).over(tied) - 1) / 2
        return df.withColumns({
            f"{head}_entity_mean": F.avg(value).over(mine),
            f"{head}_entity_std": F.coalesce(F.stddev_samp(value).over(mine), F.lit(0.0)),
            f"{head}_entity_count": count,
            f"{head}_entity_rank": F.when(F.col(value).isNotNull(), rank / count)})
    stats = df.groupBy(entity).agg(F.avg(value).alias(f"{head}_entity_mean"),
                                   F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias(f"{head}_entity_std"),
                                   F.count(value).alias(f"{head}_entity_count"))
    counts = df.filter(F.col(value).isNotNull()).groupBy(entity, value).agg(F.count(F.lit(1)).alias("__w"))
    ranks = running(counts, [entity], [value], "__w", "__cum", hot=limit)
    ranks = ranks.select(entity, value, (F.col("__cum") - (F.col("__w") - 1) / 2).alias("__rank"))
    out = lookup_join(lookup_join(df, stats, [entity]), ranks, [entity, value])
    share = F.col("__rank") / F.col(f"{head}_entity_count")
    return out.withColumn(f"{head}_entity_rank", share).drop("__rank")


def _spectrum_rows(entity: str, value: str, order: Sequence[str], k: int):
    def run(rows: pa.Table) -> pa.Table:
        ranks = pc.sort_indices(rows.select(list(order)), sort_keys=[(c, "ascending") for c in order])
        x = rows.column(value).cast(pa.float64()).take(ranks).to_numpy()
        x = x[~np.isnan(x)]
        bins = np.zeros(k)
        if len(x) >= 4:
            size = np.abs(np.fft.rfft(x - x.mean()))
            top = size.max()
            head = (size / top if top > 0 else size)[1:k + 1]
            bins[:len(head)] = head
        return pa.table([rows.column(entity).slice(0, 1), *[pa.array([x]) for x in bins]], names=[entity, *[f"fft_{i}" for i in range(k)]])
    return run


def _transform_stage(entity: str, axis: str, length: str, forward: bool, twiddle: bool):
    """One stage of a two-stage transform: FFT along `__a` within a fixed other index."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf[length].iloc[0])
        m = int(pdf["__m"].iloc[0])
        fixed = int(pdf[axis].iloc[0])
        z = np.zeros(n, dtype=complex)
        z[pdf["__a"].to_numpy()] = pdf["__re"].to_numpy() + 1j * pdf["__im"].to_numpy()
        z = np.fft.fft(z) if forward else np.fft.ifft(z) * n
        index = np.arange(n)
        if twiddle:
            angle = 2 * np.pi * ((index * fixed) % m) / m
            z = z * np.exp(-1j * angle if forward else 1j * angle)
        return pd.DataFrame({entity: pdf[entity].iloc[0], "__fixed": fixed, "__k": index, "__re": z.real, "__im": z.imag})
    return run


def _distributed_fft(df: DataFrame, entity: str, forward: bool = True) -> DataFrame:
    """FFT of length `__m = __n1 * __n2` per entity over rows (entity, __t, __re, __im); missing __t are
    zero. Each task transforms about sqrt(m) points, so the series is never in one place."""
    kind = df.schema[entity].dataType.simpleString()
    out = f"`{entity}` {kind}, __fixed bigint, __k bigint, __re double, __im double"
    sizes = small_side(df.select(entity, "__m", "__n1", "__n2").distinct())
    first = df.withColumns({"__a": F.floor(F.col("__t") / F.col("__n2")).cast("bigint"), "__b": F.col("__t") % F.col("__n2")})
    first = first.groupBy(entity, "__b").applyInPandas(_transform_stage(entity, "__b", "__n1", forward, True), out)
    second = first.select(entity, F.col("__fixed").alias("__a"), F.col("__k").alias("__b"), "__re", "__im")
    second = lookup_join(second, sizes, [entity], checked=True)
    second = second.groupBy(entity, "__b").applyInPandas(_transform_stage(entity, "__b", "__n2", forward, False), out)
    second = lookup_join(second, sizes, [entity], checked=True)
    spot = F.col("__fixed") + F.col("__n1") * F.col("__k")
    scale = F.lit(1.0) if forward else 1 / F.col("__m")
    return second.select(entity, spot.alias("__t"), (F.col("__re") * scale).alias("__re"), (F.col("__im") * scale).alias("__im"),
                         "__m", "__n1", "__n2")


def _long_series_spectrum(df: DataFrame, value: str, entity: str, order: Sequence[str], k: int, hot: int) -> DataFrame:
    """Same numbers as `_spectrum_rows` for series too long for one task: a chirp transform turns
    the length-n spectrum into power-of-two transforms that are spread over many tasks. Entities with
    fewer than four values have no row here."""
    number = F.col(value).cast("double")
    rows = df.filter(number.isNotNull() & ~F.isnan(number)).select(entity, *[c for c in order if c != entity], number.alias("__x"))
    placed = positions(rows, [entity], list(order), "__pos", hot=hot)
    stats = placed.groupBy(entity).agg(F.count(F.lit(1)).alias("__n"), F.avg("__x").alias("__mean")).filter("__n >= 4")
    bits = F.ceil(F.log2(2 * F.col("__n") - 1)).cast("int")
    stats = stats.withColumn("__m", F.pow(F.lit(2.0), bits).cast("bigint"))
    stats = stats.withColumn("__n1", F.pow(F.lit(2.0), F.floor(bits / 2)).cast("bigint"))
    stats = small_side(stats.withColumn("__n2", (F.col("__m") / F.col("__n1")).cast("bigint")))
    size = ["__m", "__n1", "__n2"]

    def chirp(t: Column) -> Column:
        return F.lit(math.pi) * ((t * t) % (2 * F.col("__n"))) / F.col("__n")

    points = lookup_join(placed, stats, [entity], how="inner", checked=True).withColumn("__t", F.col("__pos") - 1)
    x = F.col("__x") - F.col("__mean")
    signal = points.select(entity, "__t", (x * F.cos(chirp(F.col("__t")))).alias("__re"),
                           (-x * F.sin(chirp(F.col("__t")))).alias("__im"), *size)
    both = F.when(F.col("__t") == 0, F.array(F.col("__t"))).otherwise(F.array(F.col("__t"), F.col("__m") - F.col("__t")))
    kernel = points.select(entity, F.explode(both).alias("__u"), F.cos(chirp(F.col("__t"))).alias("__re"),
                           F.sin(chirp(F.col("__t"))).alias("__im"), *size).withColumnRenamed("__u", "__t")
    left = _distributed_fft(signal, entity)
    right = _distributed_fft(kernel, entity).select(entity, "__t", F.col("__re").alias("__re2"), F.col("__im").alias("__im2"))
    right = right.withColumnsRenamed({entity: "__entity", "__t": "__place"})
    same = F.col(entity).eqNullSafe(F.col("__entity")) & (F.col("__t") == F.col("__place"))
    product = left.join(right, same).select(
        entity, "__t", (F.col("__re") * F.col("__re2") - F.col("__im") * F.col("__im2")).alias("__re"),
        (F.col("__re") * F.col("__im2") + F.col("__im") * F.col("__re2")).alias("__im"), *size)
    folded = _distributed_fft(product, entity, forward=False)
    folded = lookup_join(folded, stats.select(entity, "__n"), [entity], checked=False)
    bins = folded.filter(F.col("__t") <= F.floor(F.col("__n") / 2))
    size_of = F.sqrt(F.col("__re") * F.col("__re") + F.col("__im") * F.col("__im"))
    picks = [F.max(F.when(F.col("__t") == i + 1, size_of)).alias(f"fft_{i}") for i in range(k)]
    found = bins.groupBy(entity).agg(F.max(size_of).alias("__top"), *picks)
    return found.select(entity, *[F.coalesce(F.when(F.col("__top") > 0, F.col(f"fft_{i}") / F.col("__top"))
                                             .otherwise(F.col(f"fft_{i}")), F.lit(0.0)).alias(f"fft_{i}") for i in range(k)])


def fft_table(df: DataFrame, value: str, entity: str, order: Sequence[str], k: int = 10,
              hot: int | None = None) -> DataFrame:
    """Magnitudes of bins 1…k of each series, relative to its largest bin."""
    limit = hot_rows(df.sparkSession) if hot is None else hot
    slim = df.select(*dict.fromkeys([entity, value, *order]))
    kind = df.schema[entity].dataType.simpleString()
    out = f"`{entity}` {kind}, " + ", ".join(f"fft_{i} double" for i in range(k))
    run = _spectrum_rows(entity, value, order, k)
    if largest_group(slim, [entity]) <= limit:
        return slim.groupBy(entity).applyInArrow(run, out)
    names = compute_once(slim.groupBy(entity).count().filter(F.col("count") > limit).select(entity))
    heavy = small_side(names)
    short = lookup_join(slim, heavy, [entity], how="left_anti", checked=True)
    long = lookup_join(slim, heavy, [entity], how="left_semi", checked=True)
    found = lookup_join(names, _long_series_spectrum(long, value, entity, order, k, limit), [entity])
    return short.groupBy(entity).applyInArrow(run, out).unionByName(found.fillna(0.0, [f"fft_{i}" for i in range(k)]))


def fft_features(df: DataFrame, value: str, entity: str | None, order: Sequence[str], k: int = 10) -> DataFrame:
    """Join each series' spectrum back to its rows; without an entity the table is one series."""
    key = entity or "__all"
    work = df if entity else df.withColumn("__all", F.lit(0))
    # the spectra are worked out once, and not again for the check of their size
    out = lookup_join(work, stable(fft_table(work, value, key, order, k)), [key])
    return out if entity else out.drop("__all")


def timeseries_to_table(df: DataFrame, ts: str, value: str | None, entity: str | None = None,
                        key: Sequence[str] = (), lags: Sequence[int] = (1, 7, 14), windows: Sequence[int] = (7, 28),
                        stats: Sequence[str] = ("mean", "std", "min", "max"), add_calendar: bool = True,
                        add_panel: bool = True, fft_components: int = 10, drop_datetime: bool = True,
                        drop_null_rows: bool = False) -> DataFrame:
    """All features of one long table. `key` breaks ties of equal timestamps. Lag and rolling
    columns share one shuffle on the entity."""
    out = calendar_features(df, ts) if add_calendar else df
    order, groups = [ts, *key], [entity] if entity else []
    if value:
        builders = [b for b in (lag_columns(value, lags) if lags else None,
                                rolling_columns(value, windows, stats) if windows else None) if b]
        back = max([*lags, *[w - 1 for w in windows]], default=0)
        if builders:
            out = ordered_windows(out, groups, order, back, lambda spec: {k: v for b in builders for k, v in b(spec).items()})
        if add_panel and entity:
            out = panel_features(out, value, entity)
        if fft_components > 0:
            out = fft_features(out, value, entity, order, fft_components)
    if drop_datetime:
        out = out.drop(ts)
    return out.dropna() if drop_null_rows else out


def auto_timeseries(df: DataFrame, key: Sequence[str], value: str | None = None, lags: Sequence[int] = (1, 7, 14),
                    windows: Sequence[int] = (7, 28), drop_datetime: bool = True, **options) -> DataFrame:
    """Pick the first temporal column and the first other numeric column, then add all features.
    A table without a temporal column comes back unchanged."""
    found = temporal_columns(df)
    if not found:
        return df
    ts = found[0]
    if value is None:
        numeric = [f.name for f in df.schema.fields if f.name != ts and isinstance(f.dataType, T.NumericType)]
        value = numeric[0] if numeric else None
    return timeseries_to_table(df, ts, value, None, key, lags, windows, drop_datetime=drop_datetime, **options)


def series_summary(df: DataFrame, value: str, entity: str, order: Sequence[str]) -> DataFrame:
    """One row of shape statistics per series. Group sums are combined map-side; quantiles and
    positions go through the skew-safe helpers."""
    x = F.col(value)
    slim = df.select(*dict.fromkeys([entity, value, *order])).filter(x.isNotNull())
    placed = ordered_windows(slim, [entity], order, 2, lag_columns(value, (1, 2), "__x"))
    placed = positions(placed, [entity], order, "__pos")
    base = slim.groupBy(entity).agg(F.avg(x).alias("__mean"), F.stddev_pop(x).alias("__sd"))
    rows = lookup_join(placed, base, [entity])
    std = F.col("__sd") + F.lit(1e-8)
    z = (x - F.col("__mean")) / std
    t = (F.col("__pos") - 1).cast("double")
    when_lag = F.col("__x_lag1").isNotNull()

    def autocorrelation(lag: str, name: str, least: int) -> Column:
        both = F.col(lag).isNotNull()
        now, then = F.when(both, x), F.col(lag)
        value_ = F.try_divide(F.covar_pop(now, then), F.stddev_pop(now) * F.stddev_pop(then))
        return F.when(F.count(F.lit(1)) > least, value_).otherwise(F.lit(0.0)).alias(name)

    crossing = F.sum(F.when(when_lag & (F.signum(x - F.col("__mean")) != F.signum(F.col("__x_lag1") - F.col("__mean"))), 1)
                     .otherwise(0))
    first, last = F.min_by(x, F.col("__pos")), F.max_by(x, F.col("__pos"))
    summary = rows.groupBy(entity).agg(
        F.first("__mean").alias("ts_mean"), F.first(std).alias("ts_std"), F.min(x).alias("ts_min"), F.max(x).alias("ts_max"),
        (F.max(x) - F.min(x)).alias("ts_range"), F.avg(F.pow(z, 3)).alias("ts_skewness"),
        (F.avg(F.pow(z, 4)) - 3).alias("ts_kurtosis"),
        (F.covar_pop(t, x) / (F.var_pop(t) + F.lit(1e-8))).alias("ts_trend_slope"),
        autocorrelation("__x_lag1", "ts_acf1", 1), autocorrelation("__x_lag2", "ts_acf2", 2),
        F.avg(x * x).alias("ts_energy"),
        (crossing / F.greatest(F.count(F.lit(1)) - 1, F.lit(1))).alias("ts_zero_crossing_rate"),
        first.alias("ts_first"), last.alias("ts_last"), (last - first).alias("ts_change"))
    quartiles = exact_quantiles(slim, [entity], [value], [0.25, 0.5, 0.75]).select(
        entity, F.col(value)[0].alias("ts_q25"), F.col(value)[1].alias("ts_median"), F.col(value)[2].alias("ts_q75"),
        (F.col(value)[2] - F.col(value)[0]).alias("ts_iqr"))
    return lookup_join(summary, quartiles, [entity])
