import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import timeseries as ops


@pytest.fixture(scope="module")
def series(spark):
    rows = []
    for i in range(260):
        user = 0 if i % 3 else 1 + i % 4
        rows.append((user, i, f"2024-01-{i % 28 + 1:02d} 0{i % 10}:00:00", float((i * 31) % 17) + i / 100 if i % 9 else None))
    return spark.createDataFrame(rows, "user bigint, id bigint, ts string, x double")


def test_panel_hot_path(series):
    columns = ["id", *[F.round(f"x_entity_{c}", 9).alias(c) for c in ("mean", "std", "count", "rank")]]
    plain = ops.panel_features(series, "x", "user").select(*columns).collect()
    split = ops.panel_features(series, "x", "user", hot=20).select(*columns).collect()
    assert sorted(plain, key=repr) == sorted(split, key=repr)
    pdf = series.toPandas()
    rank = pdf.groupby("user")["x"].rank(pct=True)
    expected = dict(zip(pdf["id"], rank))
    for r in plain:
        assert r["rank"] == pytest.approx(expected[r.id]) if not np.isnan(expected[r.id]) else r["rank"] is None


@pytest.mark.parametrize("limit", [10**6, 30])
def test_spectrum_matches_numpy(series, limit):
    found = {r["user"]: r for r in ops.fft_table(series, "x", "user", ["id"], k=6, hot=limit).collect()}
    for user, part in series.toPandas().sort_values("id").groupby("user"):
        x = part["x"].dropna().to_numpy()
        size = np.abs(np.fft.rfft(x - x.mean()))
        want = (size / size.max())[1:7]
        want = np.pad(want, (0, 6 - len(want)))
        assert np.allclose([found[user][f"fft_{i}"] for i in range(6)], want, atol=1e-9)


def test_long_series_without_entity_or_values(spark):
    rows = [(u, i, float("nan") if i == 9 and u != 3 else float((i * 7) % 11) if u in (1, None) or (u == 3 and i < 3) else None) for u in (1, None, 2, 3) for i in range(50)]
    df = spark.createDataFrame(rows, "u int, i int, x double")
    plain, hot = ({r.u: [round(r[f"fft_{j}"], 9) for j in range(4)] for r in ops.fft_table(df, "x", "u", ["i"], k=4, hot=h).collect()}
                  for h in (1000, 6))
    assert plain.keys() == hot.keys() == {1, None, 2, 3}
    assert plain == hot and plain[2] == plain[3] == [0.0] * 4 and plain[None] == plain[1]


def test_short_series_have_no_spectrum(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(3)], "u int, i int, x double")
    assert [ops.fft_table(df, "x", "u", ["i"], k=3).first()[f"fft_{i}"] for i in range(3)] == [0.0, 0.0, 0.0]


def test_rolling_matches_pandas(series):
    out = ops.rolling_features(series, "x", [4], ["user"], ["id"], stats=["mean", "std", "median"]).toPandas().sort_values(["user", "id"])
    pdf = series.toPandas().sort_values(["user", "id"])
    for stat in ("mean", "std", "median"):
        want = getattr(pdf.groupby("user")["x"].rolling(4, min_periods=1), stat)().to_numpy()
        assert np.allclose(out[f"x_roll4_{stat}"].to_numpy(dtype=float), want, equal_nan=True)


def test_summary_matches_numpy(series, spark, hot):
    found = {r["user"]: r for r in ops.series_summary(series, "x", "user", ["id"]).collect()}
    for user, part in series.toPandas().sort_values("id").groupby("user"):
        x = part["x"].dropna().to_numpy()
        r = found[user]
        assert r.ts_median == pytest.approx(np.median(x)) and r.ts_q25 == pytest.approx(np.percentile(x, 25))
        assert r.ts_acf1 == pytest.approx(np.corrcoef(x[:-1], x[1:])[0, 1])
        assert r.ts_acf2 == pytest.approx(np.corrcoef(x[:-2], x[2:])[0, 1])
        t = np.arange(len(x))
        assert r.ts_trend_slope == pytest.approx(np.cov(t, x, bias=True)[0, 1] / (t.var() + 1e-8))
        assert r.ts_zero_crossing_rate == pytest.approx(np.sum(np.diff(np.sign(x - x.mean())) != 0) / (len(x) - 1))
        assert (r.ts_first, r.ts_last) == (x[0], x[-1])


def test_calendar_of_null(spark):
    df = spark.createDataFrame([(None,), ("2024-02-29 13:45:00",), ("2024-06-01",)], "ts string")
    rows = ops.calendar_features(df, "ts").collect()
    assert (rows[0].ts_year, rows[0].ts_month_sin, rows[0].ts_month_cos, rows[0].ts_is_month_end) == (0, 0.0, 1.0, 0)
    assert (rows[1].ts_is_month_end, rows[1].ts_day_of_week, rows[1].ts_hour, rows[1].ts_week_of_year) == (1, 3, 13, 9)
    assert (rows[2].ts_is_month_start, rows[2].ts_is_weekend) == (1, 1)


def test_auto_without_time_is_unchanged(spark):
    df = spark.createDataFrame([(1.0, "a")], "x double, s string")
    assert ops.auto_timeseries(df, ["x"]).columns == ["x", "s"]


def test_auto_picks_columns(series):
    out = ops.auto_timeseries(series.drop("user"), ["id"], value="x", lags=[1], windows=[2], fft_components=2)
    assert "ts" not in out.columns and {"x_lag1", "x_roll2_std", "fft_1", "ts_month"} <= set(out.columns)


def test_spectra_are_worked_out_once(spark, series, monkeypatch):
    runs, plain = spark.sparkContext.accumulator(0), ops._spectrum_rows

    def counted(*args):
        run = plain(*args)

        def one(rows):
            runs.add(1)
            return run(rows)
        return one

    monkeypatch.setattr(ops, "_spectrum_rows", counted)
    ops.fft_features(series, "x", "user", ["id"], k=4).collect()
    assert runs.value == series.select("user").distinct().count()
