"""The paths for hot groups must give the same rows as plain windows."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import Window as W, functions as F

from corpusloom.functions.hashing import row_hash
from corpusloom.operators import scale


def pairs(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("how", ["sum", "min", "max"])
@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("groups", [["grp"], []])
def test_running(spark, skewed, how, inclusive, groups):
    plain = scale.running(skewed, groups, ["t", "id"], "x", "r", how, inclusive, hot=10**6)
    split = scale.running(skewed, groups, ["t", "id"], "x", "r", how, inclusive, hot=20)
    assert pairs(plain, "id", "r") == pairs(split, "id", "r")


@pytest.mark.parametrize("groups", [["grp"], []])
def test_positions(spark, skewed, groups):
    split = scale.positions(skewed, groups, [F.desc("t"), "id"], "p", hot=20)
    spec = W.partitionBy(*groups, F.lit(0)).orderBy(F.desc("t"), "id")
    assert pairs(split, "id", "p") == pairs(skewed.withColumn("p", F.row_number().over(spec)), "id", "p")


def test_positions_with_null_group(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "b") for i in range(100)], "id bigint, g string")
    split = scale.positions(df, ["g"], ["id"], "p", hot=10)
    assert pairs(split, "id", "p") == [(i, i // 2 + 1) for i in sorted(range(100), key=lambda i: repr((i, i // 2 + 1)))]


@pytest.mark.parametrize("groups", [["grp"], []])
def test_hash_positions(spark, skewed, groups):
    df = skewed.withColumn("d", row_hash(1, "id"))
    plain = scale.hash_positions(df, groups, "d", "p", hot=10**6)
    split = scale.hash_positions(df, groups, "d", "p", hot=15)
    assert pairs(plain, "id", "p") == pairs(split, "id", "p")


def test_hash_cutoffs(spark, skewed):
    df = skewed.withColumn("d", row_hash(1, "id"))
    bounds = df.groupBy("grp").agg(F.floor(F.count(F.lit(1)) / 3).cast("bigint").alias("b1"), F.count(F.lit(1)).alias("b2"))
    plain = scale.hash_cutoffs(df, ["grp"], "d", bounds, ["b1", "b2"], hot=10**6)
    split = scale.hash_cutoffs(df, ["grp"], "d", bounds, ["b1", "b2"], hot=15)
    assert pairs(plain, "grp", "__cut_b1", "__cut_b2") == pairs(split, "grp", "__cut_b1", "__cut_b2")


@pytest.mark.parametrize("groups", [["grp"], []])
def test_ordered_windows(spark, skewed, groups):
    def build(spec):
        return {"lag3": F.lag("x", 3).over(spec), "mean5": F.round(F.avg("x").over(spec.rowsBetween(-4, 0)), 9)}

    plain = scale.ordered_windows(skewed, groups, ["t", "id"], 4, build, hot=10**6)
    for limit in (7, 60):
        split = scale.ordered_windows(skewed, groups, ["t", "id"], 4, build, hot=limit)
        assert pairs(plain, "id", "lag3", "mean5") == pairs(split, "id", "lag3", "mean5")


def test_exact_quantiles(spark, skewed):
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    pdf = skewed.toPandas()
    split = {r["grp"]: r for r in scale.exact_quantiles(skewed, ["grp"], ["x", "t"], probs, hot=10).collect()}
    for name, part in pdf.groupby("grp"):
        for column in ("x", "t"):
            assert np.allclose(split[name][column], np.quantile(part[column].dropna(), probs))
    whole = scale.fit_quantiles(skewed, ["x", "t"], probs, hot=10)
    assert np.allclose(whole["x"], np.quantile(pdf["x"].dropna(), probs))
    assert np.allclose(whole["t"], np.quantile(pdf["t"], probs))
    whole = whole["x"]
    assert np.allclose(whole, scale.fit_quantiles(skewed, ["x"], probs)["x"])


@pytest.mark.parametrize("limit", [1, 5, 100])
def test_narrowed_quantiles(spark, limit):
    """Heavy tail, ties, nulls, an empty and a constant column."""
    rows = [(float(10 ** (i % 12)) + i / 7, 3.5 if i % 3 else float(i), None, 2.0) for i in range(500)]
    df = spark.createDataFrame(rows, "tail double, ties double, empty double, same double")
    probs = [0.0, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = scale.fit_quantiles(df, df.columns, probs, hot=limit)
    for c in ("tail", "ties", "same"):
        assert np.allclose(got[c], np.quantile(df.toPandas()[c], probs), rtol=1e-12)
    assert got["empty"] == []


def test_lookup_join_above_the_broadcast_limit(spark, skewed, hot):
    lookup = skewed.select("id", (F.col("id") * 2).alias("y"))
    joined = scale.lookup_join(skewed, lookup, ["id"])
    assert "Broadcast" not in joined._jdf.queryExecution().optimizedPlan().toString()
    assert joined.filter("y = id * 2").count() == 600


def test_small_side_is_broadcast(spark, skewed):
    lookup = skewed.select("grp").distinct().withColumn("y", F.lit(1))
    joined = scale.lookup_join(skewed, lookup, ["grp"])
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()


def test_closing_groups(spark, hot):
    for limit in (1, 25, 10**6):
        sizes = [(i, (i * 7) % 10 if i % 9 else None) for i in range(120)]
        expected, shard, held = [], 0, 0
        for i, n in sizes:
            expected.append((i, shard))
            held += n or 0
            if held >= limit:
                shard, held = shard + 1, 0
        df = spark.createDataFrame(sizes, "k bigint, n bigint").repartition(5)
        assert sorted(tuple(r) for r in scale.closing_groups(df, ["k"], "n", limit, "shard").select("k", "shard").collect()) == expected
    assert scale.closing_groups(df.limit(0), ["k"], "n", 5, "shard").count() == 0


def jobs(spark, work):
    """How many jobs a call runs."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = work()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setJobGroup("other", "other")


def closed(sizes, limit):
    expected, shard, held = [], 0, 0
    for i, n in sizes:
        expected.append((i, shard))
        held += n or 0
        if held >= limit:
            shard, held = shard + 1, 0
    return expected


@pytest.mark.parametrize("limit", [0, 1, 7, 60, 301, 5000])
def test_groups_close_across_ranges(spark, limit):
    draw = random.Random(limit)
    sizes = [(i, draw.choice([0, 0, None, 1, 5, 40, 300])) for i in range(3000)]
    df = spark.createDataFrame(sizes, "k bigint, n int").withColumn("shard", F.lit("own")).repartition(7)
    spark.conf.set("corpusloom.hotRows", "100")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out, count = jobs(spark, lambda: scale.closing_groups(df, ["k"], "n", limit, "shard"))
        assert sorted(tuple(r) for r in out.select("k", "shard").collect()) == closed(sizes, limit)
    finally:
        spark.conf.unset("corpusloom.hotRows")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    plain, few = jobs(spark, lambda: scale.closing_groups(df, ["k"], "n", limit, "shard"))
    assert sorted(tuple(r) for r in plain.select("k", "shard").collect()) == closed(sizes, limit)
    # (the runtime re-planner counts every exchange as a job)
    assert few <= 4 and count <= 10 and out.columns == plain.columns == ["k", "n", "shard"]


ODD = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 1e-320, 5e-324, 1.7e308, -1.7e308, 1.0, 1.0, 2.5, -3.0, 1e10, 7.0]


@pytest.mark.parametrize("values", [ODD, ODD[4:], [None] * 5, [], [3.0] * 40, [float("nan")] * 30, [float(i) ** 9 for i in range(-40, 90)],
                                    [1.0 + i * 2**-52 for i in range(64)], [float("inf")] + [float(i) for i in range(39)]])
def test_quantiles_agree_on_both_sides_of_the_limit(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    plain = scale.fit_quantiles(df, ["x"], probs, hot=10**6)["x"]
    narrowed = scale.fit_quantiles(df, ["x"], probs, hot=3)["x"]
    assert [repr(v + 0.0) for v in plain] == pytest.approx([repr(v + 0.0) for v in narrowed]) or plain == pytest.approx(narrowed, nan_ok=True)
    grouped = df.withColumn("g", F.lit(1)).union(spark.createDataFrame([(None, 2), (4.0, None), (None, None)], "x double, g int"))
    sides = [{r.g: r.x for r in scale.exact_quantiles(grouped, ["g"], ["x"], probs, hot=limit).collect()} for limit in (10**6, 2)]
    assert sides[0].keys() == sides[1].keys()
    for group, numbers in sides[0].items():
        other = sides[1][group]
        assert (numbers is None) == (other is None) and (numbers is None or numbers == pytest.approx(other, nan_ok=True))


def test_top_rows(spark, skewed, hot):
    best = scale.top_rows(skewed.repartition(6), [F.desc("t"), "id"], 70)
    assert [r.id for r in best.collect()] == [r.id for r in sorted(skewed.collect(), key=lambda r: (-r.t, r.id))[:70]]


def test_distinct_counts(spark, skewed):
    df = skewed.withColumns({"few": F.col("id") % 7, "none": F.lit(None).cast("string")})
    assert scale.distinct_counts(df, ["few", "id", "x", "none"]) == {"few": 7, "id": 600, "x": skewed.select("x").distinct().count() - 1, "none": 0}
    assert scale.distinct_counts(df, []) == {}


def test_rows_at_ranks_moves_few_buckets(spark):
    rows = [(None if i % 3 == 0 else i % 2, i) for i in range(20_000)]
    df = spark.createDataFrame(rows, "g int, i bigint").withColumn("d", row_hash(3, "i")).repartition(4)
    ranked = df.withColumn("r", F.row_number().over(W.partitionBy("g").orderBy("d")).cast("bigint"))
    wanted = spark.createDataFrame([(g, r) for g in (None, 0, 1) for r in (1, 17, 3000, 6666, 10**6)], "g int, r bigint")
    expected = sorted((tuple(x) for x in ranked.filter(F.col("r").isin(1, 17, 3000, 6666)).select("g", "i", "r").collect()), key=repr)
    found = scale.rows_at_ranks(df, ["g"], "d", wanted, "r")
    held = found.collect()
    assert sorted(((x.g, x.i, x.r) for x in held if x.r in (1, 17, 3000, 6666)), key=repr) == expected
    assert len(held) < 13_000  # at most four of seven buckets of each group


@pytest.mark.parametrize("descending", [False, True])
def test_rows_that_may_be_first(spark, descending):
    odd = [None, float("nan"), float("inf"), float("-inf"), 1e300, -1e300, 5.0, 5.0, 5.0]
    rows = [("a", i, odd[i % 9] if i % 4 == 0 else float((i * 7919) % 100_003)) for i in range(30_000)]
    rows += [(None, i, 7.0) for i in range(4000)] + [("few", i, float(i)) for i in range(20)] + [("null", i, None) for i in range(5000)]
    df = spark.createDataFrame(rows, "g string, i bigint, x double").repartition(3)
    order = [F.desc("x") if descending else F.asc("x"), "i"]

    def first(d, n):
        return pairs(d.withColumn("r", F.row_number().over(W.partitionBy("g").orderBy(*order))).filter(F.col("r") <= n), "g", "i", "r")
    for n in (1, 1500, 9000):
        near = scale.near_first(df, ["g"], "x", n, descending)
        assert near.columns == df.columns and first(near, n) == first(df, n)
        # few others than the first n and what ties with the last of them
        assert near.filter("g = 'a'").count() <= n + 11_000
    times = df.withColumn("x", F.timestamp_seconds("i"))
    near = scale.near_first(times, ["g"], "x", 1500, descending)
    assert first(near, 1500) == first(times, 1500) and near.filter("g = 'a'").count() <= 1510
    dates = df.withColumn("x", F.date_add(F.lit("2020-01-01").cast("date"), (F.col("i") % 50).cast("int")))
    assert first(scale.near_first(dates, ["g"], "x", 1500, descending), 1500) == first(dates, 1500)
    words = df.withColumn("x", F.col("i").cast("string"))
    assert scale.near_first(words, ["g"], "x", 5, descending) is words
