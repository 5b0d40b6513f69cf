from collections import Counter

import pytest
from pyspark.sql import Window as W, functions as F

from corpusloom.functions.hashing import row_hash
from corpusloom.operators import sampling


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, "big" if i % 3 else ("mid" if i % 2 else "small")) for i in range(301)]
    return spark.createDataFrame(rows, "id bigint, y string")


def test_split_sizes_match_the_sample_card(spark):
    df = spark.range(2048).withColumn("y", (F.col("id") % 4 == 0).cast("int"))
    out = sampling.split_table(df, "y", "binary", ["id"], val_fraction=0.1, test_fraction=0.1)
    assert Counter(r["split"] for r in out.collect()) == {"train": 1638, "val": 205, "test": 205}


def test_split_is_the_same_above_the_limit(spark, labelled, hot):
    split = sorted(tuple(r) for r in sampling.split_table(labelled, "y", "multiclass", ["id"]).collect())
    spark.conf.unset("corpusloom.hotRows")
    assert split == sorted(tuple(r) for r in sampling.split_table(labelled, "y", "multiclass", ["id"]).collect())


def test_split_is_proportional_and_repeatable(labelled):
    one = sampling.split_table(labelled, "y", "multiclass", ["id"], 3, 0.2, 0.2).collect()
    two = sampling.split_table(labelled.repartition(7), "y", "multiclass", ["id"], 3, 0.2, 0.2).collect()
    assert sorted(one) == sorted(two)
    total, held = Counter(r.y for r in one), Counter(r.y for r in one if r.split != "train")
    assert all(abs(held[c] - 0.4 * total[c]) <= 1.5 for c in total)


def test_split_errors_and_edges(labelled):
    with pytest.raises(ValueError):
        sampling.split_table(labelled, "y", "multiclass", ["id"], val_fraction=0.6, test_fraction=0.4)
    assert {r.split for r in sampling.split_table(labelled, "y", "multiclass", ["id"], 1, 0.2, 0.0).collect()} == {"train", "val"}
    assert {r.split for r in sampling.split_table(labelled, "y", "multiclass", ["id"], 1, 0.0, 0.0).collect()} == {"train"}


def test_cap_rows(labelled, hot):
    capped = sampling.cap_rows_stratified(labelled, 100, "y", "multiclass", ["id"])
    assert capped.count() == 100 and capped.columns == ["id", "y"]
    assert sampling.cap_rows_stratified(labelled, 1000, "y", "multiclass", ["id"]).count() == 301


def test_episodes(spark):
    df = spark.range(220).withColumn("set", F.col("id") % 2)
    out = sampling.sample_episode(df, ["set"], ["id"], 40, 30, seed=5)
    rows = out.collect()
    for s in (0, 1):
        support = {r.id for r in rows if r.set == s and r.role == "support"}
        query = {r.id for r in rows if r.set == s and r.role == "query"}
        assert (len(support), len(query)) == (40, 30) and not support & query
    assert sorted(rows) == sorted(sampling.sample_episode(df, ["set"], ["id"], 40, 30, seed=5).collect())
    assert sorted(rows) != sorted(sampling.sample_episode(df, ["set"], ["id"], 40, 30, seed=6).collect())
    with pytest.raises(ValueError):
        sampling.sample_episode(df, ["set"], ["id"], 100, 30)


def test_episode_rank_is_limited_before_the_shuffle(spark):
    df = spark.range(220).withColumn("set", F.col("id") % 2)
    plan = sampling.sample_episode(df, ["set"], ["id"], 4, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_episode_with_replacement(spark, hot):
    df = spark.range(90).withColumn("set", F.lit(1))
    out = sampling.sample_episode_with_replacement(df, ["set"], ["id"], 150, 50, seed=1)
    assert Counter(r.role for r in out.collect()) == {"support": 150, "query": 50}


def test_weighted_order_prefers_heavy_jobs(spark):
    df = spark.range(400).withColumn("w", F.when(F.col("id") < 40, 100.0).otherwise(1.0))
    early = sampling.weighted_order(df, "w", ["id"]).filter("position <= 40")
    assert early.filter("id < 40").count() > 25


def test_fixed_size_sample(spark):
    assert sampling.fixed_size_sample(spark.range(500), 123, ["id"]).distinct().count() == 123


def test_large_episodes_and_null_datasets(spark):
    rows = [(i, None if i % 3 == 0 else "a") for i in range(9000)]
    df = spark.createDataFrame(rows, "id bigint, d string")
    out = sampling.sample_episode(df, ["d"], ["id"], 900, 600)
    ranked = df.withColumn("r", F.row_number().over(W.partitionBy("d").orderBy(row_hash(0, "id")))).filter("r <= 1500")
    assert {(r.id, r.d) for r in out.collect()} == {(r.id, r.d) for r in ranked.collect()}
    drawn = sampling.sample_episode_with_replacement(df, ["d"], ["id"], 5, 5).groupBy("d").count().collect()
    assert {(r.d, r["count"]) for r in drawn} == {(None, 10), ("a", 10)}
