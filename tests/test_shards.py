"""Shards that are visible as a whole or not at all, and skipped by what the log says of them."""

import glob
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F, types as T

from corpusloom.operators.shards import ShardTable
from corpusloom.session import new_run_dir

SCHEMA = T.StructType([T.StructField("shard_id", T.IntegerType()), T.StructField("k", T.LongType()),
                       T.StructField("x", T.DoubleType()), T.StructField("name", T.StringType()),
                       T.StructField("at", T.TimestampType()), T.StructField("parts", T.ArrayType(T.IntegerType()))])


def rows(seed, n=300):
    draw = random.Random(seed)
    made = []
    for i in range(n):
        shard = draw.choice([None, 0, 1, 2, 3, 4])
        base = 100 * (shard or 0)
        made.append((shard, base + draw.randrange(150) if draw.random() < 0.9 else None,
                     draw.choice([float("nan"), float("inf"), None, base + draw.random()]) if shard != 3 else None,
                     "p" * 40 + chr(97 + (shard or 0)) + str(i), datetime(2024, 1, 1 + (shard or 0), i % 24), [i]))
    return made


def key(r):
    return repr(tuple(r))


def table(spark, path):
    return ShardTable(spark, path, SCHEMA)


def test_batches_count_as_a_whole(spark):
    path = new_run_dir(spark, "shards")
    shards = table(spark, path)
    assert shards.read(["k"]).count() == 0 and shards.manifest().count() == 0 and shards.broken().count() == 0
    first, second = rows(1), rows(2)
    assert shards.write(spark.createDataFrame(first, SCHEMA), 0)
    assert not shards.write(spark.createDataFrame(second, SCHEMA), 0)  # repeated: no change
    # a write that was killed before its entry
    spark.createDataFrame(second, SCHEMA).withColumn("__shard", F.lit("torn")).write.partitionBy("__shard").parquet(f"{path}/data/1")
    assert sorted(map(key, table(spark, path).read(SCHEMA.names).collect())) == sorted(map(key, first))
    assert table(spark, path).write(spark.createDataFrame(second, SCHEMA), 1)
    both = first + second
    assert sorted(map(key, shards.read(SCHEMA.names).collect())) == sorted(map(key, both))
    assert {r.shard_id: (r.n_rows, r.n_batches) for r in shards.manifest().collect()} == {
        s: (sum(r[0] == s for r in both), 2) for s in (None, 0, 1, 2, 3, 4)}
    # an empty batch is a batch
    assert shards.write(spark.createDataFrame([], SCHEMA), 2) and not shards.write(spark.createDataFrame(first, SCHEMA), 2)
    assert shards.read(["k"]).count() == len(both) and shards.broken().count() == 0


@pytest.mark.parametrize("ranges", [
    {}, {"k": (None, None)}, {"k": (120, 180)}, {"k": (900, None)}, {"k": (None, -1)}, {"x": (200.0, 250.0)},
    {"x": (None, 50.0)}, {"x": (1e300, None)}, {"name": ("p" * 40 + "c", "p" * 40 + "d")}, {"name": ("q", None)}, {"shard_id": (1, 2)},
    {"shard_id": (2, None), "k": (None, 310)}, {"at": (datetime(2024, 1, 3), datetime(2024, 1, 3, 5))}])
def test_skipping_loses_no_row(spark, ranges):
    path, made = new_run_dir(spark, "skipping"), rows(3)
    shards = table(spark, path)
    shards.write(spark.createDataFrame(made, SCHEMA), 7)
    expected = spark.createDataFrame(made, SCHEMA)
    for name, (least, greatest) in ranges.items():
        expected = expected.filter(F.col(name).isNotNull())
        expected = expected if least is None else expected.filter(F.col(name) >= F.lit(least))
        expected = expected if greatest is None else expected.filter(F.col(name) <= F.lit(greatest))
    found = shards.read(SCHEMA.names, ranges)
    assert sorted(map(key, found.collect())) == sorted(map(key, expected.collect()))
    # shards that cannot match are not opened
    if ranges == {"k": (120, 180)}:
        assert len(found.inputFiles()) < len(glob.glob(f"{path}/data/7/*/*.parquet"))
        assert {r.shard_id for r in shards.selected(ranges).collect()} <= {None, 0, 1}
    if ranges in ({"k": (900, None)}, {"name": ("q", None)}):
        assert shards.selected(ranges).count() == 0


def test_lost_rows_are_found(spark):
    path = new_run_dir(spark, "broken")
    shards = table(spark, path)
    shards.write(spark.createDataFrame(rows(4), SCHEMA), 0)
    entry = shards.selected({"shard_id": (2, 2)}).first()
    spark.createDataFrame(rows(4)[:1], SCHEMA).write.mode("overwrite").parquet(entry.folder)
    assert [(r.folder, r.logged, r.actual) for r in shards.broken().collect()] == [(entry.folder, entry.n_rows, 1)]
