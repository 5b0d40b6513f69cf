import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import encode, features, profile
from corpusloom.operators.prepare import prepare_table
from corpusloom.session import new_run_dir
from corpusloom.sources.tables import read_artifact


@pytest.fixture(scope="module")
def frame(spark):
    rows = []
    for i in range(48):
        amount = None if i in (3, 17, 29) else math.exp(i / 8)
        segment = None if i % 16 == 5 else ("common_a" if i % 4 == 0 else "common_b" if i % 4 in (1, 2) else f"rare_{i}")
        rows.append((i, amount, segment, int(i % 3 == 0)))
    return spark.createDataFrame(rows, "customer_id int, amount double, segment string, approved int")


def test_all_transforms_fire(frame):
    spec = features.fit_transforms(frame, ["amount"], ["segment"])
    assert spec.missing == ["amount", "segment"] and spec.log1p == ["amount"]
    assert spec.collapse == ["segment"] and spec.frequency == ["segment"] and spec.min_count == 2
    out = features.apply_transforms(frame, spec)
    assert out.columns == ["customer_id", "amount", "segment", "approved", "amount_is_missing", "segment_is_missing", "amount_log1p", "segment_frequency"]
    rare = out.filter("segment = '__RARE__'").collect()
    assert rare and all(r.segment_frequency == 0.0 for r in rare)
    assert out.agg(F.max("segment_is_missing")).first()[0] == 0
    missing = out.filter("amount is null").first()
    assert (missing.amount_is_missing, missing.amount_log1p) == (1, 0.0)


def test_source_first_order(frame):
    spec = features.fit_transforms(frame, ["amount"], ["segment"])
    out = features.apply_transforms(frame, spec, order="source_first")
    assert out.agg(F.max("segment_is_missing")).first()[0] == 1
    assert out.filter("segment = '__RARE__'").agg(F.min("segment_frequency")).first()[0] > 0


def test_absent_source_and_unseen_values(spark, frame):
    spec = features.fit_transforms(frame, ["amount"], ["segment"])
    new = spark.createDataFrame([(1, "never seen")], "customer_id int, segment string")
    row = features.apply_transforms(new, spec).first()
    assert (row.segment, row.segment_frequency, row.amount_is_missing, row.amount_log1p) == ("__RARE__", 0.0, 1, 0.0)


def test_spec_round_trip_and_large_vocabulary(spark, frame, hot):
    """With the limits lowered the values are checkpointed and joined without broadcast."""
    spark.conf.set("corpusloom.smallSideRows", "3")
    spec = features.fit_transforms(frame, ["amount"], ["segment"])
    path = new_run_dir(spark, "spec")
    spec.save(spark, path)
    again = features.TransformSpec.load(spark, path)
    assert again.to_json() == spec.to_json()
    one = sorted(map(repr, features.apply_transforms(frame, spec).collect()))
    assert one == sorted(map(repr, features.apply_transforms(frame, again).collect()))


def test_log1p_conditions(spark):
    df = spark.createDataFrame([(float(i % 7) ** 6, -float(2 ** (i % 12)), float(2 ** (i % 14))) for i in range(60)], "few double, neg double, ok double")
    assert features.fit_log1p(df, ["few", "neg", "ok"]) == ["ok"]


def test_encode(spark):
    four = [(1.0, "a", "no"), (2.0, "b", "yes"), (None, "a", "no"), (4.0, None, "yes")]
    train = spark.createDataFrame(four * 4, "num double, cat string, target string")
    schema = encode.build_schema(train, "target", "binary", ["num"], ["cat"])
    assert schema.numeric["num"]["fill"] == 2.0 and schema.numeric["num"]["mean"] == 2.25
    rows = encode.encode(spark.createDataFrame(four, train.schema), schema, keep=["num"]).collect()
    assert [list(r.x_cat) for r in rows] == [[2], [3], [2], [1]]
    assert [r.y for r in rows] == [0, 1, 0, 1]
    assert [list(r.num_mask) for r in rows] == [[True], [True], [False], [True]]
    new = spark.createDataFrame([(9.0, "zzz", "no")], train.schema)
    assert list(encode.encode(new, schema).first().x_cat) == [0]
    assert list(encode.encode(new.select("num"), schema).first().x_cat) == [1]
    unseen = spark.createDataFrame([(9.0, "a", "maybe")], train.schema)
    with pytest.raises(Exception, match="unseen target label"):
        encode.encode(unseen, schema).collect()
    assert encode.encode(unseen, schema, unseen="null").first().y is None


def test_constant_numeric_has_unit_std(spark):
    df = spark.createDataFrame([(5.0, None)] * 3, "c double, empty double")
    stats = encode.numeric_stats(df, ["c", "empty"])
    assert stats["c"]["std"] == 1.0 and stats["empty"] == {"fill": 0.0, "mean": 0.0, "std": 1.0}


def test_prepare_writes_everything(spark, frame):
    path = new_run_dir(spark, "prep")
    big = frame.union(frame.withColumn("customer_id", F.col("customer_id") + 100))
    prepared = prepare_table(big, ["customer_id"], target="approved", title="My Data!", seed=7, path=path)
    assert prepared.task == "binary"
    card = read_artifact(spark, f"{path}/dataset_card.json")
    facts = json.loads(card["facts"])
    assert facts["dataset_id"] == "my_data" and sum(card["rows"].values()) == 96
    assert card["rows"] == {"train": 76, "val": 10, "test": 10}
    assert "customer_id" not in facts["numeric_columns"]
    schema = encode.FrozenSchema.load(spark, f"{path}/schema")
    rows = spark.read.parquet(f"{path}/rows")
    assert encode.encode(rows, schema).count() == 96


def test_batches(spark):
    df = spark.range(100)
    out = encode.assemble_batches(df, 32, ["id"], collect=["id"]).orderBy("batch_id").collect()
    assert [len(r.id) for r in out] == [32, 32, 32, 4] and out[1].id[0] == 32


def test_cells_that_look_like_keys(spark):
    long = "z" * 300
    key = "md5:" + hashlib.md5(long.encode()).hexdigest()
    df = spark.createDataFrame([(i, [long, key, "a", None][i % 4]) for i in range(400)], "id int, t string")
    prof = profile.column_profile(df, ["t"]).first()
    assert (prof.n_distinct, prof.top_count, prof.n_valid) == (3, 100, 300)
    spec = features.fit_transforms(df, [], ["t"])
    assert {r.t for r in features.apply_transforms(df, spec).collect()} >= {long, key, "a"}
    plan = profile.profile_cells(df, ["t"])._jdf.queryExecution().executedPlan().toString()
    assert all("i#" in line and "t#" not in line for line in plan.splitlines() if "hashpartitioning" in line)


def test_long_text_values(spark):
    """Long cells are counted and looked up by key, and come back as they were."""
    words = ["w" * 200, "w" * 199 + "x", "9" * 80, "short"]
    df = spark.createDataFrame([(i, words[i % 4] if i % 10 else f"rare {i} " + "y" * 90) for i in range(400)], "id int, t string")
    prof = profile.column_profile(df, ["t"]).first()
    assert (prof.n_distinct, prof.n_chars) == (44, sum(len(r.t) for r in df.collect()))
    assert prof.n_numeric == sum(r.t == words[2] for r in df.collect())
    spec = features.fit_transforms(df, [], ["t"])
    assert spec.collapse == ["t"] and spec.frequency == ["t"]
    out = features.apply_transforms(df, spec)
    assert {r.t for r in out.collect()} == {*words, "__RARE__"}
    counts = {r.t: r["count"] / 400 for r in df.groupBy("t").count().collect()}
    for r in out.filter("t <> '__RARE__'").select("t", "t_frequency").distinct().collect():
        assert r.t_frequency == pytest.approx(counts[r.t])
