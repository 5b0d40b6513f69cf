import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import infer, profile


@pytest.fixture(scope="module")
def survival(spark):
    rows = [(i, 7.25 + i * 3.1, 20 + i, i % 2) for i in range(10)]
    return spark.createDataFrame(rows, "passenger_id int, fare double, age int, survived int")


def test_resolve_target_by_name(survival):
    found = infer.resolve_target(survival)
    assert (found.column, found.task_type, found.source) == ("survived", "binary", "heuristic")
    assert found.candidates[0]["column"] == "survived" and len(found.candidates) == 4


def test_given_and_metadata_targets(survival):
    assert infer.resolve_target(survival, given="age").column == "age"
    assert infer.resolve_target(survival, metadata="fare", metadata_task="regression").task_type == "regression"
    with pytest.raises(KeyError):
        infer.resolve_target(survival, given="nothing")


def test_ambiguous_target_raises(spark):
    df = spark.createDataFrame([(0, 1, 0, 1), (1, 0, 1, 0), (0, 0, 1, 1), (1, 1, 0, 0)], "feature_a int, feature_b int, flag_one int, flag_two int")
    with pytest.raises(ValueError, match="Could not infer the target"):
        infer.resolve_target(df)


def test_nested_target_and_lonely_target_raise(spark):
    df = spark.createDataFrame([(1.0, "a", [1])], "feature_a double, label string, metadata array<int>")
    with pytest.raises(ValueError, match="not tabular"):
        infer.resolve_target(df, given="metadata")
    with pytest.raises(ValueError, match="only contains the target"):
        infer.resolve_target(df.select("label"), given="label")


def test_task_rules(spark):
    df = spark.createDataFrame([(i, i % 2, i % 5, i / 7, f"t{i % 4}", str(i % 40), None) for i in range(400)],
                               "id int, two int, five int, real double, word string, digits string, nothing string")
    prof = profile.column_profile(df)
    kinds = {r["column"]: r for r in prof.select("column", *[infer.infer_task(r).alias(r) for r in "ABCD"]).collect()}
    assert [kinds["two"][r] for r in "ABCD"] == ["binary"] * 4
    assert [kinds["five"][r] for r in "ABCD"] == ["multiclass"] * 4
    assert [kinds["real"][r] for r in "ABCD"] == ["regression"] * 4
    assert [kinds["word"][r] for r in "ABCD"] == ["multiclass"] * 4
    assert [kinds["digits"][r] for r in "ABCD"] == ["multiclass", "regression", "multiclass", "regression"]
    assert [kinds["nothing"][r] for r in "AC"] == ["multiclass", "regression"]


def test_temporal_columns(spark):
    df = spark.createDataFrame([("2024-01-02", 5, 1.5, "x")] * 3, "born string, hour_of_day int, amount double, name string")
    df = df.withColumn("at", F.current_timestamp())
    assert infer.temporal_columns(df) == ["born", "hour_of_day", "at"]


def test_validate_table(spark):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(300)], "a int, b string")
    assert tuple(infer.validate_table(df, ["a"]).first()) == (False, "only 1 usable columns", 300, 2)
    assert tuple(infer.validate_table(df, ["a"], sample_rows=100).first()) == (True, "", 100, 2)
    assert infer.validate_table(df.limit(5), ["a"]).first()["reason"] == "too small: (5, 2)"


def test_domain_ties_go_to_the_first(spark):
    df = spark.createDataFrame([("the price",), ("soil water",), ("zzz",)], "t string")
    assert [r[0] for r in infer.classify_domain(df, "t").select("domain").collect()] == ["finance", "environment", "unknown"]


def test_profile_of_empty_column(spark):
    df = spark.createDataFrame([(None, 1.0)] * 4, "a string, b double")
    row = profile.column_profile(df).filter("column = 'a'").first()
    assert (row.missing_ratio, row.unique_ratio, row.top_frequency_ratio, row.avg_string_length) == (1.0, 0.0, 0.0, 0.0)


def test_keywords_at_borders(spark):
    draw = random.Random(3)
    words = ["ab", "abc", "bca", "cabc", "ü", "aüb", "x" * 9]
    words = [w for w in words if len(w.encode()) > 1]
    texts = ["".join(draw.choice(["a", "b", "c", "ü", "x" * 4, "abc"]) for _ in range(draw.randrange(30))) for _ in range(500)] + ["", None, "x" * 50]
    finder = infer.KeywordFinder(words)
    want = [[w in (t or "") for w in words] for t in texts]
    assert finder.held(pa.array(texts)).tolist() == want
    finder.PIECE = 7
    assert finder.held(pa.array(texts).slice(3, 400)).tolist() == want[3:403]
    assert finder.held(pa.array([], pa.string())).shape == (0, len(words))
