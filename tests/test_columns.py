from pyspark.sql import functions as F

from corpusloom.functions.text import datetime_or_null, number_or_null, tokenize_text
from corpusloom.functions.hashing import hash_token
from corpusloom.operators import columns as ops


def test_make_unique_skips_taken_suffixes():
    assert ops.make_unique(["a", "a", "a_1", "a", "b"]) == ["a", "a_1", "a_1_1", "a_2", "b"]


def test_normalize_columns(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["Customer ID", "customer-id", "??", " Été "])
    out, mapping = ops.normalize_columns(df)
    assert out.columns == ["customer_id", "customer_id_1", "column", "t"]
    assert mapping["customer-id"] == "customer_id_1"


def test_keep_scalar_columns(spark):
    df = spark.createDataFrame([(1, [1], {"a": 1}, bytearray(b"x"))], "a int, b array<int>, c map<string,int>, d binary")
    flat, dropped = ops.keep_scalar_columns(df)
    assert flat.columns == ["a"]
    assert dropped == {"b": "contains sequence values", "c": "contains mapping values", "d": "contains binary bytes values"}


def test_numbers_and_dates(spark):
    cells = ["1", " -2.5e3 ", "1d", "1f", "0x10", "", "nan", "inf", ".5", "5.", "1 2", None]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert [r[0] for r in df.select(number_or_null("c")).collect()] == [1.0, -2500.0, None, None, None, None, None, float("inf"), 0.5, 5.0, None, None]
    cells = ["2024-01-31", "2024/2/3", "12/31/2024 23:59", "2024", "20240131", "2024-13-01", "2024-01-01T05:06:07.5", "x"]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert [r[0] is not None for r in df.select(datetime_or_null("c")).collect()] == [True, True, True, False, False, False, True, False]


def test_tokens(spark):
    df = spark.createDataFrame([("num",), ("Two_words here",), ("   ",), (None,), ("__",)], "c string")
    rows = [r[0] for r in df.select(tokenize_text("c", 4)).collect()]
    first = df.select(hash_token("c")).first()[0]
    assert first == 5895 and rows[0] == [5895, 0, 0, 0]
    assert sum(t > 0 for t in rows[1]) == 3
    assert rows[2] == rows[3] == [0, 0, 0, 0]
    assert sum(t > 0 for t in rows[4]) == 1


def test_drop_rules(spark):
    df = spark.createDataFrame([(i, i % 3, "x", None, f"u{i}", i) for i in range(50)],
                               "unit_id int, group_id int, same string, empty string, name string, target int")
    assert ops.drop_identifiers_by_value(df, "target").columns == ["group_id", "same", "empty", "name", "target"]
    assert ops.drop_empty_and_constant(df, "target").columns == ["unit_id", "group_id", "name", "target"]
    assert ops.drop_identifiers_by_name(df).columns == ["same", "empty", "name", "target"]


def test_filter_catalog_ignores_unset_predicates(spark):
    df = spark.createDataFrame([("A", True, 10, None), ("b", False, 20, 5.0)], "name string, recommended boolean, n int, use double")
    assert ops.filter_catalog(df, equals={"name": None}, minimum={"n": 0}, usability=("use", 0)).count() == 2
    assert ops.filter_catalog(df, flag="recommended").first()["name"] == "A"
    assert ops.filter_catalog(df, name_contains=("name", "B")).first()["name"] == "b"
    assert ops.filter_catalog(df, usability=("use", 1)).count() == 1


def test_limit_rows_needs_an_order(spark):
    df = spark.range(10)
    assert [r[0] for r in ops.limit_rows(df, 3, [F.desc("id")]).collect()] == [9, 8, 7]
