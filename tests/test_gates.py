import pytest
from pyspark.sql import functions as F

from corpusloom.functions.text import fixed_point
from corpusloom.operators import gates


def test_shares_are_printed_as_python_prints_them(spark):
    """0.825 is a little below the half, 0.625 is one, 0.0005 a little above."""
    numbers = [0.825, 0.625, 0.875, 0.545, 0.005, 0.0005, 0.00005, -0.0005, -0.825, 0.0, 12345.675, float("nan"), float("-inf")]
    numbers += [i / n for n in (40, 80, 200, 2000, 20000) for i in range(0, 2 * n, 7)]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    out = df.select("x", *[fixed_point("x", d).alias(str(d)) for d in (2, 3, 4)]).collect()
    assert all(r[str(d)] == f"{r['x']:.{d}f}" for r in out for d in (2, 3, 4))


def test_verdict_at_a_half(spark):
    # 7 different rows of 40: a share of 0.825
    rows = spark.range(40).select(F.lit(1).alias("set"), F.least("id", F.lit(6)).alias("a"), (F.least("id", F.lit(6)) % 2).alias("y"))
    out = gates.gate_verdict(rows.withColumn("task", F.lit("binary")), ["set"], "y", "task", ["a"], ["a"]).first()
    assert out["reason"] == f"gate_fail: dupe_frac={33 / 40:.2f}" == "gate_fail: dupe_frac=0.82"


@pytest.mark.parametrize("task, note", [("regression", "SOFT_WARN: R2=-0.062"), ("binary", "SOFT_WARN: AUC=-0.062")])
def test_soft_notes_at_a_half(spark, task, note):
    out = gates.utility_notes(spark.createDataFrame([(task, -0.0625)], "task_type string, score double")).first()
    assert out["note"] == note
