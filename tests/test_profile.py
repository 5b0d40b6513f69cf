from decimal import Decimal

from corpusloom.operators import profile


def test_numbers_are_told_apart_as_texts(spark):
    rows = [(0.0, 0.1, 1, Decimal("1.50"), "1.5"), (-0.0, 0.1, 1, Decimal("1.50"), " 12"), (float("nan"), 2.0, 2**53 + 1, None, "inf"),
            (float("inf"), None, 2**53, Decimal("2.00"), "1/1/2024"), (2.5, 3.25, None, Decimal("-7.25"), "word"), (2.5, -1.0, -3, None, None)]
    df = spark.createDataFrame(rows, "d double, f float, n bigint, c decimal(9,2), t string")
    found = {r["column"]: r for r in profile.column_profile(df).collect()}
    texts = {c: [r[c] for r in df.select(*[df[c].cast("string") for c in df.columns]).collect()] for c in df.columns}
    for c, cells in texts.items():
        own = [x for x in cells if x is not None]
        assert (found[c].n_rows, found[c].n_valid, found[c].n_distinct) == (6, len(own), len(set(own)))
        assert found[c].n_chars == sum(map(len, own)) and found[c].top_count == max(map(own.count, own))
    assert [found[c].n_numeric for c in "dfnct"] == [5, 5, 5, 4, 3]
    assert [found[c].n_datetime for c in "dfnct"] == [0, 0, 0, 0, 1]
    assert [found[c].integer_like for c in "dfnct"] == [False, False, True, False, False]


def test_patterns_are_planned_once(spark, capsys):
    """Facts of a cell are worked out after the unpivot, not once more for every column."""
    def patterns(width):
        df = spark.createDataFrame([tuple("x" for _ in range(width))], [f"c{i}" for i in range(width)])
        profile.profile_cells(df, df.columns).explain(True)
        return capsys.readouterr().out.split("== Optimized")[0].split("== Analyzed")[1].count("RLIKE")
    assert patterns(2) == patterns(9)
