"""All tables at once must say what the one-table forms say of each."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import catalogue as cat
from corpusloom.operators.gates import gate_verdict
from corpusloom.operators.infer import rank_target_candidates, resolve_target
from corpusloom.operators.profile import column_profile
from corpusloom.session import new_run_dir

RATIOS = ["missing_ratio", "unique_ratio", "top_frequency_ratio", "avg_string_length", "parse_numeric_ratio", "parse_datetime_ratio"]


def tables():
    """Tables of different width, in the ways that change a verdict."""
    draw = random.Random(5)
    made = {}
    for k in range(14):
        n = (30, 70, 150, 260)[k % 4]
        columns = {"id": list(range(n)), "amount": [draw.randrange(1000) for _ in range(n)],
                   "note": [draw.choice(["x", "long text of some words", None]) for _ in range(n)],
                   "day": [f"2024-01-{i % 28 + 1:02d}" for i in range(n)]}
        columns = dict(list(columns.items())[:2 + k % 3])
        if k % 5 == 1:
            columns["flat"] = [3] * n
        if k % 5 == 2:
            columns["void"] = [None] * n
        if k % 7 != 6:
            columns[("target", "label", "class")[k % 3]] = [draw.randrange(3) if k != 8 else int(i == 0) for i in range(n)]
        if k == 9:
            columns = {c: [0 if c == "id" else v[i % 20] for i in range(n)] for c, v in columns.items()}
        made[f"t{k}"] = columns
    return made


@pytest.fixture(scope="module")
def found(spark):
    root = new_run_dir(spark, "catalogue")
    lines = []
    for name, columns in tables().items():
        for i in range(len(next(iter(columns.values())))):
            lines.append((name, {c: v[i] for c, v in columns.items()}))
    df = spark.createDataFrame([(n, json.dumps(r)) for n, r in lines], "dataset string, value string")
    df.write.partitionBy("dataset").text(root)
    rows = cat.json_rows(spark, root, r"dataset=([^/]+)/").cache()
    facts = cat.table_facts(rows)
    profile = cat.catalogue_profile(rows, facts).cache()
    targets = cat.catalogue_targets(profile)
    return facts, profile, targets, cat.catalogue_verdicts(facts, profile, targets)


def one_table(spark, columns):
    kinds = ", ".join(f"{c} {'string' if any(isinstance(x, str) for x in v) or not any(x is not None for x in v) else 'bigint'}" for c, v in columns.items())
    return spark.createDataFrame(list(zip(*columns.values())), kinds)


def test_against_one_table_forms(spark, found):
    facts, profile, targets, verdicts = found
    by_table = {}
    for r in profile.collect():
        by_table.setdefault(r.dataset, {})[r.column] = r
    targets = {r.dataset: r for r in targets.collect()}
    verdicts = {r.dataset: r for r in verdicts.collect()}
    ranking = {}
    for r in cat.catalogue_ranking(profile).collect():
        ranking.setdefault(r.dataset, set()).add((r.column, r.position, r.score, r.n_distinct))
    assert len(by_table) == len(targets) == len(verdicts) == 14
    seen = set()
    for name, columns in list(tables().items()):
        df = one_table(spark, columns)
        own = column_profile(df)
        for r in own.collect():
            there = by_table[name][r.column]
            assert [there[c] for c in ("n_rows", "n_valid", "n_distinct", "top_count", "position", "integer_like", *RATIOS)] == \
                [r[c] for c in ("n_rows", "n_valid", "n_distinct", "top_count", "position", "integer_like", *RATIOS)], (name, r.column)
        assert ranking[name] == {(r["column"], r["position"], r["score"], r["n_distinct"]) for r in rank_target_candidates(own).collect()}
        try:
            target = resolve_target(df)
        except ValueError:
            target = None
        assert (targets[name].target_column, targets[name].task_type) == ((target.column, target.task_type) if target else (None, None))
        seen.add(verdicts[name].status)
        if verdicts[name].status in ("ok", "gate_fail"):
            features = [c for c in columns if c != target.column]
            numeric = [c for c in features if by_table[name][c].prefer_numeric]
            verdict = gate_verdict(df.withColumns({"d": F.lit(1), "t": F.lit(target.task_type)}), ["d"], target.column, "t", numeric, features).first()
            assert (verdicts[name].error or "") == verdict.reason
            assert (verdicts[name].status == "ok") == verdict.passed
    assert {"ok", "gate_fail", "too_small"} <= seen


def test_absent_cells_and_odd_lines(spark):
    root = new_run_dir(spark, "odd-lines")
    lines = ['{"a": 1, "b": "x"}', '{"b": null}', "{}", "not json", "", '{"a": {"c": 2}, "a b.c": true}']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{root}/odd")
    rows = cat.json_rows(spark, root)
    assert [tuple(r) for r in cat.table_facts(rows).collect()] == [("odd", 6, 0.5)]  # four rows without a value are equal
    got = {r.column: (r.n_rows, r.n_valid, r.n_distinct) for r in cat.catalogue_profile(rows).collect()}
    assert got == {"a": (6, 2, 2), "b": (6, 1, 1), "a b.c": (6, 1, 1)}
    none = rows.limit(0)
    facts, profile = cat.table_facts(none), cat.catalogue_profile(none)
    assert cat.catalogue_verdicts(facts, profile, cat.catalogue_targets(profile)).count() == 0


def test_wide_table_of_many_datasets(spark):
    df = spark.createDataFrame([(k, i, None if k == 1 else i % 3) for k in (0, 1, None) for i in range(9)], "d int, x int, y int")
    got = {(r.dataset, r.column): (r.n_rows, r.n_valid, r.n_distinct, r.position) for r in cat.catalogue_profile(cat.rows_of(df, "d")).collect()}
    assert got == {(k, c): (9, 0 if (k, c) == (1, "y") else 9, {"x": 9, "y": 0 if k == 1 else 3}[c], {"x": 1, "y": 2}[c])
                   for k in (0, 1, None) for c in ("x", "y")}


def test_verdicts_read_the_cells_twice(spark):
    """Facts and profile are worked out once, whatever is made of them."""
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    df = spark.range(300).select((F.col("id") % 3).cast("string").alias("d"), "id", (F.col("id") % 5).alias("x"), (F.col("id") % 2).alias("target"))
    rows = cat.rows_of(df, "d")
    rows = rows.mapInArrow(counted, rows.schema)
    facts = cat.table_facts(rows)
    profile = cat.catalogue_profile(rows, facts)
    verdicts = cat.catalogue_verdicts(facts, profile, cat.catalogue_targets(profile)).collect()
    assert [(r.status, r.n_rows) for r in verdicts] == [("ok", 100)] * 3
    assert reads.value == 2 * 300
