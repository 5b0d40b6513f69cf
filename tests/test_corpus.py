import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import augment, budget, corpus, gates, metrics, registry
from corpusloom.session import new_run_dir
from corpusloom.sources import tables


def test_encode_errors(spark):
    small = spark.createDataFrame([(1, 2, "a")] * 10, "a int, b int, y string")
    with pytest.raises(corpus.EncodeError, match="too few rows"):
        corpus.encode_fixed_width(small, "y", "d")
    one = spark.range(80).withColumn("y", F.col("id") % 2)
    with pytest.raises(corpus.EncodeError, match="only 1 features"):
        corpus.encode_fixed_width(one, "y", "d")
    with pytest.raises(corpus.EncodeError, match="missing"):
        corpus.encode_fixed_width(one, "z", "d")


def test_encode_keeps_missing_labels_as_a_class(spark):
    df = spark.range(100).select("id", (F.col("id") * 2).alias("b"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("c"), (F.col("id") % 2).cast("string"))).alias("y"))
    out, meta = corpus.encode_fixed_width(df, "y", "d", task="multiclass")
    assert meta["n_classes"] == 3 and meta["n_samples"] == 100 and len(out.columns) == 66
    assert json.loads(out.first()["_source_meta"])["feature_names"] == ["id", "b"]


def test_shards_round_trip(spark):
    df = spark.range(1000).withColumn("d", F.floor(F.col("id") / 90))
    shards = corpus.assign_shards(df, "d", 250)
    path = new_run_dir(spark, "shards")
    corpus.write_shards(shards, path)
    back = corpus.read_shards(spark, path, ["id", "shard_id"], F.col("shard_id") == 1)
    assert back.count() == 270
    assert spark.read.parquet(path).count() == 1000
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard_id" in plan and "ReadSchema: struct<id:bigint>" in plan


def test_cap_total_rows_rules(spark):
    df = spark.range(400).withColumn("d", F.floor(F.col("id") / 100))
    assert corpus.cap_total_rows(df, "d", "d", ["id"], 250).count() == 200
    assert corpus.cap_total_rows(df, "d", "d", ["id"], 250, min_part=40).count() == 250
    assert corpus.cap_total_rows(df, "d", "d", ["id"], 1000).count() == 400


def test_verify_batch(spark):
    df = spark.range(5)
    with pytest.raises(AssertionError, match="missing"):
        corpus.verify_batch(df, 5)
    with pytest.raises(AssertionError, match="mismatch"):
        corpus.verify_batch(df.withColumn("_source_meta", F.lit("")), 6)


def test_task_code_of_bad_json(spark):
    df = spark.createDataFrame([('{"task_type":"binary"}',), ("oops",), (None,), ('{"task_type":"multiclass"}',)], "_source_meta string")
    assert [r[0] for r in df.select(corpus.task_code()).collect()] == [1, 0, 0, 2]


def test_duplicate_share_compares_rows(spark, hot):
    df = spark.createDataFrame([("s", i % 60, None if i % 2 else "x") for i in range(120)], "g string, a int, b string")
    assert gates.duplicate_share(df, ["g"], ["a", "b"]).first().duplicate_share == pytest.approx(0.5)


def test_gate_order(spark):
    base = [(i, float(i % 5), float(i), "a" if i % 2 else "b") for i in range(120)]
    df = spark.createDataFrame(base, "id int, f double, u double, y string").withColumns({"d": F.lit(1), "task": F.lit("binary")})

    def reason(rows, **options):
        return gates.gate_verdict(rows, ["d"], "y", "task", ["f", "u"], ["f", "u"], **options).first().reason

    assert reason(df) == ""
    assert reason(df.withColumn("u", F.lit(1.0)).withColumn("y", F.lit("a"))) == "gate_fail: constant column u"
    assert reason(df.withColumn("y", F.lit("a"))) == "gate_fail: target has < 2 classes"
    assert reason(df.withColumn("y", F.when(F.col("id") == 0, "z").otherwise("a"))) == "gate_fail: minority_frac=0.0083"
    assert reason(df.filter("id < 99")) == "gate_fail: only 99 rows"
    assert reason(df.withColumn("u", F.col("id") % 3 * 1.0)) == "gate_fail: dupe_frac=0.75"
    assert reason(df.filter("id < 40").withColumn("u", F.lit(1.0)), rule="corpus") == "gate_fail: only 40 rows"


def test_utility_score(spark):
    df = spark.range(400).select("id", (F.col("id") % 2).alias("x"), F.rand(1).alias("noise"), (F.col("id") % 2).cast("string").alias("y"))
    assert gates.utility_score(df, ["x", "noise"], "y", "binary", ["id"], trees=5, depth=3) > 0.95
    three = df.withColumn("y", (F.col("id") % 3).cast("string")).withColumn("x", F.col("id") % 3)
    assert gates.utility_score(three, ["x", "noise"], "y", "multiclass", ["id"], folds=2, trees=5, depth=3) > 0.9
    real = df.withColumn("y", F.col("x") * 3.0)
    assert gates.utility_score(real, ["x"], "y", "regression", ["id"], folds=2, trees=5, depth=3, sample_rows=300) > 0.9


def test_correlation_limit_and_constants(spark):
    df = spark.range(50).select(*[(F.col("id") * (i + 1) % 17).alias(f"c{i}") for i in range(6)], F.lit(1).alias("one"))
    assert gates.pairwise_correlations(df, df.columns).count() == 21
    assert gates.pairwise_correlations(df, ["c0", "one"]).first().correlation is None
    assert gates.max_pairwise_correlation(df, ["c0", "one"]).first().max_correlation == 0
    assert gates.max_pairwise_correlation(df, ["c0"]).first().note == ""
    many = spark.range(50).select(*[(F.col("id") * (i + 1) % 71).alias(f"c{i}") for i in range(70)])
    assert gates.pairwise_correlations(many, many.columns).count() == 70 * 69 // 2
    gaps = spark.createDataFrame([(float(i), float(i * i) if i % 3 else None, 7.5 if i % 2 else None) for i in range(60)], "a double, b double, c double")
    got = {(r.left, r.right): r.correlation for r in gates.pairwise_correlations(gaps, ["a", "b", "c"]).collect()}
    assert got["a", "b"] == pytest.approx(gaps.toPandas()[["a", "b"]].corr().iloc[0, 1])
    assert got["a", "c"] is None and got["b", "c"] is None


def test_structural_order(spark):
    with pytest.raises(ValueError):
        augment.structural_columns(spark.range(3), {"a": {"b": 1.0}, "b": {"id": 1.0}})


def test_bins_of_constant_column(spark):
    df = spark.range(10).withColumn("c", F.lit(4.0))
    assert {r[0] for r in augment.bin_to_words(df, "c", ["low", "high"], "w").select("w").collect()} == {"low"}


def test_tree_rule_stops_at_constant_nodes(spark):
    df = spark.range(40).select((F.col("id") % 2).alias("a"), F.lit(1).alias("b"))
    assert augment.tree_rule_label(df, ["b", "a"], [0.5, 0.5], 3).select("label").distinct().count() == 1


def test_next_pending_and_duplicate_key(spark):
    queue = spark.createDataFrame([("a", "done", 0, 0), ("b", "pending", 5, 1), ("c", "pending", 2, 2), ("d", "pending", 2, 3)],
                                  "dataset_id string, status string, priority int, inserted int")
    assert budget.next_pending(queue).first().dataset_id == "c"
    assert budget.next_pending(queue.filter("status = 'done'")).count() == 0
    with pytest.raises(ValueError, match="already"):
        budget.assert_new_keys(queue, queue.limit(1))


def test_evict_reports_nothing_within_budget(spark):
    files = spark.createDataFrame([("a", 10, "2024-01-01"), ("b", 20, "2024-01-02")], "path string, size bigint, modified string")
    files = files.withColumn("modified", F.to_timestamp("modified"))
    assert budget.evict_to_budget(files, F.lit("2024-02-01"), 30).filter("removed").count() == 0
    assert [r.path for r in budget.evict_to_budget(files, F.lit("2024-02-01"), 15).filter("removed").collect()] == ["b"]


def test_registry_keeps_error(spark):
    jobs = spark.createDataFrame([("j", "running", None, "kept", "r", 2)], "experiment_name string, status string, heartbeat_at timestamp, last_error string, repo_id string, failure_count int")
    out = metrics.reconcile_stale(jobs, F.lit("2024-01-01"))
    assert (out.first().status, out.first().last_error) == ("orphaned", "kept")
    assert metrics.alerts(out).first().alert == "j: status=orphaned failures=2 repo=r"


def test_status_transition_cuts_notes(spark):
    reg = spark.createDataFrame([("a", "new", "x retry=2"), ("b", "new", "")], "id string, status string, notes string")
    updates = spark.createDataFrame([("a", "download_fail", "n" * 200), ("b", "ok", "fine")], "id string, new_status string, new_notes string")
    rows = {r.id: r for r in registry.status_transition(reg, updates, "id").collect()}
    assert rows["a"].notes == "n" * 150 + " retry=3" and rows["b"].notes == "fine"


def test_roc_auc_single_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.5)], "y int, s double")
    row = metrics.classification_metrics(df, "y", "s").first()
    assert row.accuracy == 1.0 and row.roc_auc is None


def test_roc_auc_hot_path(spark, skewed, hot):
    df = skewed.filter("x is not null").select((F.col("id") % 3 == 0).cast("int").alias("y"), "x", "grp")
    fast = metrics.roc_auc(df, "y", "x", ["grp"]).collect()
    spark.conf.unset("corpusloom.hotRows")
    assert {r.grp: round(r.roc_auc, 9) for r in fast if r.roc_auc is not None} == {
        r.grp: round(r.roc_auc, 9) for r in metrics.roc_auc(df, "y", "x", ["grp"]).collect() if r.roc_auc is not None}


def test_read_table_formats(spark):
    df = spark.createDataFrame([(1, 'say "hi", you\nnext', None), (2, "b\tc", 2.5)], "a int, s string, d double")
    root = new_run_dir(spark, "formats")
    for kind in ("csv", "tsv", "parquet", "jsonl"):
        tables.write_table(df, f"{root}/t.{kind}")
        assert sorted(map(repr, tables.read_table(spark, f"{root}/t.{kind}", df.schema).collect())) == sorted(map(repr, df.collect())), kind
    assert dict(tables.read_table(spark, f"{root}/t.csv").dtypes)["d"] == "double"
    for bad in (f"{root}/t.xlsx", f"{root}/t"):
        with pytest.raises(ValueError, match="Unsupported"):
            tables.read_table(spark, bad)


def test_file_inventory_skips_bad_files(spark):
    import os

    root = new_run_dir(spark, "inventory")
    os.makedirs(f"{root}/deep/er")
    open(f"{root}/a.csv", "w").write('id,"x, y"\n1,"two\nlines"\n2,b\n')
    open(f"{root}/deep/er/b.csv", "w").write("only\n")
    open(f"{root}/deep/bad.csv", "wb").write(b"id\n\xff\xfe\n")
    open(f"{root}/deep/c.txt", "w").write("id\n1\n")
    found = {r.path.rsplit("/", 1)[-1]: (r.columns, r.row_count) for r in tables.file_inventory(spark, root).collect()}
    assert found == {"a.csv": (["id", "x, y"], 2), "b.csv": (["only"], 0)}


def test_catalog_source(spark):
    root = new_run_dir(spark, "catalog")
    doc = {"version": 1, "datasets": [{"id": "a", "recommended": True, "est_rows": 5}, {"id": "b", "recommended": False, "est_rows": None}]}
    tables.write_artifact(spark, root, json.dumps(doc, indent=1))
    rows = tables.catalog_source(spark, root, "id string, recommended boolean, est_rows bigint").collect()
    assert [tuple(r) for r in rows] == [("a", True, 5), ("b", False, None)]


def test_next_index_default(spark):
    names = spark.createDataFrame([("train-00007.parquet",), ("train-x.parquet",), ("train-00012.parquet",)], "n string")
    assert tables.next_index(names, "n", tables.INDEX_PATTERNS["shard"]).first()[0] == 13
    assert tables.next_index(names, "n", tables.INDEX_PATTERNS["batch"], default=1).first()[0] == 1


def test_deep_trees_are_planned_quickly(spark):
    df = spark.range(400).select(*[(F.col("id") * (i * 7 + 3) % 101).alias(f"c{i}") for i in range(8)])
    out = augment.tree_rule_label(df, df.columns, [0.5] * 8, 5)
    assert len(out._jdf.queryExecution().analyzed().toString()) < 60_000
    assert out.select("label").distinct().count() == 5
