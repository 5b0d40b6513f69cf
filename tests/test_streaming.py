"""Streams over several batches and restarts must equal the batch result."""

import hashlib

import pytest
from pyspark.sql import functions as F, types as T

from corpusloom.streaming import streams as ops


def feed(spark, df, label, pieces, order):
    """Write `df` as ordered pieces; returns the source folder and a function that adds the next."""
    source, checkpoint = ops.work_paths(spark, label)
    bounds = df.approxQuantile(order, [i / pieces for i in range(1, pieces)], 0.0)
    edges = [float("-inf"), *bounds, float("inf")]

    def add(i):
        part = df.filter((F.col(order) > edges[i]) & (F.col(order) <= edges[i + 1]))
        part.coalesce(1).write.mode("append").parquet(source)

    return source, checkpoint, add


def silences(rows, gap, until):
    """Brute force: (user, state, at) for sorted heartbeats per user."""
    found = []
    for user, times in rows.items():
        times = sorted(set(times))
        for a, b in zip(times, times[1:]):
            if b - a > gap:
                found += [(user, "stale", a), (user, "recovered", b)]
        if times[-1] + gap < until:
            found.append((user, "stale", times[-1]))
    return sorted(found)


def test_heartbeats_over_batches(spark):
    rows = [(i % 5 if i % 7 else 9, i * 40 + (i * i) % 30 + (5000 if i > 150 and i % 5 == 3 else 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "user bigint, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    source, checkpoint, add = feed(spark, df, "beats", 4, "s")
    target, _ = ops.work_paths(spark, "beats-out")
    for i in range(4):
        add(i)
        stream = ops.heartbeat_timeout(ops.stream_source(spark, source, df.schema), "user", "ts", 500)
        out = ops.run_available(stream, target, checkpoint)
    got = sorted((r["user"], r.state, r.at_us) for r in out.collect())
    per_user = {}
    for user, s in rows:
        per_user.setdefault(user, []).append(s * 1_000_000)
    assert got == silences(per_user, 500_000_000, max(s for _, s in rows) * 1_000_000)
    assert any(state == "recovered" for _, state, _ in got)


def test_heartbeats_without_a_job(spark):
    rows = [(None, 5), (None, 10), (None, 900), ("1", 5), ("1", 2000), ("1", None)]
    df = spark.createDataFrame(rows, "job string, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    source, checkpoint = ops.work_paths(spark, "no-job")
    df.write.parquet(source)
    stream = ops.heartbeat_timeout(ops.stream_source(spark, source, df.schema), "job", "ts", 500)
    out = ops.run_available(stream, ops.work_paths(spark, "no-job-out")[0], checkpoint).collect()
    second = 1_000_000
    assert sorted(((r.job or ""), r.state, r.at_us // second) for r in out) == [
        ("", "recovered", 900), ("", "stale", 10), ("", "stale", 900), ("1", "recovered", 2000), ("1", "stale", 5)]


def test_live_best_over_batches(spark):
    rows = [(i % 3, i, float((i * 53) % 97) if i % 10 else None) for i in range(120)]
    df = spark.createDataFrame(rows, "e bigint, o bigint, v double")
    source, checkpoint, add = feed(spark, df, "best", 3, "o")
    target, _ = ops.work_paths(spark, "best-out")
    for i in range(3):
        add(i)
        out = ops.live_best(ops.stream_source(spark, source, df.schema), "e", "o", "v", target, checkpoint)
    for e in range(3):
        seen, best, patience = 0, None, 0
        for _, _, v in [r for r in rows if r[0] == e]:
            seen, patience = seen + 1, patience + 1
            if v is not None and (best is None or v < best):
                best, patience = v, 0
        assert tuple(out.filter(F.col("e") == e).first()) == (e, seen, best, patience)


def test_upsert_and_counters_over_restarts(spark):
    df = spark.range(90).select((F.col("id") % 7).alias("k"), F.col("id").alias("o"), (F.col("id") * 2).alias("v"))
    source, checkpoint, add = feed(spark, df, "upsert", 3, "o")
    target, _ = ops.work_paths(spark, "upsert-out")
    counts, count_checkpoint = ops.work_paths(spark, "counts")
    for i in range(3):
        add(i)
        stream = ops.stream_source(spark, source, df.schema)
        latest = ops.live_upsert(stream, ["k"], ["o"], target, checkpoint)
        counter = ops.row_counters(ops.stream_source(spark, source, df.schema), 4, counts, count_checkpoint).first()
    assert sorted(tuple(r) for r in latest.collect()) == sorted((o % 7, o, o * 2) for o in range(83, 90))
    assert (counter.rows_seen, counter.global_step) == (90, 23)
    again = ops.live_upsert(ops.stream_source(spark, source, df.schema), ["k"], ["o"], target, checkpoint)
    assert again.count() == 7


def buffered(n, size, seed):
    """The rows 0 … n - 1 in the order in which a buffer lets them out."""
    def number(*parts):
        return hashlib.md5(":".join(map(str, (seed, *parts))).encode()).hexdigest()
    held, out = {}, []
    for i in range(n):
        slot = i if i < size else int(number(i)[:13], 16) % size
        if slot in held:
            out.append(held[slot])
        held[slot] = i
    return out + sorted(held.values(), key=lambda i: number("last", i))


@pytest.mark.parametrize("cuts", [[], [40], [3, 10, 11, 90, 91, 199]])
def test_buffer_lives_across_batches(spark, cuts):
    source, checkpoint = ops.work_paths(spark, "buffer")
    path, _ = ops.work_paths(spark, "buffer-out")
    edges = [0, *cuts, 200]
    for a, z in zip(edges, edges[1:]):  # every part is a batch after a restart
        spark.range(a, z).withColumn("x", F.lit(1)).coalesce(1).write.mode("append").parquet(source)
        out = ops.buffer_shuffle(ops.stream_source(spark, source, "id bigint, x int"), ["id"], path, checkpoint, seed=4, size=25)
        assert [r.id for r in out.orderBy("position").collect()] == buffered(z, 25, 4)
    assert [r.position for r in out.orderBy("position").collect()] == list(range(1, 201))
    assert out.columns == ["id", "x", "position"]
    assert max(spark.read.parquet(f"{path}/held/slot={i}").count() for i in (0, 1) if i < len(edges) - 1) <= 25


def test_empty_buffer(spark):
    source, checkpoint = ops.work_paths(spark, "no-buffer")
    spark.createDataFrame([], "id bigint").write.parquet(source)
    assert ops.buffer_shuffle(ops.stream_source(spark, source, "id bigint"), ["id"], ops.work_paths(spark, "no-buffer-out")[0], checkpoint).count() == 0


def test_bootstrap(spark):
    df = spark.createDataFrame([(1.0, "a", [1]), (2.0, "b", [2]), (3.0, "a", [3])], "feature_a double, label string, metadata array<int>")
    source, checkpoint = ops.work_paths(spark, "boot")
    df.write.parquet(source)
    out_path, _ = ops.work_paths(spark, "boot-out")
    sample, target = ops.bootstrap_sample(ops.stream_source(spark, source, df.schema), 2, ["feature_a"], out_path, checkpoint)
    assert sample.count() == 2 and sample.columns == ["feature_a", "label"] and target.column == "label"


def test_empty_stream_cannot_bootstrap(spark):
    source, checkpoint = ops.work_paths(spark, "none")
    spark.createDataFrame([], "id bigint, y string").write.parquet(source)
    out_path, _ = ops.work_paths(spark, "none-out")
    with pytest.raises(ValueError):
        ops.bootstrap_sample(ops.stream_source(spark, source, "id bigint, y string"), 2, ["id"], out_path, checkpoint)


def merged(spark, label):
    path, _ = ops.work_paths(spark, label)
    schema = T.StructType.fromDDL("k string, o bigint, v string")
    return path, lambda: ops.MergedTable(spark, path, schema, lambda rows: ops.registry_upsert(rows, ["k"], ["o", "__batch"]))


def test_merged_table_writes_what_changes(spark):
    path, table = merged(spark, "merged")
    live, expected = table(), {}
    for batch in range(20):
        rows = [(None if k == 2 else f"k{k}", batch // 2, f"{batch}-{k}") for k in range(batch % 3 + 1)] + [(f"only{batch}", 0, "x")]
        df = spark.createDataFrame(rows, "k string, o bigint, v string").coalesce(1)
        live.add(df, batch)
        expected.update({k: (o, v) for k, o, v in rows})
        assert spark.read.parquet(f"{path}/parts/{batch}-{batch}").count() == len(rows)
        if batch in (3, 7, 13):
            live.add(spark.createDataFrame([("k0", 99, "again")], "k string, o bigint, v string"), batch)  # repeated: no change
            live = table()  # a restart reads the log
    assert live.live == [(0, 7), (8, 15), (16, 16), (17, 17), (18, 18), (19, 19)]
    assert {r.k: (r.o, r.v) for r in live.current().collect()} == expected
    # a part without a mark does not count, and the next attempt replaces it
    spark.createDataFrame([("lost", 0, "x", 20)], "k string, o bigint, v string, __batch bigint").write.parquet(f"{path}/parts/20-20")
    again = table()
    assert again.current().filter("k = 'lost'").count() == 0
    again.add(spark.createDataFrame([("k1", 50, "new")], "k string, o bigint, v string"), 20)
    expected["k1"] = (50, "new")
    assert {r.k: (r.o, r.v) for r in table().current().collect()} == expected
    assert ops.MergedTable(spark, path + "-none", T.StructType.fromDDL("k string, o bigint"), lambda rows: rows).current().count() == 0


def test_live_best_merges_many_batches(spark):
    rows = [(None if i % 4 == 3 else i % 4, i, None if i % 10 == 0 or i % 4 == 2 else float((i * 29) % 31)) for i in range(180)]
    df = spark.createDataFrame(rows, "e bigint, o bigint, v double")
    source, checkpoint = ops.work_paths(spark, "best-many")
    for i in range(18):
        df.filter((F.col("o") >= 10 * i) & (F.col("o") < 10 * i + 10)).coalesce(1).write.mode("append").parquet(source)
    stream = ops.stream_source(spark, source, df.schema, max_files=1)
    found = {r.e: tuple(r)[1:] for r in ops.live_best(stream, "e", "o", "v", ops.work_paths(spark, "best-many-out")[0], checkpoint).collect()}
    for e in (0, 1, 2, None):
        seen, best, patience = 0, None, 0
        for _, _, v in [r for r in rows if r[0] == e]:
            seen, patience = seen + 1, patience + 1
            if v is not None and (best is None or v < best):
                best, patience = v, 0
        assert found[e] == (seen, best, patience)
