"""A source with offsets of its own: skips, limits, restarts and appended files."""

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpusloom.streaming import seeking
from corpusloom.streaming import streams as ops

SCHEMA = "id bigint, name string, at timestamp"


def put(spark, path, a, z, pieces=1):
    rows = spark.range(a, z, 1, pieces).select("id", F.concat(F.lit("n"), "id").alias("name"),
                                               F.timestamp_seconds("id").alias("at"), F.lit(1).alias("other"))
    rows.write.mode("append").option("parquet.block.row.count.limit", 20).parquet(path)


def run(spark, source, log, where, **options):
    return ops.run_available(seeking.seeking_source(spark, source, SCHEMA, log, number="n", **options), *where)


@pytest.mark.parametrize("task_rows", [1, 30, 10_000])
def test_skip_and_limit(spark, task_rows):
    source, log = ops.work_paths(spark, "seek")
    put(spark, source, 0, 200, 3)
    files = sorted(glob.glob(f"{source}/*.parquet"))
    assert max(pq.read_metadata(f).num_row_groups for f in files) > 1
    order = [i for f in files for i in pq.read_table(f)["id"].to_pylist()]
    for skip, limit in ((0, None), (5, 50), (70, 1), (199, 9), (200, None), (500, 3), (0, 0)):
        _, fresh = ops.work_paths(spark, "seek-log")
        out = run(spark, source, fresh, ops.work_paths(spark, "seek-out"), skip=skip, limit=limit, task_rows=task_rows)
        stop = len(order) if limit is None else skip + limit
        assert sorted((r.n, r.id, r.name, int(r["at"].timestamp())) for r in out.collect()) == \
            [(k, i, f"n{i}", i) for k, i in list(enumerate(order))[skip:stop]]


def test_ranges_open_only_what_they_need(spark):
    source, log = ops.work_paths(spark, "seek-ranges")
    put(spark, source, 0, 100)
    rows = seeking.RowLog(source, log)
    rows.find_new()
    sizes = rows.entries[0][1]
    assert sum(sizes) == 100 and len(sizes) > 2
    ends = [sum(sizes[:k]) for k in range(len(sizes) + 1)]
    for start in range(0, 101, 7):
        for end in range(start, 101, 9):
            for task_rows in (1, 25, 1000):
                parts = rows.ranges(start, end, task_rows)
                assert [(p.first, p.last, p.number) for p in parts] == [(p.number, p.number + p.last - p.first, p.number) for p in parts]
                assert [i for p in parts for i in range(p.first, p.last)] == list(range(start, end))
                for p in parts:  # the groups that hold these rows, and no other
                    assert p.groups == [k for k in range(len(sizes)) if ends[k] < p.last and ends[k + 1] > p.first]
                    assert p.before == ends[p.groups[0]]


def test_restarts_and_files_under_any_name(spark):
    source, log = ops.work_paths(spark, "seek-restart")
    where = ops.work_paths(spark, "seek-restart-out")
    assert run(spark, source, log, where).count() == 0  # no folder yet
    seen = []
    for a, z in ((0, 40), (40, 41), (41, 90)):
        put(spark, source, a, z)
        seen += range(a, z)
        out = run(spark, source, log, where)
        assert sorted((r.n, r.id) for r in out.collect()) == list(enumerate(seen))
        # what was read before is not opened again: it could not be read any more
        for file in glob.glob(f"{source}/*.parquet"):
            open(file, "wb").close()
    assert seeking.rows_seen(source, log) <= 90
    again = run(spark, source, log, where)
    assert again.count() == 90


def test_resume_without_a_checkpoint(spark):
    source, log = ops.work_paths(spark, "seek-resume")
    put(spark, source, 0, 60)
    run(spark, source, log, ops.work_paths(spark, "seek-first"), limit=25)
    run(spark, source, log, ops.work_paths(spark, "seek-none"), resume=True, limit=25)
    done = seeking.rows_seen(source, log)
    assert done in (0, 25)  # Spark commits a batch when the next one is planned
    log_of_25 = seeking.RowLog(source, log)
    log_of_25.commit(25)
    out = run(spark, source, log, ops.work_paths(spark, "seek-second"), resume=True)
    assert sorted(r.n for r in out.collect()) == list(range(25, 60))


def test_a_half_written_log_does_not_count(spark):
    source, log = ops.work_paths(spark, "seek-torn")
    put(spark, source, 0, 10)
    rows = seeking.RowLog(source, log)
    with open(f"{log}/0.json.new", "w") as f:
        f.write('[["torn')
    rows.find_new()
    again = seeking.RowLog(source, log)
    assert again.entries == [[f, s] for f, s in again.entries] and again.total() == 10
    again.find_new()
    assert again.parts == 1


def test_files_without_a_column(spark):
    source, log = ops.work_paths(spark, "seek-narrow")
    spark.range(5).write.parquet(source)
    out = run(spark, source, log, ops.work_paths(spark, "seek-narrow-out"))
    assert sorted((r.id, r.name) for r in out.collect()) == [(i, None) for i in range(5)]
