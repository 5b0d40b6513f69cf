"""Queries for section N: each stream is run to its end and must equal the batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import encode as enc, features as feat
from corpusloom.streaming import seeking
from corpusloom.streaming import streams as ops
from .e_features import CATEGORICAL, EV_SQL, NUMERIC, _E6, _shape, collapse_sql, sample_events
from .registry import query, table


def events_stream(spark, sf, **options):
    return ops.stream_source(spark, sf, table(spark, sf, "events").schema, pattern="events.parquet", **options)


def sample_stream(spark, sf):
    """`sample_events` on the stream."""
    events = events_stream(spark, sf)
    return events.select(
        "event_id", F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("value"),
        F.when(F.col("event_id") % 13 != 0, F.floor(F.col("value") / 10).cast("string")).alias("bucket"),
        "props", F.col("user_id").cast("string").alias("user_text"), "event_type")


@query("n1_stream_source", "select event_id, user_id, event_type, value from events")
def n1(spark, sf):
    stream = events_stream(spark, sf, max_files=1).select("event_id", "user_id", "event_type", "value")
    return ops.run_available(stream, *ops.work_paths(spark, "n1"))


@query("e7_apply_transforms_stream", _E6)
def e7(spark, sf):
    spec = feat.fit_transforms(sample_events(spark, sf), NUMERIC, CATEGORICAL)
    return _shape(ops.run_available(ops.stream_transform(sample_stream(spark, sf), spec), *ops.work_paths(spark, "e7")))


@query("n2_stream_encode", f"""
with {EV_SQL}, {collapse_sql('bucket')}, b as (select event_id, if((select collapses from bucket_s), if(keep, v, '__RARE__'), v) as cat
  from ev join bucket_v on v = coalesce(bucket, '__MISSING__')),
s as (select median(value) as f from ev), z as (select avg(coalesce(value, f)) as m, stddev_pop(coalesce(value, f)) as sd from ev, s)
select event_id, round(((coalesce(value, f) - m) / sd)::float::double, 4) as value, dense_rank() over (order by cat) as bucket,
  dense_rank() over (order by event_type) - 1 as y, value is not null as value_here from ev join b using (event_id), s, z""")
def n2(spark, sf):
    batch = sample_events(spark, sf).drop("props", "user_text")
    spec = feat.fit_transforms(batch, ["value"], ["bucket"])
    schema = enc.build_schema(feat.apply_transforms(batch, spec), "event_type", "multiclass", ["value"], ["bucket"])
    stream = ops.stream_encode(sample_stream(spark, sf).drop("props", "user_text"), spec, schema, keep=["event_id"])
    out = ops.run_available(stream, *ops.work_paths(spark, "n2"))
    return out.select("event_id", F.round(F.col("x_num")[0].cast("double"), 4).alias("value"), F.col("x_cat")[0].alias("bucket"), "y",
                      F.col("num_mask")[0].alias("value_here"))


@query("n3_skip_and_limit", "select event_id, value from events where event_id >= 100 and event_id < 100 + 700")
def n3(spark, sf):
    stream = ops.skip_and_limit(events_stream(spark, sf).select("event_id", "value"), "event_id", 100, 700)
    return ops.run_available(stream, *ops.work_paths(spark, "n3"))


def seeking_events(spark, sf, label):
    """Events in order as four files, and the folders of a stream over them."""
    (source, log), events = ops.work_paths(spark, label), table(spark, sf, "events").select("event_id", "value")
    return events.repartitionByRange(4, "event_id").sortWithinPartitions("event_id"), events.schema, source, log


@query("n3_skip_and_limit_seeking", """
select event_id, value, n from (select event_id, value, row_number() over (order by event_id) - 1 as n from events)
where n >= 100 and n < 100 + 700""")
def n3_seeking(spark, sf):
    events, schema, source, log = seeking_events(spark, sf, "n3-seek")
    events.write.parquet(source)
    stream = seeking.seeking_source(spark, source, schema, log, skip=100, limit=700, number="n")
    return ops.run_available(stream, *ops.work_paths(spark, "n3-seek-out"))


@query("n6_resume_seeking", "select event_id, value, row_number() over (order by event_id) - 1 as n from events")
def n6_seeking(spark, sf):
    events, schema, source, log = seeking_events(spark, sf, "n6")
    where = ops.work_paths(spark, "n6-out")
    half = table(spark, sf, "events").agg(F.median("event_id")).first()[0]
    for part in (F.col("event_id") <= half, F.col("event_id") > half):  # files that come later; a restart each
        events.filter(part).write.mode("append").parquet(source)
        out = ops.run_available(seeking.seeking_source(spark, source, schema, log, number="n"), *where)
    return out


@query("n4_buffer_shuffle", """
with i as (select event_id, value, row_number() over (order by event_id) - 1 as i from events),
s as (select *, if(i < 1000, i, ('0x' || substr(md5('3:' || i), 1, 13))::bigint % 1000) as slot from i),
n as (select *, lead(i) over (partition by slot order by i) as nxt, count(*) over () as n from s)
select event_id, value, nxt - 1000 + 1 as position from n where nxt is not null
union all select event_id, value, greatest(n - 1000, 0) + row_number() over (order by md5('3:last:' || i)) from n where nxt is null""")
def n4(spark, sf):
    source, checkpoint = ops.work_paths(spark, "n4")
    events = table(spark, sf, "events").select("event_id", "value")
    events.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").write.parquet(source)
    stream = ops.stream_source(spark, source, events.schema)
    return ops.buffer_shuffle(stream, ["event_id"], ops.work_paths(spark, "n4-out")[0], checkpoint, seed=3, size=1000)


@query("n5_bootstrap_sample", """
select event_id, value, event_type, 'event_type' as target_column from events order by md5('5:' || event_id) limit 800""")
def n5(spark, sf):
    stream = events_stream(spark, sf).select("event_id", "value", "event_type", F.array("user_id").alias("nested"))
    sample, target = ops.bootstrap_sample(stream, 800, ["event_id"], *ops.work_paths(spark, "n5"), seed=5, target="event_type")
    return sample.withColumn("target_column", F.lit(target.column))


@query("n6_resume", "select event_id, value from events")
def n6(spark, sf):
    """Two runs with one checkpoint; the second sees only the files that came in between."""
    events = table(spark, sf, "events").select("event_id", "value")
    source, checkpoint = ops.work_paths(spark, "n6")
    target, _ = ops.work_paths(spark, "n6-out")
    early = F.col("event_id") % 2 == 0
    out = None
    for part in (events.filter(early), events.filter(~early)):
        part.write.mode("append").parquet(source)
        out = ops.run_available(ops.stream_source(spark, source, events.schema), target, checkpoint)
    return out


@query("n7_row_counters", "select count(*) as rows_seen, ceil(count(*) / 64)::bigint as global_step from events")
def n7(spark, sf):
    return ops.row_counters(events_stream(spark, sf).select("event_id"), 64, *ops.work_paths(spark, "n7"))


@query("n8_heartbeat_timeout", """
with b as (select user_id, epoch_us(ts) as us, lead(epoch_us(ts)) over (partition by user_id order by ts) as nxt, max(epoch_us(ts)) over () as top from events)
select user_id, 'stale' as state, us as at_us from b where nxt - us > 86400000000
  or (nxt is null and (us + 86400000000) // 1000 + 1 <= top // 1000)
union all select user_id, 'recovered', nxt from b where nxt - us > 86400000000""")
def n8(spark, sf):
    stream = ops.heartbeat_timeout(events_stream(spark, sf), "user_id", "ts", 86_400)
    return ops.run_available(stream, *ops.work_paths(spark, "n8"))


@query("n9_append_log", "select event_id, event_type from events")
def n9(spark, sf):
    stream = events_stream(spark, sf).select("event_id", "event_type")
    return ops.run_available(stream, *ops.work_paths(spark, "n9"), partition_by=["event_type"])


@query("n10_live_dashboard", "select event_type, count(*) as n from events group by event_type")
def n10(spark, sf):
    return ops.live_dashboard(events_stream(spark, sf), "event_type", *ops.work_paths(spark, "n10"))


@query("n11_live_best", """
with b as (select *, row_number() over (partition by user_id order by event_id) as rn, count(*) over (partition by user_id) as n,
  min(value) over (partition by user_id) as best from events)
select user_id, any_value(n) as seen, any_value(best) as best, any_value(n) - min(rn) as patience from b where value = best group by user_id""")
def n11(spark, sf):
    return ops.live_best(events_stream(spark, sf), "user_id", "event_id", "value", *ops.work_paths(spark, "n11"))


@query("n12_live_upsert", """
select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by event_id desc) as rn from events) where rn = 1""")
def n12(spark, sf):
    stream = events_stream(spark, sf).select("user_id", "event_id", "event_type", "value")
    return ops.live_upsert(stream, ["user_id"], ["event_id"], *ops.work_paths(spark, "n12"))
