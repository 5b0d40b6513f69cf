"""The stateless operators on streams, and the few stateful ones."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.functions.clock import epoch_micros
from corpusloom.functions.hashing import row_hash
from corpusloom.operators.encode import FrozenSchema, encode
from corpusloom.operators.features import TransformSpec, apply_transforms
from corpusloom.operators.infer import Target, resolve_target
from corpusloom.operators.columns import keep_scalar_columns
from corpusloom.operators.registry import registry_upsert
from corpusloom.operators.sampling import fixed_size_sample
from corpusloom.operators.scale import lookup_join, positions
from corpusloom.session import new_run_dir, stable


def stream_source(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet",
                  max_files: int | None = None, pattern: str | None = None) -> DataFrame:
    """File stream; `max_files` bounds what one trigger takes in."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append",
                  partition_by: Sequence[str] = ()) -> DataFrame:
    """Write all that is there to Parquet, then stop. The checkpoint keeps source offsets and
    state, so a restart goes on where the last run ended."""
    writer = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.trigger(availableNow=True).start(path).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Call `handle(rows, batch_id)` per micro-batch until the input is used up. A batch may be
    handled again after a failure, so `handle` must overwrite."""
    (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
     .foreachBatch(handle).trigger(availableNow=True).start().awaitTermination())


class MergedTable:
    """A keyed table to which each micro-batch adds what it changes; what is written follows the batch.

    A batch is a part of its own, and counts from the moment its mark is in the log. When FAN parts of
    one size follow each other they are merged by key into one, so a row is written again once for each
    power of FAN batches, and a reader merges fewer than FAN parts of each size. A batch that is handled
    again after a failure finds its mark and changes nothing; files without a mark are replaced. Parts
    that were merged stay until their folder is removed, so running readers are not disturbed.

    `merge` reduces rows of several parts to one row per key. It may use the column `__batch`, the last
    batch that a row covers, and must keep it.
    """

    FAN = 8

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, merge: Callable[[DataFrame], DataFrame]) -> None:
        self.spark, self.path, self.schema, self.merge = spark, path, schema, merge
        self.stored = T.StructType([*schema.fields, T.StructField("__batch", T.LongType())])
        # the log begins with an empty entry, so that it can always be read
        self._marks([]).write.mode("ignore").parquet(f"{path}/log/begin")
        marks = spark.read.schema("first long, last long").parquet(f"{path}/log/*").collect()
        self.live: list[tuple[int, int]] = []
        for first, last in sorted((tuple(m) for m in marks), key=lambda m: (m[0], -m[1])):
            if not self.live or last > self.live[-1][1]:  # a part inside another one was merged into it
                self.live.append((first, last))

    def _marks(self, marks: list[tuple[int, int]]) -> DataFrame:
        return self.spark.createDataFrame(marks, "first long, last long").coalesce(1)

    def _put(self, rows: DataFrame, first: int, last: int) -> None:
        rows.select(*self.stored.names).write.mode("overwrite").parquet(f"{self.path}/parts/{first}-{last}")
        self._marks([(first, last)]).write.mode("overwrite").parquet(f"{self.path}/log/{first}-{last}")
        self.live = [p for p in self.live if p[0] < first or p[1] > last] + [(first, last)]

    def _rows(self, parts: Sequence[tuple[int, int]]) -> DataFrame:
        paths = [f"{self.path}/parts/{first}-{last}" for first, last in parts]
        return self.spark.read.schema(self.stored).parquet(*paths) if paths else self.spark.createDataFrame([], self.stored)

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Add one row per key that the batch changes."""
        if not any(first <= batch_id <= last for first, last in self.live):
            self._put(rows.withColumn("__batch", F.lit(batch_id).cast("bigint")), batch_id, batch_id)
        span = self.FAN
        while (batch_id + 1) % span == 0:
            inside = [p for p in self.live if p[0] > batch_id - span and p[1] <= batch_id]
            if len(inside) > 1:
                self._put(self.merge(self._rows(inside)), batch_id + 1 - span, batch_id)
            span *= self.FAN

    def current(self) -> DataFrame:
        return self.merge(self._rows(self.live)).select(*self.schema.names)


class LiveTable:
    """A small table that every micro-batch replaces as a whole, for results of a few rows. Two folders take turns, so the result of the
    batch before stays readable while a batch is written or repeated."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType) -> None:
        self.spark, self.path, self.schema = spark, path, schema
        self.stored = T.StructType([*schema.fields, T.StructField("__batch", T.LongType())])

    def write(self, rows: DataFrame, batch_id: int) -> None:
        stamped = rows.select(*self.schema.names).withColumn("__batch", F.lit(batch_id).cast("bigint"))
        stamped.write.mode("overwrite").parquet(f"{self.path}/slot={batch_id % 2}")

    def start(self) -> None:
        """An empty table that can be read before the first batch."""
        self.spark.createDataFrame([], self.stored).write.mode("ignore").parquet(f"{self.path}/slot=none")

    def before(self, batch_id: int) -> DataFrame:
        if batch_id == 0:
            return self.spark.createDataFrame([], self.schema)
        stored = self.spark.read.schema(self.stored).parquet(f"{self.path}/slot={(batch_id - 1) % 2}")
        return stored.select(*self.schema.names)

    def current(self) -> DataFrame:
        stored = self.spark.read.schema(self.stored).parquet(self.path)
        last = stored.agg(F.max("__batch")).first()[0]
        return stored.filter(F.col("__batch") == F.lit(last)).select(*self.schema.names)


def stream_transform(stream: DataFrame, spec: TransformSpec) -> DataFrame:
    """Replay fitted transforms: the same expressions and static lookups as in batch."""
    return apply_transforms(stream, spec)


def stream_encode(stream: DataFrame, spec: TransformSpec, schema: FrozenSchema, keep: Sequence[str] = (),
                  unseen: str = "error") -> DataFrame:
    return encode(apply_transforms(stream, spec), schema, unseen=unseen, keep=keep)


def skip_and_limit(df: DataFrame, offset: str, skip: int = 0, limit: int | None = None) -> DataFrame:
    """Rows with 0-based `offset` from `skip` on, at most `limit` of them. The offset is a column of
    the source, so the filter is stateless and survives restarts."""
    out = df.filter(F.col(offset) >= skip)
    return out if limit is None else out.filter(F.col(offset) < skip + limit)


def buffer_shuffle(stream: DataFrame, order: Sequence[str], path: str, checkpoint: str, seed: int = 0,
                   size: int = 10_000) -> DataFrame:
    """Shuffle through a buffer of `size` rows that lives across batches; adds the 1-based `position`.

    The first rows fill the slots of the buffer; every later row goes to a hashed slot, and the row that was
    there comes out. So a row comes out when its slot is next hit: a look ahead within the slot, which all
    slots do at once. Rows whose slot was not hit yet are the buffer, and the only state. What is still
    there when the stream ends comes out last, in hash order. Rows arrive in `order`, which must be total,
    and batches in the order of their rows; the result does not depend on where batches end.
    """
    spark, index = stream.sparkSession, "__index"
    columns = stream.columns
    kind = T.StructType([*stream.schema.fields, T.StructField(index, T.LongType())])
    buffer = LiveTable(spark, f"{path}/held", kind)
    out = T.StructType([*stream.schema.fields, T.StructField("position", T.LongType())])
    # an empty first part, so that the folder exists even if the stream has no rows
    spark.createDataFrame([], out).write.mode("ignore").parquet(f"{path}/out/buffer=-1")
    buffer.start()
    hashed = F.conv(F.substring(row_hash(seed, index), 1, 13), 16, 10).cast("bigint") % size
    slot = F.when(F.col(index) < size, F.col(index)).otherwise(hashed)

    def handle(rows: DataFrame, batch_id: int) -> None:
        held = buffer.before(batch_id)
        seen = held.agg(F.coalesce(F.max(index) + 1, F.lit(0))).first()[0]  # the latest row is always held
        placed = positions(rows, [], list(order), index).withColumn(index, F.col(index) - 1 + seen)
        both = stable(held.unionByName(placed).withColumn(
            "__next", F.lead(index).over(Window.partitionBy(slot).orderBy(index))))
        leaving = both.filter("__next IS NOT NULL").withColumn("position", F.col("__next") - size + 1)
        leaving.select(*columns, "position").write.mode("overwrite").parquet(f"{path}/out/buffer={batch_id}")
        buffer.write(both.filter("__next IS NULL").select(*columns, index), batch_id)

    run_batches(stream, handle, checkpoint)
    held = buffer.current()
    before = F.greatest(F.max(index).over(Window.partitionBy()) + 1 - size, F.lit(0))
    last = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(row_hash(seed, F.lit("last"), index)))  # at most `size` rows
    rest = held.withColumn("position", (before + last).cast("bigint")).select(*columns, "position")
    return spark.read.schema(out).option("recursiveFileLookup", True).parquet(f"{path}/out").unionByName(rest)


def bootstrap_sample(stream: DataFrame, n: int, key: Sequence[str], path: str, checkpoint: str, seed: int = 0,
                     target: str | None = None, task: str | None = None) -> tuple[DataFrame, Target]:
    """Flat columns of `n` hash-ordered rows of a stream, with the resolved target. Each batch
    keeps its own `n` smallest hashes, so only those are stored."""
    flat_columns = keep_scalar_columns(stream)[0].columns

    def handle(rows: DataFrame, batch_id: int) -> None:
        fixed_size_sample(rows.select(*flat_columns), n, key, seed).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    spark, schema = stream.sparkSession, stream.select(*flat_columns).schema
    # an empty first part, so that the folder exists even if the stream has no rows
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/batch=none")
    run_batches(stream, handle, checkpoint)
    kept = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)
    sample = fixed_size_sample(kept, n, key, seed)
    if sample.isEmpty():
        raise ValueError("The stream has no rows to sample.")
    return sample, resolve_target(sample, target, task)


def row_counters(stream: DataFrame, batch_size: int, path: str, checkpoint: str) -> DataFrame:
    """Rows seen and steps taken so far; the running count is streaming state."""
    counted = stream.groupBy().agg(F.count(F.lit(1)).alias("rows_seen"))
    counted = counted.withColumn("global_step", F.ceil(F.col("rows_seen") / batch_size))
    return latest_result(counted, path, checkpoint)


def latest_result(aggregated: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Complete result of a streaming aggregate, replaced at every batch."""
    result = LiveTable(aggregated.sparkSession, path, aggregated.schema)
    run_batches(aggregated, result.write, checkpoint, mode="complete")
    return result.current()


def live_dashboard(stream: DataFrame, status: str, path: str, checkpoint: str) -> DataFrame:
    """Jobs per status, refreshed every batch."""
    return latest_result(stream.groupBy(status).agg(F.count(F.lit(1)).alias("n")), path, checkpoint)


def live_upsert(stream: DataFrame, key: Sequence[str], order: Sequence[str], path: str, checkpoint: str) -> DataFrame:
    """Latest row per key by `order`, of equal rows the one of the later batch. A batch writes its own
    latest rows only. Null keys are keys."""
    result = MergedTable(stream.sparkSession, path, stream.schema, lambda rows: registry_upsert(rows, key, [*order, "__batch"]))
    run_batches(stream, lambda rows, batch_id: result.add(registry_upsert(rows, key, order), batch_id), checkpoint)
    return result.current()


def heartbeat_timeout(stream: DataFrame, job: str, ts: str, silent_seconds: int, delay: str = "0 seconds") -> DataFrame:
    """(job, state, at): a job becomes stale when it is silent for longer than `silent_seconds`,
    noticed from the next heartbeat or from the event-time timer, and recovered by the next
    heartbeat. `at` is the last heartbeat for stale and the new one for recovered.

    A null job is a job; heartbeats without a time are left out. Before the shuffle each task keeps only the first and last heartbeat of a job per half
    silence: what lies between them cannot border a silence. A chatty job thus sends a handful
    of rows.
    """
    gap = silent_seconds * 1_000_000
    kind = stream.schema[job].dataType.simpleString()
    beats = stream.select(job, epoch_micros(ts, stream.schema[ts].dataType).alias("us")).filter("us IS NOT NULL")

    def thin(batches):
        for batch in batches:
            job_, us = batch.columns
            rows = pa.table({"job": job_, "us": us, "slot": pc.divide(us, max(gap // 2, 1))})
            ends = rows.group_by(["job", "slot"]).aggregate([("us", "min"), ("us", "max")])  # null is a job like others
            for edge in ("us_min", "us_max"):
                for part in ends.select(["job", edge]).rename_columns(batch.schema.names).to_batches():
                    yield part

    beats = beats.mapInArrow(thin, beats.schema).withColumn("at", F.timestamp_micros("us")).withWatermark("at", delay)

    def follow(key, batches, state: GroupState):
        last, stale = state.get if state.exists else (None, False)
        gone, back = [], []
        if state.hasTimedOut:
            if not stale:
                gone.append(last)
            stale = True
        else:
            times = np.unique(np.concatenate([pdf["us"].to_numpy(dtype=np.int64) for pdf in batches]))
            if last is not None:
                times = times[times >= last]
                if stale and len(times):
                    back.append(int(times[0]))
                    stale, last = False, None
            if last is not None:
                times = np.concatenate([[last], times])
            breaks = np.flatnonzero(np.diff(times) > gap)
            gone += times[breaks].tolist()
            back += times[breaks + 1].tolist()
            last = int(times[-1]) if len(times) else last
            if not stale:
                # the first whole millisecond at which the silence is longer than allowed
                due = (last + gap) // 1000 + 1
                if due > state.getCurrentWatermarkMs():
                    state.setTimeoutTimestamp(due)
                else:
                    gone.append(last)
                    stale = True
        state.update((last, stale))
        found = [("stale", at) for at in gone] + [("recovered", at) for at in back]
        if found:
            yield pd.DataFrame([(key[0], s, at) for s, at in found], columns=[job, "state", "at_us"])

    return beats.groupBy(job).applyInPandasWithState(
        follow, f"`{job}` {kind}, state string, at_us bigint", "last bigint, stale boolean", "append",
        GroupStateTimeout.EventTimeTimeout)


def live_best(stream: DataFrame, experiment: str, order: str, value: str, path: str, checkpoint: str) -> DataFrame:
    """Per experiment: rows seen, best value so far, and rows since it last improved.

    A batch is reduced to one row per experiment it holds: its rows, its best value, and its rows after
    that. Such rows can be merged in batch order without the rows behind them: the best value is the
    least one, of the earliest part that has it, and what came later only adds to the patience. Null
    is an experiment like any other.
    """
    kind = T.StructType([stream.schema[experiment], *T.DataType.fromDDL("seen bigint, best double, patience bigint").fields])

    def reduce(rows: DataFrame) -> DataFrame:
        slim = rows.select(experiment, F.col(order).alias("o"), F.col(value).cast("double").alias("v"))
        best = slim.filter("v is not null").groupBy(experiment).agg(F.min(F.struct("v", "o")).alias("m"))
        return lookup_join(slim, best, [experiment]).groupBy(experiment).agg(
            F.count(F.lit(1)).alias("seen"), F.first("m.v").alias("best"),
            F.count_if(F.col("m").isNull() | (F.col("o") > F.col("m.o"))).alias("patience"))

    def merge(rows: DataFrame) -> DataFrame:
        # few rows per experiment: one from each part that holds it
        own = Window.partitionBy(experiment)
        first = F.min(F.when(F.col("best").isNotNull(), F.struct("best", "__batch", "patience"))).over(own)
        rows = rows.withColumn("__m", first)
        later = F.col("__m").isNull() | (F.col("__batch") > F.col("__m.__batch"))
        return rows.groupBy(experiment).agg(
            F.sum("seen").alias("seen"), F.first("__m.best").alias("best"),
            (F.coalesce(F.first("__m.patience"), F.lit(0)) + F.sum(F.when(later, F.col("seen")).otherwise(0))).alias("patience"),
            F.max("__batch").alias("__batch"))

    result = MergedTable(stream.sparkSession, path, kind, merge)
    run_batches(stream, lambda rows, batch_id: result.add(reduce(rows), batch_id), checkpoint)
    return result.current()


def work_paths(spark: SparkSession, label: str) -> tuple[str, str]:
    """Fresh output and checkpoint folders in the shared work folder."""
    root = new_run_dir(spark, label)
    return f"{root}/out", f"{root}/checkpoint"
