"""Queue order, budgets and job state over keyed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions.clock import epoch_micros
from .registry import first_per_key
from .scale import compute_once, lookup_join, positions, running

TASK_ORDER = ("binary", "multiclass", "regression")
QUEUE_COLUMNS = ("dataset_id", "prepared_dir", "task_type", "steps_per_cycle")


def estimate_batch_mb(rows: str, features: str, batch_size: int = 256, numeric: str | None = None,
                      categorical: str | None = None) -> Column:
    """Peak megabytes for one batch: four bytes a number, two a category, at least 15% of the
    table, times 1.5."""
    n, f = F.col(rows).cast("double"), F.col(features)
    used = F.least(F.lit(float(batch_size)), n)
    numbers = F.col(numeric) if numeric else F.floor(f / 2)
    categories = F.col(categorical) if categorical else f - numbers
    batch = used * numbers * 4 + used * categories * 2
    return F.greatest(batch, n * f * 4 * 0.15) * 1.5 / F.lit(1024.0 * 1024.0)


def normalize_task(column: str) -> Column:
    task = F.lower(F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("binary")))
    return (F.when(task.isin(*TASK_ORDER), task).when(F.contains(task, F.lit("class")), "binary")
            .when(F.contains(task, F.lit("regress")), "regression").otherwise("binary"))


def with_defaults(df: DataFrame, rows: str = "n_rows", features: str = "n_features") -> DataFrame:
    """1000 rows and 20 features where the count is missing or zero."""
    return df.withColumns({rows: F.coalesce(F.nullif(F.col(rows), F.lit(0)), F.lit(1000)),
                           features: F.coalesce(F.nullif(F.col(features), F.lit(0)), F.lit(20))})


def dedupe_keep_first(queue: DataFrame, key: str = "dataset_id", order: str = "inserted") -> DataFrame:
    return first_per_key(queue, [key], [order])


def inverse_size_priority(priority: str = "priority", size: str = "est_mb") -> Column:
    return F.col(priority) / F.greatest(F.lit(1.0), F.log10(F.greatest(F.col(size), F.lit(1.0))))


def round_robin(queue: DataFrame, task: str = "task_type", priority: str = "priority", order: str = "inserted",
                output: str = "position") -> DataFrame:
    """Cycle binary, multiclass, regression, each by falling priority; other tasks go last in
    insertion order."""
    slot = F.array_position(F.array(*[F.lit(t) for t in TASK_ORDER]), F.col(task))
    work = queue.withColumn("__slot", F.when(slot > 0, slot).otherwise(len(TASK_ORDER) + 1))
    work = work.withColumn("__rank", F.when(slot > 0, -F.col(priority)).otherwise(0.0))
    work = positions(work, ["__slot"], ["__rank", order], "__turn")
    work = work.withColumn("__last", F.col("__slot") > len(TASK_ORDER))
    return positions(work, [], ["__last", "__turn", "__slot"], output).drop("__slot", "__rank", "__turn", "__last")


def greedy_budget(queue: DataFrame, order: Sequence, size: str, budget: float, output: str = "selected") -> DataFrame:
    """Take an entry when it still fits, skip it otherwise; sizes must not be negative, and an entry
    without a size never fits.

    A round leaves out the entries that exceed what is left of the budget and takes the longest run of
    the others that fits, by running sums; the entry that ends the run is skipped. It is larger than
    what is left then, so two rounds halve the rest of the budget or the largest size that still
    counts. Only two numbers per round come to the driver.
    """
    placed = compute_once(positions(queue, [], order, "__pos"))
    amount = F.col(size).cast("double")
    spent, after, chosen = 0.0, 0, F.lit(False)
    while True:
        open_ = (F.col("__pos") > after) & (amount <= budget - spent)
        runs = running(placed.filter(open_).select("__pos", size), [], ["__pos"], amount, "__cum")
        fits = F.col("__cum") + F.lit(spent) <= budget
        taken, ends = runs.agg(F.max(F.when(fits, F.col("__cum"))), F.min(F.when(~fits, F.col("__pos")))).first()
        chosen = chosen | (open_ & (F.col("__pos") < ends) if ends is not None else open_)
        spent += taken or 0.0
        if ends is None:
            return placed.withColumn(output, F.coalesce(chosen, F.lit(False))).drop("__pos")
        after = ends


def queue_union(prepared: DataFrame, catalog: DataFrame, registry: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Prepared tables, catalog rows that have a prepared table, registry rows with status ok and
    a prepared table."""
    ids = prepared.select(key).distinct()
    known = lookup_join(catalog, ids, [key], how="left_semi").withColumn("source", F.lit("catalog"))
    good = lookup_join(registry.filter("status = 'ok'").drop("status"), ids, [key], how="left_semi")
    out = prepared.withColumn("source", F.lit("prepared"))
    for part in (known, good.withColumn("source", F.lit("registry"))):
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def queue_export(queue: DataFrame) -> DataFrame:
    return queue.select(*QUEUE_COLUMNS, F.lit(None).cast("bigint").alias("max_total_steps"))


def next_pending(queue: DataFrame, groups: Sequence[str] = (), order: str = "inserted") -> DataFrame:
    """Pending entry with the lowest priority value; ties go to the first inserted."""
    rest = [c for c in queue.columns if c not in groups]
    pick = F.min_by(F.struct(*rest), F.struct("priority", order)).alias("__r")
    pending = queue.filter("status = 'pending'")
    grouped = pending.groupBy(*groups).agg(pick) if groups else pending.agg(pick)
    return grouped.filter("__r is not null").select(*groups, "__r.*")


def queue_progress(queue: DataFrame, sessions: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Fold session rows into queue entries: totals, best loss, last time, done or pending."""
    sums = sessions.groupBy(key).agg(F.sum("steps_trained").alias("__steps"), F.sum("rows_seen").alias("__rows"),
                                     F.min("val_loss").alias("__best"), F.max("ended_at").alias("__last"))
    out = lookup_join(queue, sums, [key])
    total = F.col("total_steps") + F.coalesce("__steps", F.lit(0))
    touched = F.col("__last").isNotNull()
    return out.withColumns({
        "status": F.when(~touched, F.col("status")).when(total >= F.col("max_total_steps"), "done").otherwise("pending"),
        "total_steps": total, "total_rows_seen": F.col("total_rows_seen") + F.coalesce("__rows", F.lit(0)),
        "best_val_loss": F.least("best_val_loss", "__best"), "last_session_at": F.coalesce("__last", "last_session_at"),
    }).drop("__steps", "__rows", "__best", "__last")


def step_budget(queue: DataFrame) -> DataFrame:
    return queue.withColumns({
        "remaining_steps": F.greatest(F.lit(0), F.col("max_total_steps") - F.col("total_steps")),
        "next_target": F.least(F.col("total_steps") + F.col("steps_per_cycle"), F.col("max_total_steps"))})


def queue_status(queue: DataFrame) -> DataFrame:
    """Entries per status, and steps done against the budget."""
    done, budget = F.sum("total_steps"), F.sum("max_total_steps")
    percent = F.coalesce(F.round(F.try_divide(F.lit(100) * done, budget), 1), F.lit(0.0))
    counted = queue.rollup("status").agg(F.count(F.lit(1)).alias("entries"), done.alias("steps_done"),
                                         budget.alias("steps_budget"), percent.alias("percent"), F.grouping("status").alias("__all"))
    return counted.withColumn("status", F.when(F.col("__all") == 1, "all").otherwise(F.col("status"))).drop("__all")


def assert_new_keys(queue: DataFrame, added: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Append entries; raises when a key is already there or is added twice."""
    both = queue.select(key).unionByName(added.select(key))
    again = both.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
    if again:
        raise ValueError(f"Entry {again[0][key]} is already in the queue.")
    return queue.unionByName(added, allowMissingColumns=True)


def evict_to_budget(files: DataFrame, now: Column, budget: float, path: str = "path", size: str = "size",
                    modified: str = "modified") -> DataFrame:
    """Mark entries for removal, largest age times size first, until the rest fits."""
    kind = files.schema[modified].dataType
    age = (epoch_micros(now, kind) - epoch_micros(modified, kind)) / F.lit(1e6)
    score = F.greatest(age, F.lit(1.0)) * F.greatest(F.col(size), F.lit(1))
    scored = files.withColumn("score", score)
    total = scored.agg(F.sum(size)).first()[0] or 0
    out = running(scored, [], [F.desc("score"), path], size, "__gone", inclusive=False)
    return out.withColumn("removed", F.lit(total) - F.col("__gone") > F.lit(budget)).drop("__gone")


def job_state(jobs: DataFrame, registry: DataFrame, now: Column, stale_after_seconds: int,
              key: str = "experiment_name") -> DataFrame:
    """State of each job before a cycle: complete, failed, cooldown, recovered or runnable.
    A running job with an old heartbeat is stale, and a stale job is recovered unless it cools down."""
    out = jobs.join(registry, key, "left")
    kind = registry.schema["heartbeat_at"].dataType
    clock = epoch_micros(now, kind)
    age = clock - epoch_micros("heartbeat_at", kind)
    stale = (F.col("status") == "stale") | ((F.col("status") == "running") & (age > F.lit(stale_after_seconds * 1_000_000).cast("bigint")))
    cooling = epoch_micros("cooldown_until", kind) > clock
    state = (F.when(F.coalesce("current_step", F.lit(0)) >= F.col("max_total_steps"), "complete")
             .when(F.col("status") == "failed", "failed").when(cooling, "cooldown")
             .when(stale, "recovered").otherwise("runnable"))
    return out.withColumn("state", state)


def failure_state(jobs: DataFrame, now: Column) -> DataFrame:
    """After a failed cycle: one failure more, failed or waiting, and when it may run again (a
    wall-clock time, as `now` is)."""
    count = F.coalesce("failure_count", F.lit(0)) + 1
    pause = F.greatest(F.col("retry_backoff_seconds"), F.lit(0)).cast("decimal(18,6)")
    until = now.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), pause)
    return jobs.withColumns({"status": F.when(count >= F.col("max_retries"), "failed").otherwise("retry_wait"),
                             "failure_count": count, "cooldown_until": until})
