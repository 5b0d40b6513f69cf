"""Evaluation metrics, ensembles, logs and rollups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from corpusloom.functions.clock import epoch_micros
from .scale import hot_rows, largest_group, lookup_join, near_first, running


def roc_auc(df: DataFrame, label: str, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve with ties; null when only one class is there.

    Rows are first counted per score, then a running count gives average ranks, so neither a
    popular score nor a large group is a hot spot.
    """
    y = F.col(label).cast("int")
    counts = df.groupBy(*groups, score).agg(F.sum(y).alias("__p"), F.count(F.lit(1)).alias("__n"))
    ranked = running(counts, list(groups), [score], "__n", "__cum")
    rank = F.col("__cum") - (F.col("__n") - 1) / 2
    sums = [F.sum(rank * F.col("__p")).alias("ranks"), F.sum("__p").alias("p"), F.sum("__n").alias("n")]
    table = ranked.groupBy(*groups).agg(*sums) if groups else ranked.agg(*sums)
    p, q = F.col("p").cast("double"), (F.col("n") - F.col("p")).cast("double")
    return table.select(*groups, F.try_divide(F.col("ranks") - p * (p + 1) / 2, p * q).alias("roc_auc"))


def argmax(scores: Column) -> Column:
    """0-based position of the first largest element."""
    return F.array_position(scores, F.array_max(scores)) - 1


def classification_metrics(df: DataFrame, label: str, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """Accuracy at score > 0 and ROC AUC."""
    hit = F.avg(((F.col(score) > 0).cast("int") == F.col(label)).cast("double")).alias("accuracy")
    accuracy = df.groupBy(*groups).agg(hit) if groups else df.agg(hit)
    area = roc_auc(df, label, score, groups)
    if groups:
        return lookup_join(accuracy, area, list(groups))
    one = area.withColumn("__k", F.lit(1))
    return lookup_join(accuracy.withColumn("__k", F.lit(1)), one, ["__k"]).drop("__k")


def multiclass_accuracy(df: DataFrame, label: str, scores: str) -> DataFrame:
    return df.agg(F.avg((argmax(F.col(scores)) == F.col(label)).cast("double")).alias("accuracy"))


def rmse(label: str, prediction: str) -> Column:
    error = F.col(label) - F.col(prediction)
    return F.sqrt(F.avg(error * error))


def log_loss_with_logits(label: str, logit: str) -> Column:
    x = F.col(logit)
    return F.avg(F.greatest(x, F.lit(0.0)) - x * F.col(label) + F.log1p(F.exp(-F.abs(x))))


def ensemble_average(df: DataFrame, row: Sequence[str], logit: str) -> DataFrame:
    return df.groupBy(*row).agg(F.avg(logit).alias(logit), F.count(F.lit(1)).alias("members"))


def vector_mean_by_key(df: DataFrame, key: Sequence[str], vector: str) -> DataFrame:
    """Element-wise mean of equal-length arrays. Elements are averaged with map-side combine; the
    final array has one entry per element."""
    cells = df.select(*key, F.posexplode(vector).alias("__i", "__x"))
    means = cells.groupBy(*key, "__i").agg(F.avg("__x").alias("__m"))
    packed = F.array_sort(F.collect_list(F.struct("__i", "__m")))
    return means.groupBy(*key).agg(packed.alias("__v")).select(*key, F.col("__v.__m").alias(vector))


def status_dashboard(jobs: DataFrame, status: str = "status") -> DataFrame:
    """Jobs per status with the total on every line; a missing status counts as unknown."""
    named = jobs.withColumn(status, F.coalesce(F.col(status), F.lit("unknown")))
    counts = named.groupBy(status).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("job_count", F.sum("n").over(W.partitionBy(F.lit(0)))).orderBy(status)


def alerts(jobs: DataFrame) -> DataFrame:
    """One line per failed, stale or orphaned job."""
    bad = jobs.filter(F.col("status").isin("failed", "stale", "orphaned"))
    line = F.format_string("%s: status=%s failures=%d repo=%s", F.col("experiment_name").cast("string"), "status",
                           F.col("failure_count").cast("bigint"), F.col("repo_id").cast("string"))
    return bad.select("experiment_name", line.alias("alert"))


def reconcile_stale(jobs: DataFrame, now: Column, stale_after_seconds: int = 300) -> DataFrame:
    """Running without a heartbeat is orphaned; with one that is too old, stale."""
    is_running = F.col("status") == "running"
    beat = F.col("heartbeat_at")
    orphan = is_running & beat.isNull()
    kind = jobs.schema["heartbeat_at"].dataType
    age = epoch_micros(now, kind) - epoch_micros(beat, kind)
    late = is_running & (age > F.lit(stale_after_seconds * 1_000_000).cast("bigint"))
    error = F.coalesce(F.nullif(F.col("last_error"), F.lit("")), F.lit("Missing heartbeat for running job."))
    return jobs.withColumns({
        "last_error": F.when(orphan, error).otherwise(F.col("last_error")),
        "status": F.when(orphan, "orphaned").when(late, "stale").otherwise(F.col("status"))})


def corpus_totals(log: DataFrame) -> DataFrame:
    """One row over shard logs: sums, gate failure rate, mean positive utility."""
    utility = F.avg(F.when(F.col("mean_utility_auc") > 0, F.col("mean_utility_auc")))
    sums = log.agg(F.count(F.lit(1)).alias("shards"), F.sum("rows").alias("total_rows"), F.sum("datasets").alias("total_datasets"),
                   F.sum("gate_fails").alias("fails"), F.coalesce(F.sum("errors"), F.lit(0)).alias("total_errors"),
                   F.coalesce(utility, F.lit(0.0)).alias("mean_utility_auc"))
    rate = F.col("fails") / F.greatest(F.col("total_datasets") + F.col("fails"), F.lit(1))
    return sums.withColumn("gate_fail_rate", rate).drop("fails")


def merge_counters(log: DataFrame, counters: Sequence[str]) -> DataFrame:
    """(counter, name, n): map columns summed over the log, most common first."""
    cells = F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).alias("m")) for c in counters])
    long = log.select(F.explode(cells).alias("x")).select("x.counter", F.explode("x.m").alias("name", "n"))
    return long.groupBy("counter", "name").agg(F.sum("n").alias("n")).orderBy("counter", F.desc("n"), "name")


def best_so_far(df: DataFrame, groups: Sequence[str], order: Sequence, value: str) -> DataFrame:
    """Best earlier value and whether this row improves on it (strictly; the first row does)."""
    out = running(df, groups, order, value, "prev_best", how="min", inclusive=False)
    better = F.col(value).isNotNull() & (F.col("prev_best").isNull() | (F.col(value) < F.col("prev_best")))
    return out.withColumn("improved", better)


def last_event(df: DataFrame, groups: Sequence[str], order: Sequence[str], kind: Column, fields: Sequence[str]) -> DataFrame:
    """The given fields of the last row that satisfies `kind`, per group."""
    latest = F.max_by(F.struct(*fields), F.struct(*order))
    return df.filter(kind).groupBy(*groups).agg(latest.alias("__last")).select(*groups, "__last.*")


def ledger_tail(df: DataFrame, groups: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """Last `n` rows per group. Up to 1,000 the rank filter becomes a per-task limit before the shuffle; above
    that, on large groups, rows that lie before the last `n` by the first order column are left out first."""
    if n > 1000 and largest_group(df, groups) > hot_rows(df.sparkSession):
        df = near_first(df, groups, order[0], n, descending=True)
    spec = W.partitionBy(*groups).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("__rn", F.row_number().over(spec)).filter(F.col("__rn") <= n).drop("__rn")


def latest_checkpoint(sessions: DataFrame, files: DataFrame, groups: Sequence[str], order: Sequence[str],
                      path: str = "checkpoint_path") -> DataFrame:
    """Newest recorded checkpoint per group that still exists in the file listing."""
    there = sessions.filter(F.col(path).isNotNull()).join(files.select(path).distinct(), path, "left_semi")
    return there.groupBy(*groups).agg(F.max_by(path, F.struct(*order)).alias(path))


def throughput(df: DataFrame, groups: Sequence[str], order: Sequence, rows: str, elapsed: str) -> DataFrame:
    """Rows per second of each shard, running totals, and the running rate."""
    out = running(df, groups, order, rows, "total_rows")
    out = running(out, groups, order, elapsed, "total_elapsed")
    return out.withColumns({"rate": F.col(rows) / F.greatest(F.col(elapsed), F.lit(1.0)),
                            "total_rate": F.col("total_rows") / F.greatest(F.col("total_elapsed"), F.lit(1.0))})


# Fields of a training log line.
LOG_PATTERNS = {"step": r"step=\s*([\d,]+)", "loss": r"loss=([\d.]+)", "rows": r"rows=([\d,]+)",
                "rate": r"rate=([\d,]+)", "eta": r"eta=([\d.]+h)"}


def log_line_extract(df: DataFrame, groups: Sequence[str], line: str, order: Sequence[str]) -> DataFrame:
    """Fields of the last log line per group; '?' where a field is absent."""
    last = df.groupBy(*groups).agg(F.max_by(line, F.struct(*order)).alias("__line"))
    found = {name: F.coalesce(F.nullif(F.regexp_extract("__line", pattern, 1), F.lit("")), F.lit("?"))
             for name, pattern in LOG_PATTERNS.items()}
    return last.withColumns(found).drop("__line")


def batch_totals(log: DataFrame) -> DataFrame:
    """Over successful rows: total of the integer row counts, real and synthetic batches."""
    done = log.filter(F.col("status") == "success")
    return done.agg(F.coalesce(F.sum(F.col("total_rows").try_cast("bigint")), F.lit(0)).alias("total_rows"),
                    F.count_if(F.col("source_type") == "real").alias("n_real"),
                    F.count_if(F.col("source_type") == "synthetic").alias("n_synthetic"))


def first_per_batch(log: DataFrame, batch: str, order: Sequence[str]) -> DataFrame:
    done = log.filter(F.col("status") == "success")
    spec = W.partitionBy(batch).orderBy(*order)
    return done.withColumn("__rn", F.row_number().over(spec)).filter(F.col("__rn") == 1).drop("__rn")


def epoch_loss(batches: DataFrame, epoch: Sequence[str], loss: str) -> DataFrame:
    """Unweighted mean of batch losses."""
    return batches.groupBy(*epoch).agg(F.avg(loss).alias("epoch_loss"), F.count(F.lit(1)).alias("n_batches"))
