"""Discovery registry, candidates and search results as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .scale import lookup_join


def registry_upsert(records: DataFrame, key: Sequence[str], order: Sequence[str], created: str | None = None) -> DataFrame:
    """Latest record per key, and the first time the key was seen. A single aggregate with
    map-side combine, so a key with many records sends one row per task."""
    rest = [c for c in records.columns if c not in key]
    aggs = [F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")]
    if created:
        aggs.append(F.min(created).alias("created_at"))
    out = records.groupBy(*key).agg(*aggs)
    return out.select(*key, "__r.*", *(["created_at"] if created else []))


def new_candidates(candidates: DataFrame, known: DataFrame, on: str) -> DataFrame:
    """Candidates whose id is in no registry; the id list is broadcast only if it is small."""
    return lookup_join(candidates, known.select(on).distinct(), [on], how="left_anti")


def ingested_ids(log: DataFrame, source_id: str = "source_id", status: str = "status") -> DataFrame:
    """Distinct ids of successful rows; a cell may hold several ids joined by '|'."""
    cells = log.filter(F.col(status) == "success").select(F.explode(F.split(F.col(source_id), r"\|")).alias("id"))
    return cells.select(F.trim("id").alias(source_id)).filter(F.col(source_id) != "").distinct()


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in `order`."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*key, "__r.*")


def merge_searches(results: Sequence[DataFrame], key: Sequence[str], position: str) -> DataFrame:
    """Union of result lists; of equal ids the earliest list and position wins."""
    tagged = [df.withColumn("list_no", F.lit(i)) for i, df in enumerate(results)]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return first_per_key(out, key, ["list_no", position])


def retry_count(notes: str = "notes") -> Column:
    """Number after the last 'retry=', or 0."""
    tail = F.substring_index(F.col(notes), "retry=", -1)
    return F.when(F.contains(F.col(notes), F.lit("retry=")), F.coalesce(F.trim(tail).try_cast("int"), F.lit(0))).otherwise(0)


def retryable(registry: DataFrame, source: str | None = None, max_retries: int = 3) -> DataFrame:
    rows = registry if source is None else registry.filter(F.col("source") == source)
    return rows.filter((F.col("status") == "download_fail") & (retry_count() < max_retries))


def status_transition(registry: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Apply (key, new_status, new_notes). A failure cuts the note to 150 characters and counts the
    retry; a success takes the note as it is."""
    joined = lookup_join(registry, updates.select(key, "new_status", "new_notes"), [key])
    touched = F.col("new_status").isNotNull()
    failed = F.concat(F.substring(F.coalesce("new_notes", F.lit("")), 1, 150), F.lit(" retry="),
                      (retry_count() + 1).cast("string"))
    notes = F.when(F.col("new_status") == "ok", F.coalesce("new_notes", F.lit(""))).otherwise(failed)
    return joined.withColumns({
        "notes": F.when(touched, notes).otherwise(F.col("notes")),
        "status": F.coalesce("new_status", "status")}).drop("new_status", "new_notes")


def status_rollup(registry: DataFrame, source: str = "source", status: str = "status") -> DataFrame:
    """ok, failed and total per source, and a line for all sources."""
    counted = registry.rollup(source).agg(F.count_if(F.col(status) == "ok").alias("ok"),
                                          F.count_if(F.col(status) != "ok").alias("fail"),
                                          F.count(F.lit(1)).alias("total"), F.grouping(source).alias("__all"))
    return counted.withColumn(source, F.when(F.col("__all") == 1, "all").otherwise(F.col(source))).drop("__all")


def quality_map(items: DataFrame, qualities: str, fields: dict[str, str]) -> DataFrame:
    """Columns from an array of (name, value) pairs; of equal names the last counts, as numbers."""
    def value(name: str) -> Column:
        hit = F.filter(F.col(qualities), lambda q: q["name"] == name)
        text = F.when(F.size(hit) > 0, F.element_at(hit, -1)["value"])
        return F.coalesce(text.try_cast("double"), F.lit(0.0)).cast("bigint")
    return items.withColumns({column: value(name) for name, column in fields.items()})


def size_filter(items: DataFrame, rows: str, features: str, max_rows: int, min_rows: int = 30,
                min_features: int = 2, max_features: int = 2000) -> DataFrame:
    return items.filter(F.col(rows).between(min_rows, max_rows) & F.col(features).between(min_features, max_features))


def materialize_summary(requested: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Per requested id: status, rows when ok, otherwise the error."""
    joined = requested.join(results, key, "left")
    ok = F.col("error").isNull() & F.col("rows").isNotNull()
    return joined.select(key, F.when(ok, "ok").otherwise("error").alias("status"), F.when(ok, F.col("rows")).alias("rows"),
                         F.when(~ok, F.coalesce("error", F.lit("no result"))).alias("error"))


def rank_candidates(candidates: DataFrame, processed: DataFrame, skip: DataFrame, key: str, order: Sequence[str],
                    downloads: str = "downloads") -> DataFrame:
    """Unprocessed candidates outside the skip list, one per id, most downloaded first."""
    rest = new_candidates(new_candidates(candidates, processed, key), skip, key)
    unique = first_per_key(rest, [key], order).withColumn(downloads, F.coalesce(downloads, F.lit(0)))
    return unique.orderBy(F.desc(downloads), *order)
