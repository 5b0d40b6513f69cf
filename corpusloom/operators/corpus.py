"""Fixed-width corpus: encode tables into slots, align, cap, pack into shards, decode, verify."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from corpusloom.functions.clock import epoch_micros
from corpusloom.functions.text import number_or_null
from .columns import drop_empty_and_constant, drop_identifiers_by_value
from .infer import infer_task, ordered_codes, with_code
from .profile import column_profile
from .scale import closing_groups, distinct_counts, lookup_join, positions, running

WIDTH = 64
MIN_ROWS = 50
MIN_FEATURES = 2
# Fixed value: the string a missing label turns into when labels are coded.
MISSING_LABEL = "nan"


class EncodeError(ValueError):
    """The table cannot be encoded; the message is the reason (fixed values: ingest results carry it)."""


def label_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, code) over sorted distinct strings; a missing cell is a class of its own."""
    return ordered_codes(df, columns, missing=MISSING_LABEL)


def _plan_prepared(df: DataFrame, features: Sequence[str], n: int) -> list[tuple[str, str]]:
    """Kind per kept column: numbers as they are, strings coded unless they look like free text."""
    kinds = {c: df.schema[c].dataType for c in features}
    texts = [c for c in features if isinstance(kinds[c], (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType))]
    distinct = distinct_counts(df, texts)
    plan = []
    for c in features:
        if isinstance(kinds[c], (T.NumericType, T.BooleanType)):
            plan.append((c, "numeric"))
        elif c in texts and not (distinct[c] > 200 and distinct[c] > n * 0.5):
            plan.append((c, "categorical"))
    return plan


def _plan_raw(df: DataFrame, features: Sequence[str], n: int) -> list[tuple[str, str]]:
    """As above, but strings that mostly parse become numbers and timestamps epoch seconds."""
    kinds = {c: df.schema[c].dataType for c in features}
    texts = [c for c in features if isinstance(kinds[c], T.StringType)]
    parsed = {}
    if texts:
        parsed = df.agg(*[F.count(number_or_null(c)).alias(c) for c in texts]).first().asDict()
    plain = [c for c in texts if parsed[c] <= n * 0.5]
    distinct = distinct_counts(df, plain)
    plan = []
    for c in features:
        if isinstance(kinds[c], T.NumericType):
            plan.append((c, "numeric"))
        elif isinstance(kinds[c], T.BooleanType):
            plan.append((c, "boolean"))
        elif isinstance(kinds[c], (T.DateType, T.TimestampType, T.TimestampNTZType)):
            plan.append((c, "datetime"))
        elif c in texts and c not in plain:
            plan.append((c, "numeric_coerced"))
        elif c in plain and not (distinct[c] > 100 and distinct[c] > n * 0.5):
            plan.append((c, "categorical"))
    return plan


def _cell(df: DataFrame, c: str, kind: str) -> Column:
    if kind == "datetime":
        return epoch_micros(c, df.schema[c].dataType) / F.lit(1e6)
    return number_or_null(c, df.schema[c].dataType)


def encode_fixed_width(df: DataFrame, target: str, dataset_id: str, task: str | None = None,
                       variant: str = "prepared", width: int = WIDTH, keep: Sequence[str] = (),
                       extra_meta: dict[str, object] | None = None) -> tuple[DataFrame, dict[str, object]]:
    """Encode one table into `feat_0…`, `target` and `_source_meta`; unused slots are null.

    `variant="raw"` first drops id-like, empty and constant columns. Returns the table and its
    metadata. Raises `EncodeError` when too little is left.
    """
    n = df.count()
    if n < MIN_ROWS:
        raise EncodeError(f"too few rows: {n}")
    if target not in df.columns:
        raise EncodeError(f"target '{target}' missing")
    work = df
    if variant == "raw":
        side = df.drop(*keep) if keep else df
        side = drop_empty_and_constant(drop_identifiers_by_value(side, target), target)
        work = df.select(*dict.fromkeys([*side.columns, *keep]))
        if len(side.columns) - 1 < MIN_FEATURES:
            raise EncodeError(f"only {len(side.columns) - 1} features after cleanup")
    features = [c for c in work.columns if c != target and c not in keep]
    planned = (_plan_raw if variant == "raw" else _plan_prepared)(work, features, n)
    # the width is the format's; columns that find no slot are named in the metadata
    plan, left_out = planned[:width], [c for c, _ in planned[width:]]
    if len(plan) < MIN_FEATURES:
        raise EncodeError(f"only {len(plan)} features")
    if task is None:
        profile = column_profile(work, [target]).select(infer_task("B").alias("t"))
        task = profile.first()["t"]
    coded = [c for c, kind in plan if kind == "categorical"]
    labelled = [target] if task != "regression" else []
    out = work
    if coded or labelled:
        codes = label_codes(work, [*coded, *labelled])
        for c in [*coded, *labelled]:
            out = with_code(out, c, codes, c, missing=MISSING_LABEL)
    slots = [_cell(work, c, kind) if kind != "categorical" else F.col(c) for c, kind in plan]
    blanks = [F.lit(None).cast("float")] * (width - len(slots))
    y = F.col(target) if labelled else number_or_null(target, work.schema[target].dataType)
    out = out.select(*keep, *[s.cast("float").alias(f"feat_{i}") for i, s in enumerate([*slots, *blanks])],
                     y.cast("float").alias("target")).filter("target is not null")
    used = [f"feat_{i}" for i in range(len(plan))]
    facts = out.agg(F.count(F.lit(1)), F.count_distinct("target") if labelled else F.lit(0),
                    missingness(used)).first()
    if facts[0] < MIN_ROWS:
        raise EncodeError(f"only {facts[0]} valid targets")
    names = [f"{c}_timestamp" if kind == "datetime" else c for c, kind in plan]
    meta = {"generator": "real_data", "task_type": task, "n_features": len(plan), "n_classes": facts[1],
            "n_samples": facts[0], "domain": "real", "feature_names": names,
            "feature_types": [kind for _, kind in plan], "dataset_id": dataset_id,
            "missingness_rate": facts[2], **({"dropped_features": left_out} if left_out else {}), "concept_drift": False, "utility_auc": 0.0, **(extra_meta or {})}
    return out.withColumn("_source_meta", F.lit(json.dumps(meta))), meta


def missingness(slots: Sequence[str]) -> Column:
    """Aggregate: mean null share over the given slots."""
    empty = sum((F.col(c).isNull().cast("int") for c in slots), F.lit(0))
    return F.avg(empty / F.lit(len(slots)))


def source_meta(fields: dict[str, Column]) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def parse_source_meta(column: str, schema: str) -> Column:
    """Struct from the JSON text; null where it is not valid JSON."""
    return F.from_json(F.col(column), schema)


def encode_indexed(tables: Sequence[tuple[str, DataFrame, str]], keep: Sequence[str] = ()) -> DataFrame:
    """Stack (dataset id, table, target) triples as `feature_i`, `target`, `_dataset_id`,
    `_n_features`; narrower tables are padded with nulls."""
    parts = []
    for dataset, df, target in tables:
        features = [c for c in df.columns if c != target and c not in keep]
        textual = [c for c in [*features, target] if not isinstance(df.schema[c].dataType, T.NumericType)]
        out = df
        if textual:
            codes = ordered_codes(df, textual)
            for c in textual:
                out = with_code(out, c, codes, c)
                # a missing category has code -1
                out = out.withColumn(c, F.coalesce(F.col(c), F.lit(-1)))
        parts.append(out.select(*keep, *[F.col(c).cast("float").alias(f"feature_{i}") for i, c in enumerate(features)],
                                F.col(target).cast("float").alias("target"), F.lit(dataset).alias("_dataset_id"),
                                F.lit(len(features)).alias("_n_features")))
    return union_align(parts, meta=None)


def union_align(tables: Sequence[DataFrame], meta: str | None = "_source_meta") -> DataFrame:
    """Union by name, absent columns null; a missing metadata column becomes ''."""
    out = tables[0]
    for df in tables[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    if meta is not None and meta not in out.columns:
        out = out.withColumn(meta, F.lit(""))
    return out


def cap_total_rows(df: DataFrame, dataset: str, order: str, key: Sequence[str], max_rows: int,
                   min_part: int = 100) -> DataFrame:
    """Keep datasets in `order` until `max_rows`. The one that crosses the cap is cut to fit if
    more than `min_part` rows remain; everything after it goes. Only that one is ranked."""
    sizes = df.groupBy(dataset).agg(F.min(order).alias("__o"), F.count(F.lit(1)).alias("__n"))
    totals = running(sizes, [], ["__o", dataset], "__n", "__cum")
    full = totals.filter(F.col("__cum") <= max_rows).select(dataset)
    crossing = totals.filter((F.col("__cum") > max_rows) & (F.col("__cum") - F.col("__n") <= max_rows))
    edge = crossing.select(dataset, (F.lit(max_rows) - (F.col("__cum") - F.col("__n"))).alias("left")).first()
    kept = lookup_join(df, full, [dataset], how="left_semi")
    if edge is None or edge["left"] <= min_part:
        return kept
    part = df.filter(F.col(dataset) == F.lit(edge[dataset]))
    part = positions(part, [], list(key), "__pos").filter(F.col("__pos") <= edge["left"]).drop("__pos")
    return kept.unionByName(part)


def pack_shards(sizes: DataFrame, order: Sequence, size: str, limit: int, output: str = "shard_id") -> DataFrame:
    """Shard per dataset: datasets are appended in order and a shard closes once it holds at least
    `limit` rows, so shards end on dataset boundaries and may overshoot."""
    return closing_groups(sizes, order, size, limit, output)


def assign_shards(df: DataFrame, dataset: str, limit: int, output: str = "shard_id") -> DataFrame:
    """Give every row the shard of its dataset, in dataset order."""
    sizes = df.groupBy(dataset).agg(F.count(F.lit(1)).alias("n"))
    return lookup_join(df, pack_shards(sizes, [dataset], "n", limit, output).drop("n"), [dataset])


def stringify_objects(df: DataFrame) -> DataFrame:
    simple = (T.NumericType, T.BooleanType)
    return df.select(*[F.col(f.name) if isinstance(f.dataType, simple) else F.col(f.name).cast("string").alias(f.name)
                       for f in df.schema.fields])


def task_code(meta: str = "_source_meta") -> Column:
    """0 regression (also for unreadable metadata), 1 binary, 2 multiclass."""
    task = F.from_json(F.col(meta), "task_type string")["task_type"]
    return F.when(task == "binary", 1).when(task == "multiclass", 2).otherwise(0)


def decode_for_training(df: DataFrame, shard: str, width: int = WIDTH, keep: Sequence[str] = ()) -> DataFrame:
    """Masks, zero fill, per-shard z-scores over present values, task codes, scaled targets.

    One aggregate per shard gives all statistics; they are joined back, so a shard is never in
    one task.
    """
    slots = [f"feat_{i}" for i in range(width)]
    work = df.withColumns({"__task": task_code(), "__y": F.coalesce(F.col("target"), F.lit(0.0)).cast("double")})
    goal = F.when(F.col("__task") == 0, F.col("__y"))
    aggs = [F.struct(F.count(c).alias("n"), F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(f"__st_{c}") for c in slots]
    stats = work.groupBy(shard).agg(
        *aggs, F.struct(F.count(goal).alias("n"), F.avg(goal).alias("m"), F.stddev_pop(goal).alias("s")).alias("__st_y"))
    out = lookup_join(work, stats, [shard])

    def scaled(x: Column, st: str) -> Column:
        usable = (F.col(f"{st}.n") > 1) & (F.col(f"{st}.s") > 1e-8)
        return F.when(usable, (x - F.col(f"{st}.m")) / F.col(f"{st}.s")).otherwise(x)

    features = [F.coalesce(scaled(F.col(c).cast("double"), f"__st_{c}"), F.lit(0.0)).cast("float") for c in slots]
    masks = [F.col(c).isNotNull().cast("float") for c in slots]
    y = F.when(F.col("__task") == 0, scaled(F.col("__y"), "__st_y")).otherwise(F.col("__y"))
    return out.select(shard, *keep, F.array(*features).alias("x"), F.array(*masks).alias("mask"),
                      y.cast("float").alias("y"), F.col("__task").alias("task"))


def prefix_mask(n_features: str, width: int) -> Column:
    """1 for the first `n_features` of `width` slots."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: (i < F.col(n_features)).cast("int"))


def shard_manifest(df: DataFrame, shard: str, dataset: str) -> DataFrame:
    """Rows, datasets and the dataset list per shard. Rows are first counted per dataset, so the
    list is built from one small record per dataset."""
    per = df.groupBy(shard, dataset).agg(F.count(F.lit(1)).alias("n"))
    records = F.array_sort(F.collect_list(F.struct(dataset, "n")))
    return per.groupBy(shard).agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_datasets"),
                                  F.to_json(records).alias("datasets"))


def verify_batch(df: DataFrame, logged_rows: int, required: str = "_source_meta") -> None:
    """Raise when the row count differs from the log or a required column is missing."""
    if required not in df.columns:
        raise AssertionError(f"missing {required} column")
    actual = df.count()
    if actual != logged_rows:
        raise AssertionError(f"row count mismatch: logged={logged_rows}, actual={actual}")


def duplicate_ids(log: DataFrame, source_id: str = "source_id") -> DataFrame:
    """Ids that a log of successful real batches holds more than once."""
    real = log.filter((F.col("status") == "success") & (F.col("source_type") == "real"))
    counted = real.groupBy(source_id).agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") > 1)


def overflow_names(names: DataFrame, column: str, domains: Sequence[str]) -> DataFrame:
    """Column names of the form `<domain word>_<digits>`, which mark a used-up vocabulary."""
    head = F.regexp_extract(F.col(column), r"^(.*)_([0-9]+)$", 1)
    return names.filter((head != "") & head.isin(list(domains)))


def write_shards(df: DataFrame, path: str, shard: str = "shard_id", mode: str = "overwrite") -> None:
    """One folder per shard. The rebalance hint gathers a shard's rows in few tasks and lets the
    runtime split a shard that is too big for one; a row count per file caps file sizes."""
    df.hint("rebalance", shard).write.mode(mode).option("compression", "snappy").option("maxRecordsPerFile", 2_000_000).partitionBy(shard).parquet(path)


def read_shards(spark, path: str, columns: Sequence[str], filters: Column | None = None) -> DataFrame:
    """Only the named columns are read; a filter on the shard id skips folders."""
    df = spark.read.parquet(path)
    return (df if filters is None else df.filter(filters)).select(*columns)
