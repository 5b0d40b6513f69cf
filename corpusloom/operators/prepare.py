"""One raw table to a prepared one: inspect, split, fit, replay, freeze the schema, write."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from corpusloom.functions.text import normalize_label
from corpusloom.session import new_run_dir
from corpusloom.sources.tables import write_artifact
from .columns import (drop_null_target, is_identifier_name, keep_scalar_columns, normalize_columns,
                      split_numeric_categorical)
from .encode import FrozenSchema, build_schema, dataset_card
from .features import TransformSpec, apply_transforms, fit_transforms
from .infer import Target, resolve_target
from .sampling import cap_rows_stratified, split_table


@dataclass
class Prepared:
    """A prepared table with its split column and everything that was fitted on the training rows."""

    rows: DataFrame
    target: str
    task: str
    spec: TransformSpec
    schema: FrozenSchema
    card: DataFrame
    renamed: dict[str, str]
    dropped: dict[str, str]

    def part(self, name: str) -> DataFrame:
        return self.rows.filter(F.col("split") == name).drop("split")


def prepare_table(df: DataFrame, key: Sequence[str], target: str | None = None, task: str | None = None,
                  title: str = "table", seed: int = 7, val_fraction: float = 0.1, test_fraction: float = 0.1,
                  max_rows: int | None = None, drop_identifiers: bool = True, feature_engineering: bool = True,
                  path: str | None = None, stage: bool = True) -> Prepared:
    """`key` identifies a row and drives the split; it is kept but is not a feature.

    The split rows are written once, to `path` or the work folder, and read back: fitting takes
    several passes, and each then reads only its columns of the training rows. `stage=False`
    repeats the split in every pass instead. With `path` the result is written, too.
    """
    flat, dropped = keep_scalar_columns(df)
    found: Target = resolve_target(flat.drop(*[k for k in key if k != target]), target, task)
    rows = drop_null_target(flat, found.column)
    rows = cap_rows_stratified(rows, max_rows, found.column, found.task_type, key, seed)
    rows, renamed = normalize_columns(rows)
    goal, keys = renamed[found.column], [renamed[k] for k in key]
    rows = split_table(rows, goal, found.task_type, keys, seed, val_fraction, test_fraction)
    if stage:
        staged = f"{path or new_run_dir(df.sparkSession, 'prepare')}/split"
        rows.write.mode("overwrite").partitionBy("split").parquet(staged)
        rows = rows.sparkSession.read.schema(rows.schema).parquet(staged)
    train = rows.filter(F.col("split") == "train").drop("split")
    skip = {*keys, goal, "split"}
    numeric, categorical = split_numeric_categorical(rows.drop(*skip))
    if drop_identifiers:
        numeric = [c for c in numeric if not is_identifier_name(c)]
        categorical = [c for c in categorical if not is_identifier_name(c)]
    spec = fit_transforms(train, numeric, categorical) if feature_engineering else TransformSpec()
    rows = apply_transforms(rows.select(*keys, *numeric, *categorical, goal, "split"), spec)
    numeric = list(dict.fromkeys([*numeric, *spec.new_numeric]))
    schema = build_schema(rows.filter(F.col("split") == "train"), goal, found.task_type, numeric, categorical)
    facts = {"title": title, "dataset_id": normalize_label(title, "dataset"), "target_column": goal,
             "task_type": found.task_type, "target_source": found.source, "numeric_columns": numeric,
             "categorical_columns": categorical, "dropped_columns": dropped, "renamed_columns": renamed,
             "transforms": json.loads(spec.to_json()), "limitations": ["side tables are not joined"]}
    prepared = Prepared(rows, goal, found.task_type, spec, schema, dataset_card(rows, "split", facts), renamed, dropped)
    if path:
        write_prepared(prepared, path)
    return prepared


def write_prepared(prepared: Prepared, path: str) -> None:
    """Splits as partitions, and the artifacts: schema, transforms, card."""
    spark = prepared.rows.sparkSession
    prepared.rows.write.mode("overwrite").partitionBy("split").parquet(f"{path}/rows")
    prepared.schema.save(spark, f"{path}/schema")
    prepared.spec.save(spark, f"{path}/feature_transforms")
    write_artifact(spark, f"{path}/dataset_card.json", prepared.card.first()["card"])
