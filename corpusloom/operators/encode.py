"""The frozen schema and the encoders that replay it."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from corpusloom.functions.hashing import hash_token, row_hash
from corpusloom.functions.text import MISSING_TOKEN, category, name_tokens, number_or_null, tokenize_text
from . import profile as profiles
from .features import lookup_tables
from .infer import ordered_codes, with_code
from .scale import compute_once, fit_quantiles, hash_positions, positions

TEXT_TOKENS = 16


@dataclass
class FrozenSchema:
    """Everything needed to encode a row. `vocabulary` holds (column, value, code) with 0-based codes."""

    target: str
    task: str
    numeric: dict[str, dict[str, float]] = field(default_factory=dict)
    categorical: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    vocabulary: DataFrame | None = None
    profile: DataFrame | None = None

    def to_json(self) -> str:
        return json.dumps({"target": self.target, "task": self.task, "numeric": self.numeric,
                           "categorical": self.categorical, "text": self.text}, sort_keys=True)

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/schema")
        self.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
        self.profile.write.mode("overwrite").parquet(f"{path}/profile")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FrozenSchema":
        plain = json.loads(spark.read.text(f"{path}/schema").first()[0])
        return cls(**plain, vocabulary=spark.read.parquet(f"{path}/vocabulary"),
                   profile=spark.read.parquet(f"{path}/profile"))


def _cell(df: DataFrame, c: str) -> Column:
    return number_or_null(c, df.schema[c].dataType)


def numeric_stats(df: DataFrame, columns: Sequence[str], n_rows: int | None = None) -> dict[str, dict[str, float]]:
    """Median as fill value, then mean and population std of the filled column."""
    if not columns:
        return {}
    numbers = df.select(*[_cell(df, c).alias(c) for c in columns])
    medians = fit_quantiles(numbers, columns, [0.5], n_rows=n_rows)
    fill = {c: (medians[c][0] if medians[c] and medians[c][0] is not None else 0.0) for c in columns}
    filled = {c: F.coalesce(F.col(c), F.lit(fill[c])) for c in columns}
    row = numbers.agg(*[F.struct(F.avg(x).alias("m"), F.stddev_pop(x).alias("s")).alias(c)
                        for c, x in filled.items()]).first()
    return {c: {"fill": fill[c], "mean": row[c].m or 0.0, "std": row[c].s if row[c].s and row[c].s > 0 else 1.0}
            for c in columns}


def build_schema(train: DataFrame, target: str, task: str, numeric: Sequence[str],
                 categorical: Sequence[str]) -> FrozenSchema:
    """Fit the frozen schema on the training split. Wordy string columns become text features."""
    features = [*numeric, *categorical]
    prof = profiles.profile_cells(train, features, [c for c in numeric if isinstance(train.schema[c].dataType, T.NumericType)])
    prof = profiles.type_probabilities(prof.withColumn("prefer_numeric", F.col("column").isin(list(numeric))))
    # one row per column
    prof = compute_once(prof)
    wordy = prof.filter(F.col("column").isin(list(categorical)) & profiles.is_text_feature()).select("column").collect()
    text = [r["column"] for r in wordy]
    n_rows = prof.agg(F.max("n_rows")).first()[0]
    coded = [c for c in categorical if c not in text]
    classes = [] if task == "regression" else [target]
    vocabulary = compute_once(ordered_codes(train, [*coded, *classes], missing=MISSING_TOKEN)) if coded or classes else None
    return FrozenSchema(target, task, numeric_stats(train, numeric, n_rows), coded, [c for c in categorical if c in text],
                        vocabulary, prof)


def encode_numeric(df: DataFrame, stats: dict[str, dict[str, float]], standardize: bool = True) -> dict[str, Column]:
    out = {}
    for c, s in stats.items():
        x = F.coalesce(_cell(df, c), F.lit(s["fill"])) if c in df.columns else F.lit(s["fill"])
        out[c] = ((x - F.lit(s["mean"])) / F.lit(s["std"]) if standardize else x).cast("float")
    return out


def encode(df: DataFrame, schema: FrozenSchema, standardize: bool = True, unseen: str = "error",
           keep: Sequence[str] = ()) -> DataFrame:
    """Encoded rows: x_num, x_cat, x_text, their presence masks, and y.

    Stateless: numeric columns are projections and categories are joins with static lookups, so
    the same call encodes a stream. An unseen target label raises unless `unseen="null"`.
    """
    present = set(df.columns)
    with_target = schema.target in present
    coded = [c for c in schema.categorical if c in present]
    classes = [schema.target] if with_target and schema.task != "regression" else []
    tables = lookup_tables(schema.vocabulary, [*schema.categorical, *classes]) if schema.categorical or classes else {}
    out = df
    codes: dict[str, Column] = {}
    for i, c in enumerate([*schema.categorical, *classes]):
        side = tables[c].select(F.col("value").alias(f"__v{i}"), F.col("code").alias(f"__i{i}"))
        cell = category(c) if c in present else F.lit(MISSING_TOKEN)
        out = out.withColumn(f"__c{i}", cell).join(side, F.col(f"__c{i}") == F.col(f"__v{i}"), "left")
        codes[c] = F.col(f"__i{i}")
    x_cat = [F.coalesce(codes[c] + 1, F.lit(0)).cast("bigint") for c in schema.categorical]
    numbers = encode_numeric(df, schema.numeric, standardize)
    x_text = [tokenize_text(c, TEXT_TOKENS) if c in present else F.array_repeat(F.lit(0).cast("bigint"), TEXT_TOKENS)
              for c in schema.text]
    num_mask = [_cell(df, c).isNotNull() if c in present else F.lit(False) for c in schema.numeric]
    cat_mask = [F.col(c).isNotNull() if c in present else F.lit(False) for c in schema.categorical]
    text_mask = [F.col(c).isNotNull() if c in present else F.lit(False) for c in schema.text]

    def pack(cells: list[Column], kind: str) -> Column:
        return (F.array(*cells) if cells else F.array()).cast(f"array<{kind}>")

    columns = [*keep, pack(list(numbers.values()), "float").alias("x_num"), pack(x_cat, "bigint").alias("x_cat"),
               pack(x_text, "array<bigint>").alias("x_text"), pack(num_mask, "boolean").alias("num_mask"),
               pack(cat_mask, "boolean").alias("cat_mask"), pack(text_mask, "boolean").alias("text_mask")]
    if with_target:
        columns.append(target_code(schema, codes.get(schema.target), unseen).alias("y"))
    return out.select(*columns)


def target_code(schema: FrozenSchema, code: Column | None, unseen: str = "error") -> Column:
    if schema.task == "regression":
        return F.col(schema.target).cast("float")
    if unseen == "null":
        return code
    label = F.concat(F.lit("Found unseen target label: "), F.col(schema.target).cast("string"))
    return F.when(code.isNull(), F.raise_error(label).cast("bigint")).otherwise(code)


def feature_metadata(schema: FrozenSchema) -> DataFrame:
    """Per feature: kind, hashed name tokens, description line and profile vector."""
    kind = F.when(F.col("column").isin(list(schema.numeric) or [""]), "numeric").when(
        F.col("column").isin(schema.text or [""]), "text").otherwise("categorical")
    return schema.profile.select(
        "column", kind.alias("kind"), F.transform(name_tokens("column"), hash_token).alias("name_ids"),
        profiles.schema_text(kind).alias("schema_text"), profiles.profile_vector().alias("profile_vector"))


def assemble_batches(df: DataFrame, size: int, key: Sequence[str], seed: int | None = None,
                     collect: Sequence[str] = ()) -> DataFrame:
    """Add `batch_id` for consecutive runs of `size` rows, in key order or hashed order. With
    `collect`, one row per batch with arrays of the named columns (at most `size` long)."""
    if seed is None:
        placed = positions(df, [], list(key), "__pos")
    else:
        placed = hash_positions(df.withColumn("__digest", row_hash(seed, *key)), [], "__digest", "__pos").drop("__digest")
    batched = placed.withColumn("batch_id", F.floor((F.col("__pos") - 1) / size).cast("bigint"))
    if not collect:
        return batched.drop("__pos")
    rows = F.array_sort(F.collect_list(F.struct("__pos", *collect)))
    grouped = batched.groupBy("batch_id").agg(rows.alias("__rows"))
    return grouped.select("batch_id", *[F.col(f"__rows.{c}").alias(c) for c in collect])


def encode_csv(train: DataFrame, val: DataFrame, target: str, task: str, numeric: Sequence[str],
               categorical: Sequence[str], split: str = "split") -> DataFrame:
    """Inline encoder: numbers scaled with train statistics, category codes from train and val
    together (a leak that is part of the rule), target codes from train only."""
    both = train.withColumn(split, F.lit("train")).unionByName(val.withColumn(split, F.lit("val")))
    row = train.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in numeric]).first()
    scaled = {c: ((F.col(c) - row[c].m) / (row[c].s or 1.0)).cast("float") for c in numeric}
    codes = ordered_codes(both, categorical, missing=MISSING_TOKEN) if categorical else None
    out = both.withColumns(scaled)
    for c in categorical:
        out = with_code(out, c, codes, c, missing=MISSING_TOKEN)
    if task != "regression":
        out = with_code(out, target, ordered_codes(train, [target]), target)
    return out


def dataset_card(df: DataFrame, split: str, facts: dict[str, object]) -> DataFrame:
    """One JSON row: rows per split plus the given facts."""
    counts = df.groupBy(split).agg(F.count(F.lit(1)).alias("n"))
    rows = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(split, "n")))).alias("rows"))
    return rows.select(F.to_json(F.struct("rows", F.lit(json.dumps(facts, sort_keys=True)).alias("facts"))).alias("card"))


def content_fingerprint(df: DataFrame, columns: Sequence[str], output: str = "sha256") -> DataFrame:
    """SHA-256 of each artifact row in its JSON form."""
    return df.withColumn(output, F.sha2(F.to_json(F.struct(*columns)), 256))
