"""Feature transforms fitted on the training split and replayed anywhere."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from corpusloom.functions.text import MISSING_TOKEN, RARE_TOKEN, category, number_or_null, value_key
from .profile import value_counts
from .scale import collect_small, compute_once, rows_to_local, small_side_rows


@dataclass
class TransformSpec:
    """What was fitted. `values` holds (column, value, frequency, keep) for every category; a long
    text is represented by its key."""

    missing: list[str] = field(default_factory=list)
    log1p: list[str] = field(default_factory=list)
    frequency: list[str] = field(default_factory=list)
    collapse: list[str] = field(default_factory=list)
    min_count: int = 2
    values: DataFrame | None = None
    version: int = 1

    def to_json(self) -> str:
        lists = {k: v for k, v in vars(self).items() if k != "values"}
        return json.dumps(lists, sort_keys=True)

    def save(self, spark: SparkSession, path: str) -> None:
        """One JSON row with the lists, and the category values as Parquet."""
        spark.createDataFrame([(self.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/lists")
        if self.values is not None:
            self.values.write.mode("overwrite").parquet(f"{path}/values")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "TransformSpec":
        lists = json.loads(spark.read.text(f"{path}/lists").first()[0])
        values = spark.read.parquet(f"{path}/values") if lists["frequency"] or lists["collapse"] else None
        return cls(**lists, values=values)

    @property
    def new_numeric(self) -> list[str]:
        names = [f"{c}_is_missing" for c in self.missing] + [f"{c}_log1p" for c in self.log1p]
        return list(dict.fromkeys(names + [f"{c}_frequency" for c in self.frequency]))


def corrected_skewness(column: Column, n: Column) -> Column:
    """Bias-corrected sample skewness from Spark's population form."""
    return F.try_divide(F.skewness(column) * F.sqrt(n * (n - 1)), n - 2)


def _types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def numeric_facts(df: DataFrame, columns: Sequence[str], nullable: Sequence[str] = ()) -> tuple[int, dict, dict]:
    """One pass: row count, null counts of all columns, and shape facts of the numeric ones."""
    types = _types(df)
    cells = {c: number_or_null(c, types[c]) for c in columns}
    aggs = [F.count(F.lit(1)).alias("__n")]
    for c, x in cells.items():
        n = F.count(x)
        aggs.append(F.struct(n.alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"),
                             corrected_skewness(x, n).alias("skew"),
                             F.approx_count_distinct(x).alias("distinct")).alias(c))
    aggs += [F.count(c).alias(f"__v_{c}") for c in nullable]
    row = df.agg(*aggs).first()
    present = {**{c: row[c].n for c in columns}, **{c: row[f"__v_{c}"] for c in nullable}}
    return row["__n"], {c: row["__n"] - n for c, n in present.items()}, {c: row[c] for c in columns}


def _skewed(df: DataFrame, facts: dict) -> list[str]:
    """Columns that are non-negative, right-skewed and varied enough."""
    chosen = []
    for c, s in facts.items():
        if s.n < 16 or s.lo is None or s.lo < 0 or s.hi <= 0 or s.skew is None or not s.skew >= 1.0:
            continue
        # a sketch of at most 7 values cannot report 9, so only small sketches need a real count
        if s.distinct < 9:
            x = number_or_null(c, df.schema[c].dataType)
            if df.select(x.alias("x")).agg(F.count_distinct("x")).first()[0] < 8:
                continue
        chosen.append(c)
    return chosen


def fit_log1p(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return _skewed(df, numeric_facts(df, columns)[2])


def fit_missing(df: DataFrame, columns: Sequence[str]) -> list[str]:
    numeric = [c for c in columns if isinstance(df.schema[c].dataType, T.NumericType)]
    _, nulls, _ = numeric_facts(df, numeric, [c for c in columns if c not in numeric])
    return [c for c in columns if nulls[c] > 0]


def fit_categories(df: DataFrame, columns: Sequence[str], n_rows: int | None = None):
    """Category values with frequency and keep flag, and which columns collapse or get a frequency."""
    n = df.count() if n_rows is None else n_rows
    min_count = max(2, int(n * 0.01))
    counts = value_counts(df, columns)
    values = counts.select("column", F.coalesce("value", F.lit(MISSING_TOKEN)).alias("value"), "cnt")
    # a literal token and null share one value
    values = values.groupBy("column", "value").agg(F.sum("cnt").alias("cnt"))
    values = values.select("column", "value", (F.col("cnt") / F.lit(float(max(n, 1)))).alias("frequency"),
                           (F.col("cnt") >= min_count).alias("keep"))
    values = compute_once(values)
    sums = values.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"), F.count_if("keep").alias("kept"))
    found = {r["column"]: (r["distinct"], r["kept"]) for r in sums.collect()}
    collapse = [c for c in columns if c in found and 1 < found[c][1] < found[c][0]]
    frequency = [c for c in columns if c in found
                 and (found[c][0] >= 32 or found[c][0] / max(n, 1) >= 0.2)]
    return values, collapse, frequency, min_count


def fit_transforms(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> TransformSpec:
    """Fit all transforms: one pass over the numbers and one over the category values."""
    n, nulls, facts = numeric_facts(train, numeric, categorical)
    spec = TransformSpec(missing=[c for c in [*numeric, *categorical] if nulls[c] > 0], log1p=_skewed(train, facts))
    if categorical:
        values, spec.collapse, spec.frequency, spec.min_count = fit_categories(train, categorical, n)
        used = sorted({*spec.collapse, *spec.frequency})
        spec.values = values.filter(F.col("column").isin(used)) if used else None
    return spec


def lookup_tables(values: DataFrame, columns: Sequence[str]) -> dict[str, DataFrame]:
    """One lookup per column. All values are fetched once and broadcast if they are few;
    otherwise each column stays a filtered table and the join is left to AQE."""
    spark = values.sparkSession
    limit = small_side_rows(spark)
    rows = collect_small(values.filter(F.col("column").isin(list(columns))), limit)
    if rows is None:
        return {c: values.filter(F.col("column") == c).drop("column") for c in columns}
    rest = T.StructType([f for f in values.schema.fields if f.name != "column"])
    spot = values.columns.index("column")
    parts: dict[str, list[tuple]] = {c: [] for c in columns}
    for r in rows:
        parts[r["column"]].append(tuple(v for i, v in enumerate(r) if i != spot))
    return {c: F.broadcast(rows_to_local(spark, part, rest)) for c, part in parts.items()}


def apply_transforms(df: DataFrame, spec: TransformSpec, order: str = "collapse_first") -> DataFrame:
    """Replay a fitted spec: collapse, missing flag, log1p, frequency.

    With the default order a collapsed column has no nulls left, so its flag is 0 and rare values
    have frequency 0. `order="source_first"` computes flag and frequency from the source value.
    Works on streams too: the lookups are static.
    """
    if order not in ("collapse_first", "source_first"):
        raise ValueError(f"Unknown order {order!r}.")
    late = order == "collapse_first"
    types = _types(df)
    looked = [c for c in dict.fromkeys([*spec.collapse, *spec.frequency]) if c in df.columns]
    # of a collapsed column only the kept values matter, and each of those has 1% of the rows
    values = spec.values.filter(F.col("keep") | ~F.col("column").isin(spec.collapse)) if looked and late else spec.values
    tables = lookup_tables(values, looked) if looked else {}
    out, replaced, frequencies = df, {}, {}
    for i, c in enumerate(looked):
        side = tables[c].select(F.col("value").alias(f"__v{i}"), F.col("frequency").alias(f"__f{i}"),
                                F.col("keep").alias(f"__k{i}"))
        out = out.withColumn(f"__c{i}", value_key(category(c))).join(side, F.col(f"__c{i}") == F.col(f"__v{i}"), "left")
        kept = F.coalesce(F.col(f"__k{i}"), F.lit(False))
        share = F.coalesce(F.col(f"__f{i}"), F.lit(0.0))
        if c in spec.collapse:
            replaced[c] = F.when(kept, category(c)).otherwise(F.lit(RARE_TOKEN))
            share = F.when(kept, share).otherwise(F.lit(0.0)) if late else share
        frequencies[c] = share
    new: dict[str, Column] = {}
    for c in spec.missing:
        if c not in df.columns:
            flag = F.lit(1)
        elif late and c in replaced:
            flag = F.lit(0)
        else:
            cell = number_or_null(c, types[c]) if isinstance(types[c], T.NumericType) else F.col(c)
            flag = cell.isNull().cast("tinyint")
        new[f"{c}_is_missing"] = flag.cast("tinyint")
    for c in spec.log1p:
        x = number_or_null(c, types[c]) if c in df.columns else F.lit(0.0)
        new[f"{c}_log1p"] = F.log1p(F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)))
    for c in spec.frequency:
        new[f"{c}_frequency"] = frequencies.get(c, F.lit(0.0))
    kept_columns = [replaced[c].alias(c) if c in replaced else F.col(c) for c in df.columns if c not in new]
    return out.select(*kept_columns, *[v.alias(k) for k, v in new.items()])
