"""Readers and writers for tables, logs, catalogs and prepared data."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from corpusloom.operators.scale import lookup_join
from .ranges import csv_records, line_ranges, read_csv


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               multiline: bool = True) -> DataFrame:
    """Read `.csv`, `.tsv`, `.parquet` or `.jsonl` by the lower-cased suffix of `path`.

    Give a schema when it is known; otherwise text formats are scanned once to infer it. Cells of CSV and
    TSV files may hold line breaks; their files are split all the same (`ranges.py`), and unbalanced quotes
    raise. `multiline=False` reads every line as a row, which saves the look at how ranges begin.
    """
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    reader = spark.read if schema is None else spark.read.schema(schema)
    if suffix in ("csv", "tsv"):
        sep = "\t" if suffix == "tsv" else ","
        if multiline:
            return read_csv(spark, path, sep, schema)
        return reader.options(header=True, escape='"', inferSchema=schema is None).csv(path, sep=sep)
    if suffix == "parquet":
        return reader.parquet(path)
    if suffix == "jsonl":
        return reader.json(path)
    raise ValueError(f"Unsupported table file type: {path!r}")


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Counterpart of `read_table`."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    writer = df.write.mode(mode)
    if suffix in ("csv", "tsv"):
        writer.option("header", True).option("escape", '"').csv(path, sep="\t" if suffix == "tsv" else ",")
    elif suffix == "parquet":
        writer.parquet(path)
    elif suffix == "jsonl":
        writer.option("ignoreNullFields", False).json(path)
    else:
        raise ValueError(f"Unsupported table file type: {path!r}")


# Name patterns of shards, batches and experiments.
INDEX_PATTERNS = {"shard": r"^train-([0-9]+)\.parquet$", "batch": r"datagen_([0-9]+)", "experiment": r"^exp_([0-9]+)_"}


def next_index(names: DataFrame, column: str, pattern: str, default: int = 0, groups: Sequence[str] = ()) -> DataFrame:
    """Largest integer that `pattern` finds in the names, plus one; `default` when none matches."""
    number = F.nullif(F.regexp_extract(F.col(column), pattern, 1), F.lit("")).try_cast("bigint")
    result = F.coalesce(F.max(number) + 1, F.lit(default).cast("bigint")).alias("next_index")
    return names.groupBy(*groups).agg(result) if groups else names.agg(result)


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """(path, columns, row_count) per CSV file below `root`. Rows are CSV records without the
    header. Files that are not valid UTF-8 are left out."""
    options = {"recursiveFileLookup": True, "pathGlobFilter": "*.csv"}
    raw = spark.read.options(lineSep="\n", **options).text(root)
    broken = raw.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.bool_and(F.is_valid_utf8("value")).alias("valid"))
    found = lookup_join(csv_records(line_ranges(spark, root, **options), balanced=False), broken.filter("NOT valid").select("path"), ["path"], how="left_anti")
    per_file = found.groupBy("path").agg(F.max(F.when(F.col("head"), F.col("record"))).alias("head"),
                                         F.count_if(~F.col("head")).alias("row_count"))
    cells = F.split(F.col("head"), ',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    names = F.transform(cells, lambda c: F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"')))
    return per_file.select("path", names.alias("columns"), "row_count")


def write_artifact(spark: SparkSession, path: str, content: dict | str) -> None:
    """One JSON document as a one-row text file."""
    text = content if isinstance(content, str) else json.dumps(content, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_artifact(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def append_log(rows: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """Append to a JSON-lines log, or to a tab-separated one when `columns` fixes the order."""
    if columns is None:
        rows.write.mode("append").json(path)
    else:
        cells = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c)
                 for c in columns]
        rows.select(*cells).write.mode("append").option("header", True).option("emptyValue", "").csv(path, sep="\t")


def read_json_log(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    return (spark.read if schema is None else spark.read.schema(schema)).json(path)


def read_tsv_log(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """All columns as strings; an empty cell is an empty string, not a missing value."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    log = spark.read.schema(schema).option("header", True).csv(path, sep="\t")
    return log.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns])


def catalog_source(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Records of the top-level `datasets` array of a JSON document."""
    reader = spark.read.option("multiLine", True)
    if schema is not None:
        reader = reader.schema(f"datasets array<struct<{schema}>>")
    return reader.json(path).select(F.inline("datasets"))

