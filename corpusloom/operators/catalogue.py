"""Profiles, targets and verdicts of all tables of a catalogue at once.

Tables of any width are read as cells (dataset, column, value), so the work of a thousand tables is a fixed
number of grouped aggregates instead of a loop over tables. A column is numeric if all its cells are
numbers. A row that lacks a column has no value there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corpusloom.functions.text import datetime_or_null, fixed_point, number_or_null
from .gates import ingest_verdict
from .infer import RANKED_TARGET_NAMES, score_targets
from .profile import SHORTEST_DATE, may_be_number, value_facts
from .scale import compute_once, lookup_join


def json_rows(spark: SparkSession, root: str, name: str = r"/([^/]+)/[^/]+$") -> DataFrame:
    """(dataset, cells) per line of the JSON-lines files below `root`; `name` finds the dataset in the path, by
    default the folder. Lines that are no JSON object are rows without cells."""
    lines = spark.read.option("recursiveFileLookup", True).text(root)
    dataset = F.regexp_extract(F.col("_metadata.file_path"), name, 1)
    cells = F.coalesce(F.from_json("value", "map<string,string>"), F.create_map().cast("map<string,string>"))
    return lines.select(dataset.alias("dataset"), cells.alias("cells"))


def rows_of(df: DataFrame, dataset: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The same of a wide table that holds many datasets. A column that is null in every row of a dataset
    is a column of it, without values."""
    pairs = [x for c in columns or [c for c in df.columns if c != dataset] for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
    return df.select(F.col(dataset).alias("dataset"), F.create_map(*pairs).alias("cells"))


def table_facts(rows: DataFrame) -> DataFrame:
    """n_rows and duplicate_share per dataset. Rows are told apart by two 8-byte hashes of their cells, sorted
    by name; a cell that is absent equals a null one. The result is kept, as several others are made of it."""
    filled = F.map_filter("cells", lambda k, v: v.isNotNull())
    entries = F.array_sort(F.map_entries(filled))
    hashed = rows.select("dataset", F.xxhash64(F.lit(1), entries).alias("hash"), F.xxhash64(F.lit(2), entries).alias("check"))
    kinds = hashed.groupBy("dataset", "hash", "check").agg(F.count(F.lit(1)).alias("n"))
    return compute_once(kinds.groupBy("dataset").agg(F.sum("n").alias("n_rows"), (1 - F.count(F.lit(1)) / F.sum("n")).alias("duplicate_share")))


def catalogue_profile(rows: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """A profile row per dataset and column, with `position` and `prefer_numeric`.

    The position is the column's first place in any row of the dataset; columns with equal places are
    ordered by name. Cells are told apart by two 8-byte hashes. The result is kept, as several others are
    made of it.
    """
    facts = table_facts(rows) if facts is None else facts
    cells = rows.select("dataset", F.posexplode(F.map_entries("cells")).alias("place", "cell"))
    text = F.col("cell.value")
    number = F.when(may_be_number(text), number_or_null(text))
    date = F.when(F.length(text) >= SHORTEST_DATE, datetime_or_null(text).isNotNull())
    values = cells.groupBy("dataset", F.col("cell.key").alias("column"), text.isNotNull().alias("valid"),
                           F.xxhash64(F.lit(1), text).alias("hash"), F.xxhash64(F.lit(2), text).alias("check")).agg(
        F.count(F.lit(1)).alias("cnt"), F.min("place").alias("place"), F.max(F.length(text)).alias("length"),
        F.bool_or(number.isNotNull()).alias("number"), F.bool_and(number - F.floor(number) <= 1e-8).alias("whole"),
        F.bool_or(date).alias("date"))
    size = facts.select("dataset", F.col("n_rows").alias("__rows"))
    keys = ["dataset", "column"]
    values = lookup_join(values, size, ["dataset"])
    found = value_facts(values, keys, "__rows", [F.min("place").alias("__place")])
    order = Window.partitionBy("dataset").orderBy("__place", "column")  # the columns of one table
    return compute_once(found.withColumns({
        "position": F.row_number().over(order),
        "prefer_numeric": (F.col("n_valid") > 0) & (F.col("n_numeric") == F.col("n_valid"))}).drop("__place"))


def catalogue_targets(profile: DataFrame) -> DataFrame:
    """(dataset, target_column, task_type, candidates) by the scored heuristic of `resolve_target`; null where
    it is undecided. `candidates` are the five best columns in words."""
    scored = score_targets(profile)
    by = Window.partitionBy("dataset").orderBy(F.desc("score"), "position")
    line = F.format_string("%s<%s> score=%s", "column", "task_type", fixed_point("score", 2))
    best = scored.withColumn("__rank", F.row_number().over(by)).filter(F.col("__rank") <= 5).groupBy("dataset").agg(
        F.array_sort(F.collect_list(F.struct("__rank", "column", "task_type", "score", "name_score", line.alias("line")))).alias("top"),
        F.first("n_rows").alias("n_rows"))
    first, second = F.get("top", F.lit(0)), F.get("top", F.lit(1))
    gap = first["score"] - F.coalesce(second["score"], F.lit(0.0))
    by_name = (first["name_score"] >= 6.0) & (second.isNull() | (first["name_score"] > second["name_score"]))
    sure = by_name | ((first["score"] >= 3.0) & ((first["name_score"] > 0) | (gap >= 1.5)))
    taken = sure & second.isNotNull()  # a table of the target alone has no feature
    return best.select("dataset", F.when(taken, first["column"]).alias("target_column"),
                       F.when(taken, first["task_type"]).alias("task_type"),
                       F.transform("top", lambda t: t["line"]).alias("candidates"))


def catalogue_ranking(profile: DataFrame) -> DataFrame:
    """Columns of every dataset scored by name position, last place and cardinality (`rank_target_candidates`)."""
    names = F.array(*[F.lit(n) for n in RANKED_TARGET_NAMES])
    spot, distinct = F.array_position(names, F.lower(F.col("column"))), F.col("n_distinct")
    last = F.max("position").over(Window.partitionBy("dataset"))
    by_count = (F.when((distinct >= 2) & (distinct <= 20), 5)
                .when((distinct / F.greatest(F.col("n_rows"), F.lit(1)) < 0.05) & (distinct >= 2), 3))
    parts = [F.when(spot > 0, F.lit(101) - spot), F.when(F.col("position") == last, 10), by_count]
    total = sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(0))
    return profile.select("dataset", "column", "position", total.cast("bigint").alias("score"), "n_distinct",
                          F.coalesce(*parts).isNotNull().alias("__some")).filter("__some").drop("__some")


def catalogue_verdicts(facts: DataFrame, profile: DataFrame, targets: DataFrame, min_rows: int = 50) -> DataFrame:
    """(dataset, n_rows, n_cols, target_column, task_type, status, error): the first failing step of every table.

    Gates in the order of `gate_verdict`, rule "pod": constant numeric features, features without values,
    classes, smallest class, duplicates, rows.
    """
    chosen = lookup_join(profile, targets.select("dataset", "target_column", "task_type"), ["dataset"])
    own = F.col("column") == F.col("target_column")
    feature = ~F.coalesce(own, F.lit(False))
    first = lambda test: F.min_by("column", F.when(feature & test, F.col("position")))
    gates = chosen.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_cols"), F.first("target_column").alias("target_column"), F.first("task_type").alias("task_type"),
        first(F.col("prefer_numeric") & (F.col("n_distinct") < 2)).alias("constant"), first(F.col("n_valid") == 0).alias("empty"),
        F.max(F.when(own, F.col("n_distinct"))).alias("classes"), F.max(F.when(own, F.col("least_count"))).alias("least"))
    table = lookup_join(facts, gates, ["dataset"])
    classified = F.col("task_type").isin("binary", "multiclass")
    share, minority = F.col("duplicate_share"), F.try_divide(F.col("least"), F.col("n_rows"))
    # The reasons, which others read.
    reason = F.coalesce(
        F.when(F.col("constant").isNotNull(), F.concat(F.lit("gate_fail: constant column "), "constant")),
        F.when(F.col("empty").isNotNull(), F.concat(F.lit("gate_fail: all-null column "), "empty")),
        F.when(classified & (F.col("classes") < 2), F.lit("gate_fail: target has < 2 classes")),
        F.when(classified & (minority < 0.01), F.format_string("gate_fail: minority_frac=%s", fixed_point(minority, 4))),
        F.when(share >= 0.50, F.format_string("gate_fail: dupe_frac=%s", fixed_point(share, 2))),
        F.when(F.col("n_rows") < 100, F.format_string("gate_fail: only %d rows", "n_rows")))
    table = table.withColumns({"reason": reason, "encode_error": F.lit(None).cast("string"),
                               "n_cols": F.coalesce("n_cols", F.lit(0))})
    judged = ingest_verdict(table, "n_rows", "n_cols", "target_column", "encode_error", "reason", min_rows)
    return judged.select("dataset", "n_rows", "n_cols", "target_column", "task_type", "status", "error")
