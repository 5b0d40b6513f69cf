"""Column profiles from one pass over the values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from corpusloom.functions.text import datetime_or_null, fixed_point, name_tokens, number_or_null, value_key

# Feature types in the order that breaks ties.
TYPE_NAMES = ("numeric", "categorical", "text", "identifier", "datetime")
RATIO_NAMES = ("missing_ratio", "unique_ratio", "top_frequency_ratio", "avg_string_length",
               "parse_numeric_ratio", "parse_datetime_ratio")

# Characters of the shortest date, as in 1/1/2024.
SHORTEST_DATE = 8


def may_be_number(text: Column) -> Column:
    """Whether the first character can begin a number, which spares most words the pattern."""
    first = F.ascii(text)
    return (first <= ord("9")) | first.isin(ord("i"), ord("I"))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, length, cnt) over the string form of every cell; long text is represented
    by its key. Equal values meet in the map-side combine, so a value that fills a third of the
    table costs one row per task."""
    text = {c: F.col(c).cast("string") for c in columns}
    cells = F.array(*[F.struct(F.lit(c).alias("column"), value_key(x).alias("value"), F.length(x).alias("length"))
                      for c, x in text.items()])
    long = df.select(F.explode(cells).alias("cell")).select("cell.*")
    return long.groupBy("column", "value", "length").agg(F.count(F.lit(1)).alias("cnt"))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def profile_cells(df: DataFrame, columns: Sequence[str], numeric: Sequence[str] = ()) -> DataFrame:
    """One row per column: raw counts and the six ratios. Cells of the columns named in `numeric` are known
    to be numbers, so no pattern is tried on them, and their texts are written for different values only.

    Cells are told apart by two 8-byte hashes of their text, so no text is a key of a shuffle, and equal
    cells meet in the map-side combine: a value that fills a third of the table costs one row per task.
    """
    cells, kinds = [], {}
    none = {"whole_number": F.lit(None).cast("bigint"), "fraction": F.lit(None).cast("double"), "text": F.lit(None).cast("string")}
    for i, c in enumerate(columns):
        dtype, x = df.schema[c].dataType, F.col(c)
        if c in numeric and isinstance(dtype, T.IntegralType):
            own = {"whole_number": x.cast("bigint")}
        elif c in numeric and isinstance(dtype, (T.FloatType, T.DoubleType)):
            own = {"fraction": x.cast("double")}
            kinds.setdefault(dtype, []).append(i)
        else:
            own = {"text": x.cast("string")}
        cells.append(F.struct(F.lit(i).alias("i"), *[value.alias(name) for name, value in (none | own).items()]))
    cells = df.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")
    text, fraction = F.col("text"), F.col("fraction")
    # -0.0 is another text than 0.0, but hashes of numbers take them for equal
    parts = ["whole_number", "fraction", F.when(fraction == 0, fraction.cast("string")), "text"]
    number = F.when(may_be_number(text), number_or_null(text))
    values = cells.select(
        "i", "whole_number", "fraction", (text.isNotNull() | F.col("whole_number").isNotNull() | fraction.isNotNull()).alias("valid"),
        F.xxhash64(F.lit(1), *parts).alias("hash"), F.xxhash64(F.lit(2), *parts).alias("check"), F.length(text).alias("length"), number.alias("number"),
        F.when(F.length(text) >= SHORTEST_DATE, datetime_or_null(text).isNotNull()).alias("date"))
    values = values.groupBy("i", "valid", "hash", "check").agg(
        F.count(F.lit(1)).alias("cnt"), F.max("length").alias("length"), F.max("whole_number").alias("whole_number"),
        F.max("fraction").alias("fraction"), F.max("number").alias("number"), F.bool_or("date").alias("date"))
    # numbers are written as texts once for each value
    length = F.coalesce("length", F.length(F.col("whole_number").cast("string")))
    for dtype, own in kinds.items():
        length = F.when(F.col("i").isin(own), F.length(fraction.cast(dtype).cast("string"))).otherwise(length)
    number = F.coalesce("number", F.col("whole_number").cast("double"), F.when(~F.isnan(fraction), fraction))
    values = values.withColumns({"length": length, "number": number.isNotNull(), "whole": number - F.floor(number) <= 1e-8})
    names = F.array(*[F.lit(c) for c in columns])
    return value_facts(values, ["i"]).withColumn("column", F.get(names, F.col("i"))).drop("i", "least_count")


def value_facts(values: DataFrame, keys: Sequence[str], rows: str | None = None, more: Sequence[Column] = ()) -> DataFrame:
    """Raw counts and the six ratios per column from its counted values (valid, cnt, length, number, whole,
    date). `keys` name a column; `rows` holds the rows of its table where cells may be absent, and `more` further aggregates."""
    weight, zero = F.col("cnt"), F.lit(0)
    sums = values.groupBy(*keys).agg(
        F.sum(weight).alias("n_rows") if rows is None else F.first(rows).alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("valid"), weight)), zero).alias("n_valid"),
        F.count_if(F.col("valid")).alias("n_distinct"),
        F.coalesce(F.max(F.when(F.col("valid"), weight)), zero).alias("top_count"),
        F.coalesce(F.min(F.when(F.col("valid"), weight)), zero).alias("least_count"),
        F.coalesce(F.sum(F.col("length") * weight), zero).alias("n_chars"),
        F.coalesce(F.sum(F.when(F.col("number"), weight)), zero).alias("n_numeric"),
        F.coalesce(F.sum(F.when(F.col("date"), weight)), zero).alias("n_datetime"),
        F.coalesce(F.bool_and("whole"), F.lit(False)).alias("integer_like"), *more)
    n, valid_rows = F.col("n_rows"), F.col("n_valid")
    return sums.withColumns({
        "missing_ratio": _share(n - valid_rows, n),
        "unique_ratio": _share(F.col("n_distinct"), valid_rows),
        "top_frequency_ratio": _share(F.col("top_count"), valid_rows),
        "avg_string_length": _share(F.col("n_chars"), valid_rows),
        "parse_numeric_ratio": _share(F.col("n_numeric"), valid_rows),
        "parse_datetime_ratio": _share(F.col("n_datetime"), valid_rows),
    })


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Profile rows keyed by `column`, with `position` and `prefer_numeric` from the schema."""
    columns = list(columns or df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    numeric = [c for c in columns if isinstance(types[c], T.NumericType)]
    profile = profile_cells(df, columns, numeric)
    names = F.array(*[F.lit(c) for c in columns])
    return profile.withColumns({
        "position": F.array_position(names, F.col("column")).cast("int"),
        "prefer_numeric": F.col("column").isin(numeric) if numeric else F.lit(False),
    })


def datetime_parse_ratio(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of non-null cells that are datetimes; map-side counts only."""
    parts = []
    for c in columns:
        parts += [F.count(c).alias(f"n_{c}"), F.count(datetime_or_null(c)).alias(f"d_{c}")]
    sums = df.agg(*parts)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), _share(F.col(f"d_{c}"), F.col(f"n_{c}")).alias("ratio"))
                     for c in columns])
    return sums.select(F.inline(rows))


def type_scores() -> dict[str, Column]:
    """Unnormalised type scores over profile columns."""
    name = F.lower(F.col("column"))
    id_name = name.isin("id", "row_id", "customer_id") | name.endswith("_id")
    unique, numeric_first = F.col("unique_ratio"), F.col("prefer_numeric")
    zero = F.lit(0.0)
    scores = {
        "numeric": F.lit(0.15) + 1.2 * F.col("parse_numeric_ratio") + F.when(numeric_first, 0.3).otherwise(0.0),
        "categorical": F.lit(0.15) + 0.9 * F.greatest(zero, F.lit(0.2) - unique)
        + F.when(numeric_first, 0.0).otherwise(0.25),
        "text": F.lit(0.10) + 0.8 * F.greatest(zero, F.col("avg_string_length") / 32.0) + 0.5 * unique,
        "identifier": F.lit(0.10) + F.when(id_name, 1.2).otherwise(0.0)
        + 0.9 * F.greatest(zero, unique - F.lit(0.95)),
        "datetime": F.lit(0.10) + 1.3 * F.col("parse_datetime_ratio"),
    }
    return {kind: F.greatest(score, F.lit(1e-6)) for kind, score in scores.items()}


def type_probabilities(profile: DataFrame) -> DataFrame:
    """Add `p_<type>` columns that sum to one."""
    raw = profile.withColumns({f"__s_{k}": v for k, v in type_scores().items()})
    total = sum((F.col(f"__s_{k}") for k in TYPE_NAMES[1:]), F.col(f"__s_{TYPE_NAMES[0]}"))
    return (raw.withColumns({f"p_{k}": F.col(f"__s_{k}") / total for k in TYPE_NAMES})
            .drop(*[f"__s_{k}" for k in TYPE_NAMES]))


def profile_vector() -> Column:
    """Six ratios and five type probabilities, null as 0."""
    names = [*RATIO_NAMES, *[f"p_{k}" for k in TYPE_NAMES]]
    return F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in names])


def dominant_type() -> Column:
    best = F.greatest(*[F.col(f"p_{k}") for k in TYPE_NAMES])
    chain = F.lit(TYPE_NAMES[-1])
    for kind in reversed(TYPE_NAMES[:-1]):
        chain = F.when(F.col(f"p_{kind}") == best, F.lit(kind)).otherwise(chain)
    return chain


def schema_text(kind: Column | str) -> Column:
    """One line that describes a feature in words."""
    kind = F.col(kind) if isinstance(kind, str) else kind
    labels = ("missing_ratio", "unique_ratio", "top_frequency_ratio", "avg_length",
              "numeric_parse_ratio", "datetime_parse_ratio")
    pattern = "name %s feature_kind %s dominant_type %s " + " ".join(f"{label} %s" for label in labels)
    return F.format_string(pattern, F.col("column"), kind, dominant_type(), *[fixed_point(c, 3) for c in RATIO_NAMES])


def is_text_feature() -> Column:
    rival = F.greatest(F.col("p_categorical"), F.col("p_identifier"))
    return (F.col("p_text") >= rival) & ((F.col("avg_string_length") >= 12.0) | (F.col("unique_ratio") >= 0.25))


def with_name_tokens(profile: DataFrame, count: int = 4) -> DataFrame:
    return profile.withColumn("name_tokens", name_tokens("column", count))
