"""Task type, target column and domain inference over profiles and name tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from corpusloom.functions.text import datetime_or_null, normalize_name
from .columns import WIDE_IDENTIFIER_NAMES, WIDE_IDENTIFIER_SUFFIXES, keep_scalar_columns
from .profile import column_profile
from corpusloom.session import stable
from .scale import collect_small, distinct_counts, lookup_join, positions, rows_to_local, top_rows

# Canonical target names and their scores.
EXACT_TARGET_SCORES = {
    "target": 8.0, "label": 8.0, "labels": 7.5, "class": 7.0, "classes": 6.5,
    "outcome": 6.0, "response": 6.0, "output": 5.5, "y": 5.0,
}
# Target-like words and their weights.
TARGET_KEYWORD_WEIGHTS = {
    "target": 4.5, "label": 4.5, "class": 4.0, "outcome": 3.5, "response": 3.5, "status": 2.5,
    "result": 2.5, "price": 2.5, "score": 2.0, "rating": 2.0, "risk": 2.0, "income": 2.0,
    "quality": 2.0, "churn": 2.0, "default": 2.0, "fraud": 2.0, "approved": 2.0, "approval": 2.0,
    "survived": 2.0, "diagnosis": 2.0, "species": 1.5, "deposit": 1.5, "sale": 1.0, "sales": 1.0,
}
# Target names in the order in which they are tried when ranking.
RANKED_TARGET_NAMES = (
    "target", "class", "label", "y", "outcome", "result", "diagnosis", "default", "survived",
    "income", "attrition", "churn", "species", "quality", "grade", "score", "status", "type",
    "category", "response",
)
# Target names in the order in which they are tried when guessing.
GUESSED_TARGET_NAMES = (
    "target", "label", "class", "y", "outcome", "response", "output", "labels", "classes",
    "is_fraud", "fraud", "churn", "default", "income", "price", "salary", "survived", "diagnosis",
    "quality", "rating", "score", "Exited", "Churn", "Attrition", "Category", "species", "variety",
    "type", "status",
)
GUESS_SUBSTRINGS = ("target", "label", "class", "output", "y_")
NOT_TARGET_SUBSTRINGS = ("id", "index", "name", "date", "time")
# Words that mark a numeric column as time.
TEMPORAL_KEYWORDS = ("date", "time", "timestamp", "datetime", "year", "month", "week", "day",
                     "hour", "period", "quarter", "dt", "ts")
# Words per domain; the first domain wins a tie.
DOMAIN_KEYWORDS = {
    "finance": ("income", "loan", "credit", "debt", "bank", "stock", "price", "mortgage", "insurance",
                "portfolio", "interest", "tax", "revenue", "profit", "salary", "wage", "financial",
                "money", "invest", "asset"),
    "health": ("bmi", "blood", "cholesterol", "glucose", "diagnosis", "patient", "medical", "hospital",
               "disease", "symptom", "drug", "treatment", "clinical", "heart", "cancer", "health",
               "mortality", "survival"),
    "ecommerce": ("price", "cart", "purchase", "customer", "product", "order", "review", "rating", "shop",
                  "store", "retail", "ecommerce", "conversion", "churn", "subscription", "sell", "buy"),
    "iot": ("sensor", "temperature", "humidity", "voltage", "current", "vibration", "device", "signal",
            "iot", "telemetry", "firmware", "uptime", "latency"),
    "hr": ("employee", "attrition", "tenure", "satisfaction", "performance", "promotion", "department",
           "hiring", "turnover", "workforce", "hr", "staff", "recruit", "engagement"),
    "science": ("experiment", "species", "specimen", "chemical", "compound", "reaction", "wavelength",
                "isotope", "gene", "protein", "molecule", "scientific", "biology", "physics",
                "chemistry", "ecology"),
    "logistics": ("shipment", "delivery", "warehouse", "route", "freight", "cargo", "transport",
                  "logistics", "supply", "fleet", "tracking"),
    "education": ("student", "grade", "gpa", "course", "school", "university", "education", "exam",
                  "score", "academic", "teacher", "class"),
    "manufacturing": ("defect", "yield", "machine", "assembly", "quality", "production", "factory",
                      "manufacturing", "cycle_time", "inspection", "tolerance", "batch"),
    "environment": ("climate", "weather", "pollution", "emission", "ozone", "rainfall", "forest", "water",
                    "air_quality", "environmental", "soil", "ecosystem", "carbon", "biodiversity"),
    "telecom": ("call", "subscriber", "roaming", "bandwidth", "network", "telecom", "cellular", "mobile",
                "broadband", "spectrum"),
}


def _any(tests: Sequence[Column]) -> Column:
    result = tests[0]
    for test in tests[1:]:
        result = result | test
    return result


def _contains_any(text: Column, words: Sequence[str]) -> Column:
    return _any([F.contains(text, F.lit(w)) for w in words])


def target_name_score(names: DataFrame, column: str = "column") -> DataFrame:
    """Add `name_score` and `keyword_hits` for a normalised column name."""
    names = names.withColumn("__name", normalize_name(column))
    name = F.col("__name")
    exact = F.lit(None).cast("double")
    for word, score in EXACT_TARGET_SCORES.items():
        exact = F.when(name == word, F.lit(score)).otherwise(exact)
    total = sum((F.when(F.contains(name, F.lit(w)), F.lit(v)).otherwise(F.lit(0.0))
                 for w, v in TARGET_KEYWORD_WEIGHTS.items()), F.lit(0.0))
    hits = F.array_compact(F.array(*[F.when(F.contains(name, F.lit(w)), F.lit(w))
                                     for w in TARGET_KEYWORD_WEIGHTS]))
    return names.withColumns({
        "name_score": F.coalesce(exact, F.least(total, F.lit(5.0))),
        "keyword_hits": F.when(exact.isNotNull(), F.array().cast("array<string>")).otherwise(hits),
    }).drop("__name")


def identifier_like(column: str = "column") -> Column:
    name = normalize_name(column)
    return _any([name.isin(*WIDE_IDENTIFIER_NAMES), *[name.endswith(s) for s in WIDE_IDENTIFIER_SUFFIXES]])


def infer_task(rule: str) -> Column:
    """Task type from profile columns. Rules differ in where a number stops being a class.

    A: cell-content rule for prepared tables.  B: distinct count against 20 and 5% of the rows.
    C: by value type, 20 distinct numbers.  D: two values, then 20 distinct numbers.
    E: `nominal` flag or 20 distinct.  F: number of declared classes in `n_classes`.
    """
    distinct, valid = F.col("n_distinct"), F.col("n_valid")
    binary, multi, regression = F.lit("binary"), F.lit("multiclass"), F.lit("regression")
    two_way = F.when(distinct == 2, binary).otherwise(multi)
    if rule == "A":
        bound = F.least(F.lit(32), F.greatest(F.lit(3), F.floor(valid / 20)))
        discrete = F.col("integer_like") & (distinct <= bound)
        few = (F.col("unique_ratio") <= 0.1) & (distinct <= 64)
        return (F.when(valid == 0, multi).when(distinct <= 2, binary)
                .when(F.col("parse_numeric_ratio") < 0.95, multi)
                .when(discrete | few, multi).otherwise(regression))
    if rule == "B":
        return (F.when(distinct <= 2, binary)
                .when((distinct <= 20) & (distinct < F.col("n_rows") * 0.05), multi).otherwise(regression))
    if rule == "C":
        is_text = ~F.col("prefer_numeric") | (F.col("n_numeric") < valid)
        return (F.when(valid == 0, regression).when(is_text, two_way)
                .when(distinct <= 20, two_way).otherwise(regression))
    if rule == "D":
        return (F.when(distinct == 2, binary)
                .when((F.col("n_numeric") == valid) & (distinct > 20), regression).otherwise(multi))
    if rule == "E":
        classes = F.col("nominal") | (distinct <= 20)
        return F.when(classes, F.when(distinct <= 2, binary).otherwise(multi)).otherwise(regression)
    if rule == "F":
        return (F.when(F.col("n_classes").isNull() | (F.col("n_classes") == 0), regression)
                .when(F.col("n_classes") == 2, binary).otherwise(multi))
    raise ValueError(f"Unknown task rule {rule!r}.")


def score_targets(profile: DataFrame) -> DataFrame:
    """Score each profiled column as a target candidate, with the reasons in words."""
    scored = target_name_score(profile).withColumn("task_type", infer_task("A"))
    name_score, distinct = F.col("name_score"), F.col("n_distinct")
    unnamed = name_score == 0
    id_like = identifier_like()
    near_unique = ~id_like & (F.col("unique_ratio") >= 0.98) & (F.col("n_valid") >= 32) & unnamed
    discrete = F.col("task_type") != "regression"
    crowded = discrete & unnamed & (distinct > F.greatest(F.lit(64), F.floor(F.col("n_valid") * 0.2)))
    wordy = discrete & unnamed & (F.col("avg_string_length") > 48)
    # Points and the texts of the reasons, which results carry.
    points = (F.when(distinct <= 1, -10.0).when(F.col("task_type") == "binary", 3.0)
              .when((F.col("task_type") == "multiclass") & (distinct <= 16), 2.5).otherwise(1.0))
    shape = (F.when(distinct <= 1, "constant or empty column")
             .when(F.col("task_type") == "binary", "binary label cardinality")
             .when(F.col("task_type") == "regression", "continuous numeric values")
             .when(distinct <= 16, "classification-like cardinality").otherwise("discrete values"))
    hits = F.col("keyword_hits")
    named = F.when(F.size(hits) > 0, F.concat(F.lit("name includes target-like token(s): "),
                                              F.array_join(F.slice(hits, 1, 3), ", "))
                   ).otherwise(F.lit("name matches a canonical target label"))
    reasons = F.concat_ws("; ", F.when(~unnamed, named), F.when(id_like, "identifier-like column name"),
                          F.when(near_unique, "almost every row is unique"), shape,
                          F.when(crowded, "too many classes for a likely label"),
                          F.when(wordy, "long free-form text values"))

    def penalty(test: Column, size: float) -> Column:
        return F.when(test, F.lit(-size)).otherwise(F.lit(0.0))

    score = (name_score + penalty(id_like, 5.0) + penalty(near_unique, 2.5) + points
             + penalty(crowded, 2.0) + penalty(wordy, 1.5))
    return scored.withColumns({"score": score, "reason": reasons})


@dataclass(frozen=True)
class Target:
    column: str
    task_type: str
    source: str
    candidates: tuple = ()


def resolve_target(df: DataFrame, given: str | None = None, given_task: str | None = None,
                   metadata: str | None = None, metadata_task: str | None = None) -> Target:
    """Given name, then source metadata, then the scored heuristic; raises when undecided."""
    flat, dropped = keep_scalar_columns(df)
    if not flat.columns:
        raise ValueError("The table has no flat scalar columns.")
    for name, source in ((given, "given"), (metadata, "source_metadata")):
        if not name:
            continue
        if name in dropped:
            raise ValueError(f"Target column {name} is not tabular: {dropped[name]}.")
        if name not in flat.columns:
            if source == "given":
                raise KeyError(f"Target column {name} is missing.")
            continue
        task = given_task or metadata_task
        if task is None:
            task = column_profile(flat, [name]).select(infer_task("A").alias("t")).first()["t"]
        _require_feature(flat, name)
        return Target(name, task, source)
    ranked = score_targets(column_profile(flat)).orderBy(F.desc("score"), "position").limit(5)
    top = ranked.select("column", "task_type", "score", "name_score", "reason").collect()
    if not top:
        raise ValueError("The table has no rows to infer a target from.")
    first, second = top[0], top[1] if len(top) > 1 else None
    gap = first.score - second.score if second else first.score
    by_name = first.name_score >= 6.0 and (second is None or first.name_score > second.name_score)
    if by_name or (first.score >= 3.0 and (first.name_score > 0 or gap >= 1.5)):
        _require_feature(flat, first.column)
        return Target(first.column, given_task or metadata_task or first.task_type, "heuristic", tuple(top))
    listing = ", ".join(f"{c.column}<{c.task_type}> score={c.score:.2f}" for c in top)
    raise ValueError(f"Could not infer the target column; pass it. Top candidates: {listing}")


def _require_feature(df: DataFrame, target: str) -> None:
    if df.columns == [target]:
        raise ValueError(f"The table only contains the target column {target}.")


def rank_target_candidates(profile: DataFrame) -> DataFrame:
    """Score columns by name position, last place and cardinality; unscored columns are left out."""
    names = F.array(*[F.lit(n) for n in RANKED_TARGET_NAMES])
    spot = F.array_position(names, F.lower(F.col("column")))
    last = profile.agg(F.max("position").alias("__last"))
    profile = lookup_join(profile.withColumn("__k", F.lit(1)), last.withColumn("__k", F.lit(1)), ["__k"])
    distinct = F.col("n_distinct")
    by_count = (F.when((distinct >= 2) & (distinct <= 20), 5)
                .when((distinct / F.greatest(F.col("n_rows"), F.lit(1)) < 0.05) & (distinct >= 2), 3))
    parts = [F.when(spot > 0, F.lit(101) - spot), F.when(F.col("position") == F.col("__last"), 10), by_count]
    total = sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(0))
    scored = profile.withColumn("score", total.cast("bigint")).filter(F.coalesce(*parts).isNotNull())
    return scored.select("column", "position", "score", "n_distinct")


def guess_target_column(names: DataFrame, dataset: str, position: str, name: str) -> DataFrame:
    """One guess per dataset from its column names: known name, target-like part, last column."""
    lower = F.lower(F.col(name))
    known = F.array_position(F.array(*[F.lit(n.lower()) for n in GUESSED_TARGET_NAMES]), lower)
    literal = F.array(*[F.lit(n) for n in GUESSED_TARGET_NAMES])
    exact = F.when(known > 0, F.when(F.get(literal, known.cast("int") - 1) == F.col(name), 0).otherwise(1))
    first_known = F.min(F.when(known > 0, F.struct(known, exact, -F.col(position), F.col(name).alias("pick"))))
    first_like = F.min(F.when(_contains_any(lower, GUESS_SUBSTRINGS),
                              F.struct(F.col(position).alias("p"), F.col(name).alias("pick"))))
    last = F.max(F.struct(F.col(position).alias("p"), F.col(name).alias("pick")))
    grouped = names.groupBy(dataset).agg(first_known.alias("k"), first_like.alias("s"), last.alias("l"),
                                         F.count(F.lit(1)).alias("n"))
    plain_last = (F.col("n") > 2) & ~_contains_any(F.lower(F.col("l.pick")), NOT_TARGET_SUBSTRINGS)
    return grouped.select(dataset, F.coalesce(F.col("k.pick"), F.col("s.pick"),
                                              F.when(plain_last, F.col("l.pick"))).alias("target_column"))


def few_codes(spark, values: Sequence[tuple]) -> DataFrame:
    """Codes of a few (column, value) rows. Python compares strings by code point, which is the
    byte order that Spark sorts by."""
    rows, last = [], None
    for column, value in sorted(tuple(v) for v in values):
        code = code + 1 if column == last else 0
        last = column
        rows.append((column, value, code))
    return rows_to_local(spark, rows, T.DataType.fromDDL("column string, value string, code bigint"))


def ordered_codes(df: DataFrame, columns: Sequence[str], missing: str | None = None) -> DataFrame:
    """(column, value, code): 0-based place of each value among the column's sorted distinct values."""
    text = {c: F.col(c).cast("string") if missing is None
            else F.coalesce(F.col(c).cast("string"), F.lit(missing)) for c in columns}
    cells = F.array(*[F.struct(F.lit(c).alias("column"), v.alias("value")) for c, v in text.items()])
    values = df.select(F.explode(cells).alias("x")).select("x.*").filter("value is not null").distinct()
    rows = collect_small(values)
    if rows is None:
        return positions(stable(values), ["column"], ["value"], "code").withColumn("code", F.col("code") - 1)
    return few_codes(df.sparkSession, rows)


def with_code(df: DataFrame, column: str, codes: DataFrame, output: str, missing: str | None = None) -> DataFrame:
    """Replace string values by their code; joins once, broadcast when the value list is small."""
    text = F.col(column).cast("string")
    text = text if missing is None else F.coalesce(text, F.lit(missing))
    lookup = codes.filter(F.col("column") == column).select(F.col("value").alias("__v"), F.col("code").alias("__c"))
    joined = lookup_join(df.withColumn("__v", text), lookup, ["__v"])
    return joined.withColumn(output, F.col("__c")).drop("__v", "__c")


def normalize_real_dataset(df: DataFrame, preferred: str | None = None,
                           fallbacks: Sequence[str] = ()) -> tuple[DataFrame, str, str]:
    """Rename the chosen column to `target`, code a string target, and infer the task (rule C)."""
    order = [c for c in [preferred, *fallbacks, "target"] if c and c in df.columns]
    if not order:
        ranked = rank_target_candidates(column_profile(df)).orderBy(F.desc("score"), "position")
        order = [r["column"] for r in ranked.limit(1).collect()]
    if not order:
        raise ValueError("Could not determine a target column.")
    chosen = order[0]
    textual = isinstance(df.schema[chosen].dataType, T.StringType)
    out = df if chosen == "target" else df.withColumnRenamed(chosen, "target")
    if textual:
        out = with_code(out, "target", ordered_codes(out, ["target"]), "target")
        out = out.withColumn("target", F.col("target").cast("double"))
    task = column_profile(out, ["target"]).select(infer_task("C").alias("t")).first()["t"]
    return out, chosen, task


def temporal_columns(df: DataFrame) -> list[str]:
    """Datetime columns, strings that are dates in 80% of the cells, and time-named numbers."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    ratios = {}
    if strings:
        counted = df.agg(*[F.try_divide(F.count(datetime_or_null(c)), F.count(c)).alias(c) for c in strings])
        ratios = counted.first().asDict()
    found = []
    for field in df.schema.fields:
        lower = field.name.lower().replace(" ", "_")
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            found.append(field.name)
        elif (ratios.get(field.name) or 0.0) >= 0.8:
            found.append(field.name)
        elif isinstance(field.dataType, T.NumericType) and any(k in lower for k in TEMPORAL_KEYWORDS):
            found.append(field.name)
    return found


class KeywordFinder:
    """Which keywords each text of a batch holds, by steps over all bytes of the batch at once: places where
    the first two bytes of a keyword stand, of these the ones with its next byte, and so on."""

    PIECE = 4 << 20

    def __init__(self, words: Sequence[str]) -> None:
        self.words = [w.encode() for w in words]
        self.pairs: dict[int, list[int]] = {}
        for i, word in enumerate(self.words):
            self.pairs.setdefault(word[0] | word[1] << 8, []).append(i)
        self.begins = np.zeros(1 << 16, bool)
        self.begins[list(self.pairs)] = True

    def held(self, texts: pa.Array) -> np.ndarray:
        """A row per text and a column per keyword."""
        out = np.zeros((len(texts), len(self.words)), bool)
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[:offsets[-1] if len(texts) else 0]
        first = offsets[0] if len(texts) else 0
        for at in range(first, len(data), self.PIECE):
            # pieces overlap by the longest keyword
            piece = data[at:at + self.PIECE + max(map(len, self.words))]
            two = piece[:-1].astype(np.uint16) | piece[1:].astype(np.uint16) << 8
            places = np.flatnonzero(self.begins[two])
            codes = two[places]
            for code, own in self.pairs.items():
                here = places[codes == code]
                for i in own:
                    word = self.words[i]
                    hit = here[here + len(word) <= len(piece)]
                    for step in range(2, len(word)):
                        hit = hit[piece[hit + step] == word[step]]
                    text = np.searchsorted(offsets, hit + at, "right") - 1
                    inside = hit + at + len(word) <= offsets[text + 1]
                    out[text[inside], i] = True
        return out


def classify_domain(df: DataFrame, text: str, output: str = "domain") -> DataFrame:
    """Domain with the most keywords inside `text`; the whole text is searched, once. Of equal scores
    the first domain wins; a text without any keyword, or null, is `unknown`."""
    words = sorted({w for own in DOMAIN_KEYWORDS.values() for w in own})
    member = np.array([[w in own for own in DOMAIN_KEYWORDS.values()] for w in words], np.int64)
    names = pa.array([*DOMAIN_KEYWORDS, "unknown"])

    @F.arrow_udf("string")
    def domain_of(texts: pa.Array) -> pa.Array:
        scores = KeywordFinder(words).held(texts) @ member
        best = np.where(scores.max(axis=1, initial=0) > 0, scores.argmax(axis=1), len(names) - 1)
        return names.take(pa.array(best))

    return df.withColumn(output, domain_of(F.lower(F.col(text))))


def validate_table(df: DataFrame, order: Sequence[str] = (), sample_rows: int | None = None) -> DataFrame:
    """One row: ok, reason, n_rows, n_cols. The whole table is checked, unless the caller asks for the
    first `sample_rows` rows in `order`."""
    if sample_rows is not None:
        if not order:
            raise ValueError("The first rows need an order.")
        df = top_rows(df, list(order), sample_rows)
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    others = [c for c in df.columns if c not in numeric]
    n, width, reason = df.count(), len(df.columns), ""
    if n < 20 or width < 2:
        n, width, reason = 0, 0, f"too small: ({n}, {width})"
    else:
        distinct = distinct_counts(df, others)
        usable = len(numeric) + sum(distinct[c] < 200 for c in others)
        if usable < 2:
            reason = f"only {usable} usable columns"
    return df.sparkSession.range(1).select(F.lit(reason == "").alias("ok"), F.lit(reason).alias("reason"),
                                           F.lit(n).cast("bigint").alias("n_rows"), F.lit(width).cast("bigint").alias("n_cols"))


def raw_text_values(df: DataFrame, columns: Sequence[str], output: str = "raw_text") -> DataFrame:
    return df.withColumn(output, F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
