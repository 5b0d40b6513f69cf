"""Ordered quality gates over one table or many tables keyed by dataset."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from corpusloom.functions.hashing import hash_unit, row_hash
from corpusloom.functions.text import fixed_point
from .metrics import roc_auc
from .scale import lookup_join


def _first_failing(columns: Sequence[str], tests: dict[str, Column]) -> Column:
    """Name of the first column whose test holds, else null."""
    return F.coalesce(*[F.when(tests[c], F.lit(c)) for c in columns]) if columns else F.lit(None).cast("string")


def column_gates(df: DataFrame, dataset: Sequence[str], numeric: Sequence[str], features: Sequence[str],
                 rule: str = "pod") -> DataFrame:
    """Per dataset: n_rows, first constant numeric column, first all-null column.

    Rule "pod": constant means fewer than two different values. Rule "corpus": at most one value,
    or a population std below 1e-10. Minimum against maximum stands in for a distinct count.
    """
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    aggs += [F.count(c).alias(f"__n_{c}") for c in dict.fromkeys([*features, *numeric])]
    if rule == "pod":
        aggs += [F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias(f"__c_{c}") for c in numeric]
    else:
        aggs += [((F.count(c) <= 1) | (F.coalesce(F.stddev_pop(c), F.lit(0.0)) < 1e-10)).alias(f"__c_{c}") for c in numeric]
    sums = df.groupBy(*dataset).agg(*aggs)
    return sums.select(*dataset, "n_rows", _first_failing(numeric, {c: F.col(f"__c_{c}") for c in numeric}).alias("constant_column"),
                       _first_failing(features, {c: F.col(f"__n_{c}") == 0 for c in features}).alias("null_column"))


def class_gates(df: DataFrame, dataset: Sequence[str], target: str, rule: str = "pod") -> DataFrame:
    """Per dataset: number of classes and share of the smallest. Rule "pod" divides by all rows,
    rule "corpus" by the rows with a label."""
    counts = df.groupBy(*dataset, target).agg(F.count(F.lit(1)).alias("n"))
    labelled = F.when(F.col(target).isNotNull(), F.col("n"))
    whole = F.sum("n") if rule == "pod" else F.sum(labelled)
    return counts.groupBy(*dataset).agg(F.count(labelled).alias("n_classes"),
                                        F.try_divide(F.min(labelled), whole).alias("minority_share"))


def duplicate_share(df: DataFrame, dataset: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Share of rows that repeat an earlier row, per dataset. Only 8-byte row hashes are
    shuffled; rows are compared in full only where two hashes are equal."""
    work = df.withColumn("__h", F.xxhash64(*columns))
    hashes = work.groupBy(*dataset, "__h").agg(F.count(F.lit(1)).alias("n"))
    rows = hashes.groupBy(*dataset).agg(F.sum("n").alias("n_rows"), F.count_if(F.col("n") == 1).alias("single"))
    shared = hashes.filter(F.col("n") > 1).select(*dataset, "__h")
    repeated = lookup_join(work, shared, [*dataset, "__h"], how="left_semi")
    distinct = repeated.groupBy(*dict.fromkeys([*dataset, *columns])).agg(F.lit(1).alias("one"))
    distinct = distinct.groupBy(*dataset).agg(F.count(F.lit(1)).alias("more"))
    out = lookup_join(rows, distinct, list(dataset))
    unique = F.col("single") + F.coalesce(F.col("more"), F.lit(0))
    return out.select(*dataset, "n_rows", (1 - unique / F.col("n_rows")).alias("duplicate_share"))


def pairwise_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(left, right, correlation) for every pair of numeric columns, over the rows where both are
    present; null when one of them is constant there.

    Each task multiplies its centred columns into one small matrix of sums, so the table is read
    once whatever the number of pairs, and only those sums are shuffled.
    """
    chosen = list(columns)
    pairs = [(i, j) for i in range(len(chosen)) for j in range(i + 1, len(chosen))]
    slim = df.select(*[F.col(c).cast("double").alias(c) for c in chosen])
    means = np.array([m if m is not None else 0.0 for m in slim.agg(*[F.avg(c) for c in chosen]).first()])

    def sums(batches):
        total = None
        for batch in batches:
            raw = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            here = (~np.isnan(raw)).astype(float)
            z = np.where(here > 0, raw - means, 0.0)
            part = np.stack([here.T @ here, z.T @ here, (z * z).T @ here, z.T @ z])
            total = part if total is None else total + part
        if total is not None:
            cells = [[i, j, total[0, i, j], total[1, i, j], total[1, j, i], total[2, i, j], total[2, j, i], total[3, i, j]]
                     for i, j in pairs]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(cells, columns=["i", "j", "n", "sx", "sy", "qx", "qy", "p"])
                                             .astype({"i": "int32", "j": "int32"}), preserve_index=False)

    parts = slim.mapInArrow(sums, "i int, j int, n double, sx double, sy double, qx double, qy double, p double")
    total = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "qx", "qy", "p")])

    def spread(q: str, s: str) -> Column:
        # what rounding leaves of a constant column counts as no spread
        v = F.col(q) - F.col(s) * F.col(s) / F.col("n")
        return F.when((F.col("n") > 0) & (v > F.col(q) * 1e-12), v)

    joint = F.col("p") - F.try_divide(F.col("sx") * F.col("sy"), F.col("n"))
    names = F.array(*[F.lit(c) for c in chosen])
    return total.select(F.get(names, "i").alias("left"), F.get(names, "j").alias("right"),
                        (joint / F.sqrt(spread("qx", "sx") * spread("qy", "sy"))).alias("correlation"))


def max_pairwise_correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: largest absolute correlation of two numeric columns (0 without any), and a soft note
    above 0.99."""
    top = pairwise_correlations(df, columns).agg(F.coalesce(F.max(F.abs("correlation")), F.lit(0.0)).alias("max_correlation")) \
        if len(columns) > 1 else df.sparkSession.range(1).select(F.lit(0.0).alias("max_correlation"))
    # Fixed value: the text of the note is read by others.
    return top.withColumn("note", F.when(F.col("max_correlation") > 0.99, F.format_string("SOFT_WARN: max_corr=%s", fixed_point("max_correlation", 3))).otherwise(""))


def gate_verdict(df: DataFrame, dataset: Sequence[str], target: str, task: str, numeric: Sequence[str],
                 features: Sequence[str], rule: str = "pod", min_rows: int | None = None,
                 duplicate_columns: Sequence[str] | None = None) -> DataFrame:
    """(dataset, passed, reason): first failing gate in fixed order. `task` names a column.

    Rule "pod": constant, all-null, classes, minority, duplicates >= 0.50, fewer than 100 rows.
    Rule "corpus": fewer than 50 rows first, duplicates > 0.50 without metadata last.
    """
    least = min_rows if min_rows is not None else (100 if rule == "pod" else 50)
    compared = list(duplicate_columns or [*features, target])
    table = column_gates(df, dataset, numeric, features, rule)
    tasks = df.groupBy(*dataset).agg(F.first(task).alias("__task"))
    repeats = duplicate_share(df, dataset, compared).drop("n_rows")
    for side in (class_gates(df, dataset, target, rule), repeats, tasks):
        table = lookup_join(table, side, list(dataset))
    classified = F.col("__task").isin("binary", "multiclass")
    few = F.when(F.col("n_rows") < least, F.format_string("gate_fail: only %d rows", "n_rows"))
    constant = F.when(F.col("constant_column").isNotNull(), F.concat(F.lit("gate_fail: constant column "), "constant_column"))
    empty = F.when(F.col("null_column").isNotNull(), F.concat(F.lit("gate_fail: all-null column "), "null_column"))
    one_class = F.when(classified & (F.col("n_classes") < 2), F.lit("gate_fail: target has < 2 classes"))
    minority = F.when(classified & (F.col("minority_share") < 0.01),
                      F.format_string("gate_fail: minority_frac=%s", fixed_point("minority_share", 4)))
    share = F.col("duplicate_share")
    repeated = F.when(share >= 0.50 if rule == "pod" else share > 0.50, F.format_string("gate_fail: dupe_frac=%s", fixed_point(share, 2)))
    chain = ([constant, empty, one_class, minority, repeated, few] if rule == "pod"
             else [few, constant, one_class, minority, repeated])
    reason = F.coalesce(*chain, F.lit(""))
    return table.select(*dataset, (reason == "").alias("passed"), reason.alias("reason"))


# The category of a missing text, and fewest rows that are scored.
MISSING_TEXT = "__NA__"
SCORED_ROWS = 30


def utility_check(df: DataFrame, features: Sequence[str], target: str, task: str, key: Sequence[str],
                  folds: int = 3, trees: int = 20, depth: int = 5, seed: int = 0,
                  sample_rows: int | None = None) -> tuple[float, str]:
    """(score, note): mean held-out score of a random forest, and a soft note or an empty one.

    R2 for regression; else AUC, with several classes each against the rest; if a fold has no AUC, the
    accuracy of all folds. Text features are coded by their sorted values, missing text is a value of
    its own, and missing numbers are 0. Fewer than 30 rows or no feature give 0.0, and so does an error,
    whose text is in the note. `sample_rows` bounds the rows of the fit on request. Folds come from the
    row hash.
    """
    if df.limit(SCORED_ROWS).count() < SCORED_ROWS:
        return 0.0, ""
    if not features:
        return 0.0, "SOFT_WARN: no usable features"
    try:
        score = utility_score(df, features, target, task, key, folds, trees, depth, seed, sample_rows)
    except Exception as error:  # the note is the result: a table is not refused because its score fails
        return 0.0, f"SOFT_WARN: utility_check_error: {error}"
    if task == "regression":
        return score, f"SOFT_WARN: R2={score:.3f}" if score <= 0 else ""
    return score, f"SOFT_WARN: AUC={score:.3f}" if score < 0.55 else ""


def utility_score(df: DataFrame, features: Sequence[str], target: str, task: str, key: Sequence[str],
                  folds: int = 3, trees: int = 20, depth: int = 5, seed: int = 0,
                  sample_rows: int | None = None) -> float:
    """The score of `utility_check` for a table that can be scored; errors are raised."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import RandomForestRegressor

    from .infer import ordered_codes, with_code
    from .sampling import fixed_size_sample

    rows = df if sample_rows is None else fixed_size_sample(df, sample_rows, key, seed)
    numbers = [c for c in features if isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType))]
    texts = [c for c in features if c not in numbers]
    rows = rows.dropna(subset=[target])
    codes = ordered_codes(rows, texts, MISSING_TEXT) if texts else None
    for i, c in enumerate(texts):
        rows = with_code(rows, c, codes, f"__c{i}", MISSING_TEXT)
    inputs = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in numbers]
    inputs += [F.coalesce(F.col(f"__c{i}").cast("double"), F.lit(-1.0)) for i in range(len(texts))]
    rows = rows.select(*key, target, *[x.alias(f"__x{i}") for i, x in enumerate(inputs)])
    if task == "regression":
        rows = rows.withColumn("__y", F.col(target).cast("double"))
    else:
        rows = with_code(rows, target, ordered_codes(rows, [target]), "__y").withColumn("__y", F.col("__y").cast("double"))
    rows = rows.withColumn("__fold", F.floor(hash_unit(row_hash(seed, F.lit("fold"), *key)) * folds))
    data = VectorAssembler(inputCols=[f"__x{i}" for i in range(len(inputs))], outputCol="features").transform(rows)
    data = data.select("features", "__y", "__fold").persist()
    scores, accuracies, undefined = [], [], False
    try:
        for held in range(folds):
            train, test = data.filter(F.col("__fold") != held), data.filter(F.col("__fold") == held)
            if task == "regression":
                model = RandomForestRegressor(labelCol="__y", numTrees=trees, maxDepth=depth, seed=seed).fit(train)
                scores.append(RegressionEvaluator(labelCol="__y", metricName="r2").evaluate(model.transform(test)))
                continue
            model = RandomForestClassifier(labelCol="__y", numTrees=trees, maxDepth=depth, seed=seed).fit(train)
            scored = model.transform(test).withColumn("p", vector_to_array("probability")).select("__y", "p", "prediction")
            accuracies.append(scored.agg(F.avg((F.col("__y") == F.col("prediction")).cast("double"))).first()[0])
            targets = [1] if model.numClasses == 2 else range(model.numClasses)
            areas = [] if undefined else [
                roc_auc(scored.select((F.col("__y") == c).cast("int").alias("y"), F.col("p")[c].alias("score")), "y", "score").first()["roc_auc"]
                for c in targets]
            undefined = undefined or any(a is None for a in areas)
            scores.append(None if undefined else sum(areas) / len(areas))
    finally:
        data.unpersist()
    # folds of different measures are never averaged
    scores = accuracies if undefined else scores
    return float(sum(scores) / len(scores))


def check_table(df: DataFrame, features: Sequence[str], target: str, task: str, key: Sequence[str],
                rule: str = "pod", min_rows: int | None = None, **fit) -> tuple[bool, float, str]:
    """(passed, score, notes) of one table: the hard gates in order, then the score and the soft notes."""
    one = df.withColumns({"__table": F.lit(1), "__task": F.lit(task)})
    numeric = [c for c in features if isinstance(df.schema[c].dataType, T.NumericType)]
    verdict = gate_verdict(one, ["__table"], target, "__task", numeric, features, rule, min_rows).first()
    if verdict is None:
        return False, 0.0, "gate_fail: only 0 rows"
    if not verdict["passed"]:
        return False, 0.0, verdict["reason"]
    score, note = utility_check(df, features, target, task, key, **fit)
    return True, score, "; ".join(x for x in (note, max_pairwise_correlation(df, numeric).first()["note"]) if x)


def utility_notes(scores: DataFrame, task: str = "task_type", score: str = "score") -> DataFrame:
    """Soft notes, and whether real data is kept (R2 >= -1, AUC >= 0.5)."""
    regression = F.col(task) == "regression"
    weak_r2, weak_auc = regression & (F.col(score) <= 0), ~regression & (F.col(score) < 0.55)
    note = (F.when(weak_r2, F.format_string("SOFT_WARN: R2=%s", fixed_point(score, 3)))
            .when(weak_auc, F.format_string("SOFT_WARN: AUC=%s", fixed_point(score, 3))).otherwise(""))
    keep = F.when(regression, F.col(score) >= -1.0).otherwise(F.col(score) >= 0.5)
    return scores.withColumns({"note": note, "keep": keep})


def utility_floor(scores: DataFrame, task: str = "task_type", score: str = "score") -> DataFrame:
    return utility_notes(scores, task, score).filter("keep").drop("keep")


def ingest_verdict(tables: DataFrame, n_rows: str, n_cols: str, target: str, encode_error: str, gate_reason: str,
                   min_rows: int = 50) -> DataFrame:
    """First failing step per table, else ok; the detail column says why."""
    rows = F.col(n_rows)
    status = (F.when(rows == 0, "empty").when(rows < min_rows, "too_small").when(F.col(n_cols) < 3, "too_few_cols")
              .when(F.col(target).isNull(), "no_target").when(F.col(encode_error).isNotNull(), "encode_failed")
              .when(F.coalesce(F.col(gate_reason), F.lit("")) != "", "gate_fail").otherwise("ok"))
    detail = (F.when(F.col("status") == "empty", "no rows")
              .when(F.col("status") == "too_small", F.format_string("only %d rows", rows))
              .when(F.col("status") == "too_few_cols", F.format_string("only %d columns", F.col(n_cols)))
              .when(F.col("status") == "no_target", "could not identify target column")
              .when(F.col("status") == "encode_failed", F.col(encode_error))
              .when(F.col("status") == "gate_fail", F.col(gate_reason)))
    return tables.withColumn("status", status).withColumn("error", detail)


def gate_report(results: DataFrame, run: Sequence[str], status: str = "status", score: str = "score") -> DataFrame:
    """Counts of ok, gate_fail and other statuses per run, and the mean of positive scores."""
    ok, fail = F.col(status) == "ok", F.col(status) == "gate_fail"
    return results.groupBy(*run).agg(
        F.count_if(ok).alias("n_ok"), F.count_if(fail).alias("n_gate_fail"), F.count_if(~ok & ~fail).alias("n_error"),
        F.coalesce(F.avg(F.when(ok & (F.col(score) > 0), F.col(score))), F.lit(0.0)).alias("mean_score"))
