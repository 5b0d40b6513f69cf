"""Quality grades from an ordinal cumulative-link regression on hashed text.

Model: a document's features x (hashed words, hashed word endings, and classes of length, repetition
and marks; each counts once, and the vector has length one) give s = w·x. Grades 0 … K-1 share w; with
ascending thresholds t the chance of a grade of at least k is sigmoid(s - t_k). That yields the expected
grade, the sum of those chances, and the tail probability of a wanted grade, by which documents are
selected.

The weights are fitted on the driver on at most SAMPLE labelled documents (a documented bound: those
whose id has the smallest hash; hashed features bound what each of them sends). All documents are
scored in full, in one narrow pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import arrays as A
from corpusloom.llm.base import query, table
from corpusloom.llm.blocks import share, shared_thing, text_bytes

#: Hashed features; labelled documents used for the fit; grades; wanted grade and least probability.
FEATURES, SAMPLE, GRADES, WANTED, LEAST = 1 << 16, 6000, 3, 2, 0.5
#: Steps and step size of the fit, and the weight of the squared norm.
STEPS, RATE, SHRINK = 300, 1.0, 1e-6
_CLASSES = 64  # the first features are classes
_MARK = np.zeros(256, bool)
_MARK[list(b"#*$%&|<>!")] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, each once, ascending by text; texts without words have class features only."""
    low = A.LOWER[data]
    starts, ends, first = A.words(low, offsets)
    texts = len(offsets) - 1
    lengths = np.diff(first)
    doc = np.repeat(np.arange(texts), lengths)
    space = np.uint64(FEATURES - _CLASSES)
    word = (A.span_hashes(low, starts, ends) % space).astype(np.int64) + _CLASSES
    tail = np.maximum(ends - 3, starts)
    ending = (A.mix(A.span_hashes(low, tail, ends) + np.uint64(99)) % space).astype(np.int64) + _CLASSES
    marked = np.bincount(doc, weights=_MARK[low[ends - 1]] if len(ends) else None, minlength=texts)
    words = _once(doc * np.int64(FEATURES) + word)
    distinct = np.bincount(words // FEATURES, minlength=texts)
    size = np.maximum(lengths, 1)
    every = np.arange(texts) * np.int64(FEATURES)
    classes = [every + np.minimum(np.log2(size).astype(np.int64), 19),
               every + 20 + np.minimum((10 * distinct / size).astype(np.int64), 10),
               every + 32 + np.minimum((20 * marked / size).astype(np.int64), 20)]
    pairs = _once(np.concatenate([words, doc * np.int64(FEATURES) + ending, *classes]))
    return pairs // FEATURES, pairs % FEATURES


def _once(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def sampler(batches):
    for batch in batches:
        data, offsets = A.buffer_of(batch.column("data"))
        doc, feature = features(data, offsets)
        cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1))
        yield pa.RecordBatch.from_pydict({
            "grade": batch.column("grade"),
            "features": A.binary(feature[cuts[i]:cuts[i + 1]].astype(np.int32) for i in range(batch.num_rows))})


class Model:
    """Shared weights and ascending thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, doc: np.ndarray, feature: np.ndarray, texts: int) -> np.ndarray:
        """Probability of at least grade 1, 2, … for each text."""
        size = np.maximum(np.bincount(doc, minlength=texts), 1)
        score = np.bincount(doc, weights=self.weights[feature], minlength=texts) / np.sqrt(size)
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -500, 500)))


def fit(grades: np.ndarray, doc: np.ndarray, feature: np.ndarray, count: int = GRADES) -> Model:
    """Maximum likelihood with a small penalty, by Adam on all rows; deterministic."""
    n = max(len(grades), 1)
    size = np.sqrt(np.maximum(np.bincount(doc, minlength=n), 1))
    share = np.array([(np.sum(grades >= k) + 0.5) / (n + 1.0) for k in range(1, count)])
    # thresholds are a first value and positive gaps, so they stay in order
    start = -np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(start), 0.05))
    theta = np.concatenate([np.zeros(FEATURES), start[:1], gaps])
    one, two = np.zeros_like(theta), np.zeros_like(theta)
    rows = np.arange(len(grades))
    for step in range(1, STEPS + 1 if len(grades) else 1):
        weights, head = theta[:FEATURES], theta[FEATURES:]
        thresholds = np.concatenate([head[:1], head[0] + np.cumsum(np.exp(head[1:]))])
        score = np.bincount(doc, weights=weights[feature], minlength=n) / size
        tail = 1 / (1 + np.exp(-np.clip(score[:, None] - thresholds, -50, 50)))
        full = np.hstack([np.ones((n, 1)), tail, np.zeros((n, 1))])
        slope = np.hstack([np.zeros((n, 1)), tail * (1 - tail), np.zeros((n, 1))])
        p = np.maximum(full[rows, grades] - full[rows, grades + 1], 1e-9)
        d_score = (slope[rows, grades] - slope[rows, grades + 1]) / p
        d_threshold = np.zeros(count + 1)
        np.add.at(d_threshold, grades, -slope[rows, grades] / p)
        np.add.at(d_threshold, grades + 1, slope[rows, grades + 1] / p)
        d_threshold = d_threshold[1:count]
        grad = np.empty_like(theta)
        grad[:FEATURES] = -np.bincount(feature, weights=(d_score / size)[doc], minlength=FEATURES) / n + SHRINK * weights
        grad[FEATURES] = -d_threshold.sum() / n
        for j in range(1, count - 1):
            grad[FEATURES + j] = -d_threshold[j:].sum() * np.exp(head[j]) / n
        one = 0.9 * one + 0.1 * grad
        two = 0.999 * two + 0.001 * grad * grad
        theta -= RATE * (one / (1 - 0.9 ** step)) / (np.sqrt(two / (1 - 0.999 ** step)) + 1e-8)
    head = theta[FEATURES:]
    return Model(theta[:FEATURES], np.concatenate([head[:1], head[0] + np.cumsum(np.exp(head[1:]))]))


def train(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text: str = "text", sample: int = SAMPLE,
          grades: int = GRADES) -> Model:
    """Model of the graded documents; `ratings` has the id and `grade`, one row per id is used (the lowest)."""
    rated = ratings.filter(F.col(id_col).isNotNull() & F.col("grade").between(0, grades - 1)) \
        .groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.min("grade").cast("int").alias("grade"))
    chosen = rated.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), text_bytes(F.col(text)).alias("data")) \
        .join(F.broadcast(chosen), "__id").select("grade", "data")  # at most `sample` pairs of numbers
    found = sorted((r["grade"], bytes(r["features"])) for r in rows.mapInArrow(sampler, "grade int, features binary").collect())
    parts = [np.frombuffer(f, np.int32) for _, f in found]
    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    feature = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return fit(np.array([g for g, _ in found], np.int64), doc, feature, grades)


def scorer(shared, wanted: int):
    def run(batches):
        model = shared_thing(shared)
        for batch in batches:
            data, offsets = A.buffer_of(batch.column("data"))
            tails = np.zeros((batch.num_rows, len(model.thresholds)))
            # some texts at a time, so that memory follows the longest text and not the batch
            parts = np.unique(np.searchsorted(offsets[:-1], np.arange(0, len(data) + 1, 4 << 20)))
            parts = parts[parts < batch.num_rows]
            for a, z in zip(parts, [*parts[1:], batch.num_rows]):
                doc, feature = features(data[offsets[a]:offsets[z]], offsets[a:z + 1] - offsets[a])
                tails[a:z] = model.tails(doc, feature, z - a)
            yield pa.RecordBatch.from_pydict({
                "row": batch.column("row"), "expected_grade": pa.array(tails.sum(1)),
                "tail_probability": pa.array(tails[:, wanted - 1])})
    return run


def grade_texts(docs: DataFrame, model: Model, wanted: int = WANTED, least: float = LEAST, text: str = "text") -> DataFrame:
    """row (all columns but the text), expected_grade, tail_probability and kept for every document.

    Null and empty texts have no words, only the classes of a text without any, and are graded by
    those. Rows without an id are graded like others; repeated rows get equal grades; an empty table
    gives no rows; extra columns of any name travel inside `row`. Without ratings all weights are 0.
    """
    shared = share(docs.sparkSession, model)  # FEATURES numbers
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row"),
                       text_bytes(F.col(text)).alias("data"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, expected_grade double, tail_probability double"
    return rows.mapInArrow(scorer(shared, wanted), schema).withColumn("kept", F.col("tail_probability") >= least)


def grade_of(quality: Column, toxic: Column) -> Column:
    """Grades of the labels: 0 bad, 1 good but toxic, 2 good; a missing toxic mark means none."""
    return F.when(quality == 0, 0).when(quality == 1, F.when(F.coalesce(toxic, F.lit(0)) == 1, 1).otherwise(2))


@query("op6_grade_model")
def op6_grade_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, probability of the best grade and choice for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    model = train(docs, labels.select("doc_id", grade_of(F.col("quality"), F.col("toxic")).alias("grade")))
    return grade_texts(docs, model).select(F.col("row.doc_id").alias("doc_id"), "expected_grade", "tail_probability", "kept")
