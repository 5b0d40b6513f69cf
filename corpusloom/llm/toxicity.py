"""Toxicity from confirmed toxic examples and unlabelled text: non-negative positive-unlabelled learning.

Nothing is taken as clean. With P the confirmed toxic documents, U texts of unknown kind and q the share
of toxic ones among all (the class prior), the risk of a classifier z is q E_P[l(z)], for missed toxic
text, and E_U[l(-z)] - q E_P[l(-z)], for clean text that is called toxic. A classifier that can bend far
enough drives the second part below zero, which no risk can be; where that happens the step climbs back
on this part alone. l is the logistic loss, so that 1 / (1 + exp(-z)) estimates the chance of toxic.

z is linear in terms: words, their beginnings, and either found three times or more. Terms that P
holds more often than U, by more than chance explains, are chosen by counts over the sample. The fit
uses at most POSITIVES and UNLABELLED documents, drawn by a hash of the id (documented bounds); every
document is scored by its whole text, in one narrow pass.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.arrays import pieces
from corpusloom.llm.base import query, table
from corpusloom.llm.blocks import share, shared_thing, stored, text_bytes

#: Documents of the fit at most; terms chosen at most; positive documents that a term needs.
POSITIVES, UNLABELLED, TERMS, SUPPORT = 8_000, 16_000, 2_000, 3
#: Chance that any term is chosen which P and U hold equally often.
CHANCE = 1.0
#: Characters of the beginnings of words; how often a term must be found to count as frequent.
BEGINNINGS, OFTEN = (4, 5, 6), 3
#: Steps and step size of the fit, the weight of the squared norm, the risk below which the step turns
#: round, and the prior where no labelled document tells it.
STEPS, RATE, SHRINK, BELOW, PRIOR = 300, 0.1, 1e-4, 0.0, 0.1
#: Terms that a task counts before it hands the counts on, and words it remembers.
HELD, KNOWN = 300_000, 200_000
#: Letters, digits and all bytes above 127, lower-cased; every other byte parts words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def word_counts(text: bytes) -> Counter:
    found: Counter = Counter()
    for piece in pieces(text.translate(_WORDS)):
        found.update(piece.split(b" "))
    found.pop(b"", None)
    return found


def terms_of(word: bytes) -> tuple[bytes, ...]:
    """The word, and its beginnings (ending in *) if it is longer."""
    letters = word.decode("utf-8", "replace")
    return (word, *((letters[:n] + "*").encode() for n in BEGINNINGS if len(letters) > n))


def text_terms(text: bytes, known: dict) -> set[bytes]:
    """Terms of a text, each once; with a + those that it holds OFTEN times or more."""
    total: Counter = Counter()
    for word, n in word_counts(text).items():
        terms = known.get(word)
        if terms is None:
            if len(known) >= KNOWN:
                known.clear()
            terms = known[word] = terms_of(word)
        for term in terms:
            total[term] += n
    return {*total, *(t + b"+" for t, n in total.items() if n >= OFTEN)}


def term_counter(batches):
    """(term, positive, unlabelled): documents of the sample that hold each term, per task."""
    known: dict = {}
    counts = Counter(), Counter()

    def given():
        terms = list(counts[0].keys() | counts[1].keys())
        for at in range(0, len(terms), 50_000):
            part = terms[at:at + 50_000]
            yield pa.RecordBatch.from_pydict({
                "term": pa.array(part, pa.binary()), "positive": pa.array([counts[1][t] for t in part], pa.int64()),
                "unlabelled": pa.array([counts[0][t] for t in part], pa.int64())})
        for c in counts:
            c.clear()
    for batch in batches:
        for text, positive in zip(batch.column("data"), batch.column("positive").to_pylist()):
            counts[positive].update(text_terms(text.as_py(), known))
            if len(counts[0]) + len(counts[1]) > HELD:
                yield from given()
    yield from given()


class Terms:
    """Place of each chosen term; words are looked up once and remembered."""

    def __init__(self, terms: list[bytes]):
        self.places = {t: i for i, t in enumerate(terms)}
        self.bare = {t.removesuffix(b"+") for t in terms}
        self.known: dict[bytes, tuple] = {}

    def of(self, text: bytes) -> list[int]:
        """Places of the chosen terms that the text holds, ascending."""
        total: Counter = Counter()
        for word, n in word_counts(text).items():
            hits = self.known.get(word)
            if hits is None:
                if len(self.known) >= KNOWN:
                    self.known.clear()
                hits = self.known[word] = tuple(t for t in terms_of(word) if t in self.bare)
            for term in hits:
                total[term] += n
        held = [self.places[t] for t in total if t in self.places]
        held += [self.places[t + b"+"] for t, n in total.items() if n >= OFTEN and t + b"+" in self.places]
        return sorted(held)


class Classifier:
    def __init__(self, terms: list[bytes], weights: np.ndarray, bias: float):
        self.terms, self.weights, self.bias = Terms(terms), weights, bias

    def __getstate__(self):
        return list(self.terms.places), self.weights, self.bias

    def __setstate__(self, state):
        self.__init__(*state)

    def score(self, text: bytes) -> float:
        """Chance that the text is toxic."""
        z = self.bias + float(self.weights[self.terms.of(text)].sum())
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def risks(theta: np.ndarray, doc: np.ndarray, term: np.ndarray, positive: np.ndarray, prior: float):
    """The two parts of the risk and their gradients; the last entry of theta is the bias."""
    z = np.bincount(doc, weights=theta[term], minlength=len(positive)) + theta[-1]
    chance = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    missed, called = np.logaddexp(0, -z), np.logaddexp(0, z)  # l(z) and l(-z)
    p = positive / max(positive.sum(), 1)
    u = (~positive) / max((~positive).sum(), 1)

    def slope(per_doc):
        return np.append(np.bincount(term, weights=per_doc[doc], minlength=len(theta) - 1), per_doc.sum())
    toxic = prior * (p @ missed), slope(prior * p * (chance - 1))
    clean = u @ called - prior * (p @ called), slope((u - prior * p) * chance)
    return toxic, clean


def fit(doc: np.ndarray, term: np.ndarray, positive: np.ndarray, terms: int, prior: float, steps: int = STEPS) -> np.ndarray:
    """Weights and bias of least non-negative risk, by Adam on all rows; deterministic."""
    theta = np.zeros(terms + 1)
    theta[-1] = math.log(prior / (1 - prior))
    one, two = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1 if positive.any() and not positive.all() else 1):
        (_, toxic), (risk, clean) = risks(theta, doc, term, positive, prior)
        grad = toxic + clean if risk >= BELOW else -clean
        grad[:-1] += SHRINK * theta[:-1]
        one = 0.9 * one + 0.1 * grad
        two = 0.999 * two + 0.001 * grad * grad
        theta -= RATE * (one / (1 - 0.9 ** step)) / (np.sqrt(two / (1 - 0.999 ** step)) + 1e-8)
    return theta


def holder(shared):
    def run(batches):
        terms = shared_thing(shared)
        for batch in batches:
            held = [np.array(terms.of(t.as_py()), np.int32).tobytes() for t in batch.column("data")]
            yield pa.RecordBatch.from_pydict({"positive": batch.column("positive"), "held": pa.array(held, pa.binary())})
    return run


def sample_of(docs: DataFrame, ratings: DataFrame, learn: Column, id_col: str, text: str) -> tuple[DataFrame, float]:
    """(positive, data) of the documents of the fit, and the class prior.

    Of the documents to learn from, those that a rating calls toxic are the positives. Unlabelled text is
    drawn from all of them, toxic ones included, as the risk takes it. The prior is the share of toxic
    documents among the rated ones to learn from, kept between 0.001 and 0.5. Only ids are ordered.
    """
    ids = docs.filter(learn & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("__id")).distinct()
    rated = ratings.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("__id")).agg(
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("__toxic"))
    marked = ids.join(rated, "__id", "left")
    order = [F.xxhash64("__id", F.lit(13)), F.col("__id")]
    known = marked.filter("__toxic IS NOT NULL").agg(F.count(F.lit(1)).alias("n"), F.count_if("__toxic").alias("k")).first()
    prior = min(0.5, max(0.001, known.k / known.n)) if known.n else PRIOR
    drawn = marked.filter("__toxic").orderBy(*order).limit(POSITIVES).select("__id", F.lit(True).alias("positive")).unionByName(
        marked.orderBy(*order).limit(UNLABELLED).select("__id", F.lit(False).alias("positive")))
    texts = docs.filter(learn).select(F.col(id_col).cast("bigint").alias("__id"), text_bytes(F.col(text)).alias("data"))
    rows = texts.join(F.broadcast(drawn), "__id").select("positive", "data")  # at most POSITIVES + UNLABELLED ids
    return rows, prior


def train(docs: DataFrame, ratings: DataFrame, learn: Column, id_col: str = "doc_id", text: str = "text") -> Classifier:
    """Classifier from the documents for which `learn` holds; `ratings` has the id and `toxic`.

    Without positives no term is chosen and every text gets the prior.
    """
    rows, prior = sample_of(docs, ratings, learn, id_col, text)
    rows = stored(rows, "toxicity-sample")
    sizes = rows.agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u")).first()
    counts = rows.mapInArrow(term_counter, "term binary, positive long, unlabelled long").groupBy("term").agg(
        F.sum("positive").alias("p"), F.sum("unlabelled").alias("u")).filter(F.col("p") >= SUPPORT)
    # how far p lies above what U lets expect: the exponent of the Poisson tail, held against chance over all terms
    counts = stored(counts, "toxicity-terms")
    expected = (F.col("u") + 0.5) / ((sizes.u or 0) + 1) * (sizes.p or 1)
    excess = F.col("p") * F.log(F.col("p") / expected) - F.col("p") + expected
    best = counts.filter((F.col("p") > expected) & (excess > math.log(max(counts.count(), 1) / CHANCE)))
    terms = [bytes(r.term) for r in best.orderBy(excess.desc(), "term").limit(TERMS).select("term").collect()]
    held = rows.mapInArrow(holder(share(docs.sparkSession, Terms(terms))), "positive boolean, held binary").collect()
    held = sorted((r.positive, bytes(r.held)) for r in held)
    parts = [np.frombuffer(h, np.int32) for _, h in held]
    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    term = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    theta = fit(doc, term, np.array([p for p, _ in held], bool), len(terms), prior)
    return Classifier(terms, theta[:-1], float(theta[-1]))


def scorer(shared):
    def run(batches):
        model = shared_thing(shared)
        for batch in batches:
            scores = [model.score(t.as_py()) for t in batch.column("data")]
            yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "score": pa.array(scores, pa.float64())})
    return run


def score_texts(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """row (all columns but the text), score and predicted for every document.

    Null and empty texts hold no term and get the score of the bias. Rows without an id are scored like
    others; repeated rows and equal texts get equal scores; an empty table gives no rows; extra columns
    of any name travel inside `row`. Very long texts are read in pieces. A score of 0.5 is predicted 1.
    """
    shared = share(docs.sparkSession, model)  # at most TERMS terms
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row"),
                       text_bytes(F.col(text)).alias("data"))
    scored = rows.mapInArrow(scorer(shared), f"row {rows.schema['row'].dataType.simpleString()}, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op13_toxicity")
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every document; those whose crc32(doc_id) mod 5 is 0 are held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), ~held_out)
    held_out = F.coalesce(F.crc32(F.col("row.doc_id").cast("string")) % 5 == 0, F.lit(False))
    return score_texts(docs, model).select(F.col("row.doc_id").alias("doc_id"), held_out.alias("held_out"), "score", "predicted")
