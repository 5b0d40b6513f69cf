"""Quality rules whose cutoffs are set so that good documents are rejected rarely, with proof.

Base rules are fixed. Three more rules compare a ratio with a cutoff of its own for each stratum. The
cutoffs are chosen on labelled documents (the holdout; nothing else is fitted). A stratum goes through
one list of settings, from no rule to all rules at their strictest: each step adds or tightens one cutoff.
At every step the number k of n good texts that any cutoff set so far rejects is tested: if k or fewer
rejections had a probability of at most DELTA / strata at the rate ALPHA (exact binomial tail), the rate of
all rules together is below ALPHA. The first failure ends the list (fixed-sequence testing, so that no
correction among steps and rules is due), and the division by the number of strata corrects for the other
lists (Bonferroni). With probability 1 - DELTA no stratum loses more than ALPHA of its good texts to these
rules. All proven steps hold at once, so any of them may be taken: it is the one at which the share of
rejected bad texts exceeds that of good ones the most, the mildest of equals; a cutoff that only costs good
texts is not used. A trial is a text: equal texts of a stratum count once. Near copies count each, so the bound is about
texts drawn independently.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.arrays import SPACES
from corpusloom.llm.base import query, table
from corpusloom.llm.blocks import text_bytes
from corpusloom.session import stable

SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))
#: Texts of more words are counted with arrays instead of sets of tuples, in less memory.
MANY_WORDS = 200_000

#: Allowed share of good documents lost per stratum, and the chance that a bound fails anywhere.
ALPHA, DELTA = 0.01, 0.05
#: Named strata; all other languages, and none, form the last one.
STRATA = ("de", "en", "es", "fr")
#: Ratio of each rule, and its cutoffs from the mildest on: a document fails above the cutoff. The rules are
#: tightened in this order, each to its end; the bound decides where a stratum stops.
RULES = {
    "symbols": ("n_symbols / greatest(n_words, 1)", (1.0, 0.7, 0.5, 0.3, 0.2, 0.1, 0.05, 0.02)),
    "lines": ("n_dup_lines / greatest(n_words, 1)", (0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02)),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", (0.18, 0.16, 0.14, 0.12, 0.1, 0.08, 0.06, 0.04, 0.02)),
}


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of five words found twice or more in the text."""
    n = len(words) - 4
    if n < 2:
        return 0
    if len(words) > MANY_WORDS:
        return _repeated_many(words)
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    seen: set = set()
    add = seen.add
    again = {w for w in windows if w in seen or add(w)} if len(set(windows)) < n else seen
    if again is seen:
        return 0
    inside = np.zeros(len(words) + 1, np.int64)
    at = np.fromiter((i for i, w in enumerate(windows) if w in again), np.int64)
    np.add.at(inside, at, 1)
    np.subtract.at(inside, at + 5, 1)
    return int((np.cumsum(inside) > 0).sum())


def _repeated_many(words: list[bytes]) -> int:
    codes: dict[bytes, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
    rank, size = ids, len(codes)
    for k in range(1, 5):
        key = rank[:-1] * np.int64(len(codes)) + ids[k:]
        order = np.argsort(key)
        new = np.diff(key[order], prepend=-1) != 0
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(new) - 1
        size = int(new.sum())
    at = np.flatnonzero(np.bincount(rank, minlength=size)[rank] > 1)
    inside = np.zeros(len(words) + 1, np.int64)
    np.add.at(inside, at, 1)
    np.subtract.at(inside, at + 5, 1)
    return int((np.cumsum(inside) > 0).sum())


def text_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = text.split()  # bytes are split at space and the controls 9 to 13
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (len(words), len(text.translate(None, SPACES + _CONTINUATION)),
            len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counter(batches):
    for batch in batches:
        texts = batch.column("data").to_pylist()
        found = [text_counts(text) for text in texts]
        columns = list(zip(*found)) if found else [[]] * len(COUNTS)
        yield pa.RecordBatch.from_pydict({
            "row": batch.column("row"), "digest": pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary()),
            **{n: pa.array(c, pa.int64()) for n, c in zip(COUNTS, columns)}})


def count_texts(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """row (the columns `keep`), digest and the counts of every whole text; a null text is empty."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), text_bytes(F.col(text)).alias("data"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(counter, f"row {kind}, digest binary, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def stratum(lang: Column) -> Column:
    """A stratum for every language, so that their number is fixed."""
    return F.when(lang.isin(*STRATA), lang).otherwise(F.lit("other"))


def at_most(k: int, n: int, p: float) -> float:
    """Probability of k or fewer successes in n trials: exact terms from k downwards, until they add nothing."""
    log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    total, term, i, odds = 1.0, 1.0, k, (1 - p) / p
    while i > 0:
        term *= i * odds / (n - i + 1)
        total += term
        i -= 1
        if term < 1e-18 * total and i * odds < n - i + 1:  # terms only shrink from here on
            break
    return math.exp(log + math.log(total))


def safe_cutoffs(counts: dict, alpha: float = ALPHA, delta: float = DELTA, rules: dict = RULES,
                 strata: tuple = (*STRATA, "other"), bad: dict | None = None) -> dict:
    """{(stratum, rule): cutoff}; no entry: the rule does not work there.

    `counts` holds {stratum: (n, {rule: [rejected]})}: good texts, and those rejected by any cutoff up to each step;
    `bad` the same of bad texts. Without it the last proven step is taken.
    """
    level = delta / len(strata)
    chosen = {}
    for group in strata:
        n, rejected = counts.get(group, (0, {}))
        proven = []
        for rule, i, cutoff, k in [(r, i, c, k) for r, (_, cutoffs) in rules.items()
                                   for i, (c, k) in enumerate(zip(cutoffs, rejected.get(r, ())))]:
            # k above the mean can only fail
            if k >= alpha * n or at_most(k, n, alpha) > level:
                break
            proven.append((rule, i, cutoff, k))
        if bad is not None:
            n_bad, caught = bad.get(group, (0, {}))
            gains = [0.0, *[(caught[rule][i] / n_bad if n_bad else 0.0) - k / n for rule, i, _, k in proven]]
            proven = proven[:gains.index(max(gains))]
        chosen.update({(group, rule): cutoff for rule, _, cutoff, _ in proven})
    return chosen


def steps(rules: dict = RULES) -> dict:
    """{(rule, place): SQL condition} of the texts that any cutoff up to this step rejects."""
    before, out = [], {}
    for rule, (ratio, cutoffs) in rules.items():
        for i, cutoff in enumerate(cutoffs):
            out[rule, i] = " or ".join([*before, f"{ratio} > {cutoff}D"])
        before.append(f"{ratio} > {cutoffs[-1]}D")
    return out


def fit_cutoffs(counted: DataFrame, labels: DataFrame, id_col: str, lang: str, alpha: float = ALPHA,
                delta: float = DELTA) -> dict:
    """Cutoffs from the labelled documents that pass the base rules.

    Equal texts in a stratum are one trial: copies are not independent. Labels that contradict each other
    count as bad, for a document and for a text. Two small rows per stratum come back to the driver.
    """
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(
        F.min(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("__good")).withColumnRenamed("doc_id", "__id")
    kept = counted.select(F.col(f"row.`{id_col}`").alias("__id"), stratum(F.col(f"row.`{lang}`")).alias("__stratum"),
                          "digest", *COUNTS)
    trials = kept.filter(~base_failed()).join(marks, "__id").groupBy("__stratum", "digest", *COUNTS).agg(
        F.min("__good").alias("__good"))
    facts = trials.groupBy("__stratum", "__good").agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.count_if(F.expr(rejects)).alias(f"{rule}_{i}") for (rule, i), rejects in steps().items()])
    counts: dict = {0: {}, 1: {}}
    for r in facts.collect():
        counts[r["__good"]][r["__stratum"]] = (r["__n"], {rule: [r[f"{rule}_{i}"] for i in range(len(cutoffs))]
                                                          for rule, (_, cutoffs) in RULES.items()})
    return safe_cutoffs(counts[1], alpha, delta, bad=counts[0])


def passes(cutoffs: dict, group: Column) -> Column:
    """Whether a document fails no rule of its stratum."""
    fails = F.lit(False)
    for (name, rule), cutoff in cutoffs.items():
        fails = fails | ((group == name) & (F.expr(RULES[rule][0]) > cutoff))
    return ~fails


def judge(counted: DataFrame, cutoffs: dict, lang: str = "lang") -> DataFrame:
    """Adds base_failed and kept to the counts of `count_texts`."""
    judged = counted.withColumn("base_failed", base_failed())
    return judged.withColumn("kept", ~F.col("base_failed") & passes(cutoffs, stratum(F.col(f"row.`{lang}`"))))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """The documents that pass, with all their columns.

    Null and empty texts have no words and fail. Documents without an id are judged but teach nothing;
    so do documents without a label. Repeated rows get the same verdict. Without labels only the base
    rules work. An empty table gives no rows. A null language is in the last stratum. Extra columns of
    any name travel inside `row`. Very long texts are counted with arrays.
    """
    cutoffs = fit_cutoffs(count_texts(docs, [id_col, lang], text), labels, id_col, lang)
    judged = judge(count_texts(docs, docs.columns, text), cutoffs, lang)
    return judged.filter("kept").select("row.*")


@query("op9_quality_rules")
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document."""
    docs = table(spark, sf_dir, "documents")
    counted = stable(count_texts(docs, ["doc_id", "lang"]))
    judged = judge(counted, fit_cutoffs(counted, table(spark, sf_dir, "labels"), "doc_id", "lang"))
    return judged.select(F.col("row.doc_id").alias("doc_id"), *COUNTS, "base_failed", "kept")
