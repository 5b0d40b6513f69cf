"""Language-model scores from a weighted backoff automaton, trained on the corpus itself.

Model: n-grams with Dirichlet smoothing. With c counts in training texts, the probability of token w
after the longest history h is p(w|h) = (c(hw) + m p(w|h')) / (c(h) + m), h' being h without its
oldest token, down to p(w) = (c(w) + 1) / (N + V + 1). As an automaton: a state for each history that
training saw; an arc for each n-gram, weighted log10 p(w|h); a failure arc from h to h', weighted
log10 m / (c(h) + m), which is taken when the token has no arc; and at the root an arc for any token.

Work: blocks of texts ask hash buckets for the counts of their n-grams (`blocks.py`), so no task
holds the whole model; each then builds the part of the automaton that its own texts can reach and
runs it from left to right. What is gathered is every distinct n-gram of every block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import arrays as A
from corpusloom.llm.base import query, table
from corpusloom.llm.blocks import count_blocks, in_blocks

#: Text bytes of a block at least; larger blocks have fewer distinct n-grams to ask for.
LEAST_BYTES = 6 << 20
#: Tokens that no word can equal: the end of a text, and the history before its first word.
END, START = np.uint64(0x8F3A5C1D77E2B694), np.uint64(0x1B9D4E6F20C8A753)


def token_stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each token (lower-cased words, then one end per text), its text and its place in the text."""
    low = A.LOWER[data]
    starts, ends, first = A.words(low, offsets)
    hashes = A.span_hashes(low, starts, ends)
    texts = len(offsets) - 1
    lengths = np.diff(first) + 1
    stops = np.cumsum(lengths) - 1
    tokens = np.empty(len(hashes) + texts, np.uint64)
    is_word = np.ones(len(tokens), bool)
    is_word[stops] = False
    tokens[is_word] = hashes
    tokens[stops] = END
    doc = np.repeat(np.arange(texts), lengths)
    place = np.arange(len(tokens)) - np.repeat(stops + 1 - lengths, lengths)
    return tokens, doc, place


def ngram_keys(tokens: np.ndarray, place: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1 … order a key of the n-gram that ends at each token; 0 where the text is too short.

    The lowest bit of a key tells single tokens (1) from longer n-grams (0).
    A text begins with one START, so the bigram of its first word is (START, word).
    """
    keys = [A.mix(tokens + np.uint64(1)) | np.uint64(1)]
    for n in range(2, order + 1):
        key = np.zeros(len(tokens), np.uint64)
        whole = place >= n - 2
        at = np.flatnonzero(whole)
        opening = place[at] == n - 2
        oldest = np.where(opening, START, tokens[np.maximum(at - n + 1, 0)])
        acc = A.mix(oldest + np.uint64(n))
        for back in range(n - 2, -1, -1):
            acc = A.combine(acc, tokens[at - back])
        key[at] = acc & ~np.uint64(1)
        keys.append(key)
    return keys


class Block:
    """The distinct n-grams of a block in the order in which it asks for them."""

    def __init__(self, docs: pa.Table, order: int, buckets: int):
        data, offsets = A.buffer_of(docs.column("data"))
        self.tokens, self.doc, self.place = token_stream(data, offsets)
        self.keys = ngram_keys(self.tokens, self.place, order)
        held_out = docs.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        self.trains = ~held_out[self.doc]
        flat = np.concatenate(self.keys)
        # key 0 stands for no n-gram; it is asked for like the others and its count is 0
        order_, starts, self.which = A.groups_of(flat)
        pick = order_[starts]
        self.distinct = flat[pick]
        counted = np.tile(self.trains, order) & (flat != 0)
        self.counts = np.bincount(self.which, weights=counted, minlength=len(pick)).astype(np.int64)
        self.cuts = A.range_cuts(self.distinct, buckets)


def ask(order: int, buckets: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table) -> pa.Table:
        b = Block(docs, order, buckets)
        parts = [slice(b.cuts[i], b.cuts[i + 1]) for i in range(buckets)]
        return pa.table({
            "bucket": pa.array(range(buckets), pa.int32()),
            "block": pa.array([key[0].as_py()] * buckets, pa.int32()),
            "keys": A.binary(A.pack_sorted(b.distinct[p]) for p in parts),
            "counts": A.binary(A.pack_counts(b.counts[p]) for p in parts)})
    return run


ASKED = "bucket int, block int, keys binary, counts binary"


def answer(asked: pa.Table) -> pa.Table:
    """Corpus counts for each block's keys, and the bucket's share of N and V for every block."""
    keys = [A.unpack_sorted(k) for k in asked.column("keys").to_pylist()]
    counts = np.concatenate([A.unpack_counts(c) for c in asked.column("counts").to_pylist()])
    cuts = np.cumsum([0] + [len(k) for k in keys])
    flat = np.concatenate(keys)
    order, starts, group = A.groups_of(flat)
    totals = np.add.reduceat(counts[order], starts) if len(order) else np.zeros(0, np.int64)
    single = flat[order[starts]] & np.uint64(1) == 1
    n = len(keys)
    return pa.table({
        "block": asked.column("block").cast(pa.int32()), "bucket": asked.column("bucket").cast(pa.int32()),
        "answers": A.binary(A.pack_counts(totals[group[cuts[i]:cuts[i + 1]]]) for i in range(n)),
        "tokens": pa.array([int(totals[single].sum())] * n, pa.int64()),
        "types": pa.array([int((totals[single] > 0).sum())] * n, pa.int64())})


ANSWERED = "block int, bucket int, answers binary, tokens long, types long"


class Automaton:
    """States, arcs and failure arcs that a block's tokens can use, as arrays.

    At token i the run is in the state of the longest history that training saw; level k stands for a
    history of k tokens. `arc[k][i]` tells whether that state has an arc for the token.
    """

    def __init__(self, counts: list[np.ndarray], place: np.ndarray, train_texts: int, n: int, v: int, strength: float):
        size = len(counts)
        with np.errstate(divide="ignore", invalid="ignore"):
            log_p = np.log10((counts[0] + 1.0) / (n + v + 1.0))
            self.root, self.arc, self.weight, self.fail, self.state = log_p, [], [], [], []
            for k in range(1, size):  # histories of k tokens
                history = np.zeros(len(place), np.int64)
                history[1:] = counts[k - 1][:-1]
                opening = place == k - 1  # the history begins with START
                if k == 1:
                    history[opening] = train_texts
                elif k > 1:
                    history[opening] = np.concatenate([[0], counts[k - 1][:-1]])[opening]
                history[place < k - 1] = 0
                seen = counts[k]
                p = 10.0 ** log_p
                log_p = np.where(history > 0, np.log10((seen + strength * p) / (history + strength)), log_p)
                self.state.append(history > 0)
                self.arc.append(seen > 0)
                self.weight.append(log_p)
                self.fail.append(np.log10(strength / (history + strength)))

    def run(self) -> np.ndarray:
        """Weight that each token adds, from the longest state along failure arcs until an arc fits."""
        total = np.zeros(len(self.root))
        open_ = np.ones(len(self.root), bool)
        for state, arc, weight, fail in zip(self.state[::-1], self.arc[::-1], self.weight[::-1], self.fail[::-1]):
            here = open_ & state
            taken = here & arc
            total[taken] += weight[taken]
            failing = here & ~arc
            total[failing] += fail[failing]
            open_ &= ~taken
        total[open_] += self.root[open_]
        return total


def score(order: int, buckets: int, strength: float):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        b = Block(docs, order, buckets)
        replies: list = [b""] * buckets
        for bucket, reply in zip(answers.column("bucket").to_pylist(), answers.column("answers").to_pylist()):
            replies[bucket] = reply
        n, v = sum(answers.column("tokens").to_pylist()), sum(answers.column("types").to_pylist())
        totals = np.concatenate([A.unpack_counts(r) for r in replies if r] or [np.zeros(0, np.int64)])
        size = len(b.tokens)
        counts = [totals[b.which[k * size:(k + 1) * size]] for k in range(order)]
        ends = np.flatnonzero(b.tokens == END)
        train_texts = int(counts[0][ends[0]]) if len(ends) else 0
        weights = Automaton(counts, b.place, train_texts, n, v, strength).run()
        texts = docs.num_rows

        def per_text(x):
            return np.bincount(b.doc, weights=x, minlength=texts)
        base = np.log10((counts[0] + 1.0) / (n + v + 1.0))
        return pa.table({
            "row": A.nullable(docs.column("row")), "held_out": docs.column("held_out"),
            "n_tokens": pa.array(per_text(np.ones(size)).astype(np.int64)),
            "n_known": pa.array(per_text(counts[0] > 0).astype(np.int64)),
            "train_tokens": pa.array([n] * texts, pa.int64()),
            "base_score": pa.array(per_text(base)), "score": pa.array(per_text(weights))})
    return run


def score_texts(docs: DataFrame, held_out=None, order: int = 2, strength: float = 4.0, id_col: str = "doc_id",
                text: str = "text", block_bytes: int | None = None) -> DataFrame:
    """Score every whole text; learns from the texts for which the column `held_out` is not true.

    Returns all columns but the text within `row`, then held_out, n_tokens, n_known, train_tokens,
    base_score (add-one unigrams) and score (the automaton). Null and empty texts have one token, the
    end. Rows without an id are scored and trained on like others; repeated rows count each time.
    An empty table gives no rows. Extra columns of any name travel inside `row`. A very long text is
    a block on its own. Without training texts N and V are 0 and each token has probability 1.
    """
    held_out = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    blocks = count_blocks(docs, text, block_bytes, LEAST_BYTES)
    dealt = in_blocks(docs, blocks, id_col, text, held_out=held_out)
    row = dealt.schema["row"].dataType.simpleString()
    asked = dealt.groupBy("block").applyInArrow(ask(order, blocks), ASKED)
    answered = asked.groupBy("bucket").applyInArrow(answer, ANSWERED)
    return dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(
        score(order, blocks, strength),
        f"row {row}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


@query("op3_lm_score")
def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the model of those whose crc32(doc_id) mod 7 is not 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return score_texts(docs, held_out).select(F.col("row.doc_id").alias("doc_id"), "held_out", "n_tokens", "n_known",
                                              "train_tokens", "base_score", "score")
