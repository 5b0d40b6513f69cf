"""Hashes of words: equal for equal bytes only."""

import random

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import arrays as A
from corpusloom.llm.lm_score import score_texts


def mirrored(n):
    """A word of n letters and the same with both letters changed, which polynomials modulo 2^64 take for equal."""
    word = b"a"
    while len(word) < n:
        word += bytes(195 - c for c in word)
    return word[:n], bytes(195 - c for c in word[:n])


def test_words_are_told_apart():
    draw = random.Random(1)
    words = {bytes(draw.choices(b"ab\x00\xff", k=draw.choice([1, 2, 7, 8, 9, 16, 63, 64, 65, 300]))) for _ in range(3000)}
    words |= {w for n in (8, 64, 512, 1024, 2048, 1 << 18) for w in mirrored(n)}
    listed = sorted(words) * 2
    data = np.frombuffer(b"".join(listed), np.uint8)
    ends = np.cumsum([len(w) for w in listed])
    found = A.span_hashes(data, np.concatenate([[0], ends[:-1]]), ends)
    assert len(set(found.tolist())) == len(words)
    assert found[:len(words)].tolist() == found[len(words):].tolist()


def test_long_words_are_not_taken_for_each_other(spark):
    one, other = (w.decode() for w in mirrored(1024))
    docs = spark.createDataFrame([(1, one), (2, other)], "doc_id bigint, text string")
    found = {r.row.doc_id: r for r in score_texts(docs, F.col("doc_id") == 2).collect()}
    assert found[2].n_known == 1 and found[1].n_known == 2
