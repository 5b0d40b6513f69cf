"""Ranked search against a brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
from odd import no_docs, odd_docs, rows
from pyspark.sql import functions as F

from corpusloom.llm import ranked_search as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(queries, docs, top=10):
    """(query id, rank, doc id, score), sorted; queries and docs are (id, text)."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in held]
    n_docs, total = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in queries:
        scores = []
        for (doc, c), n in zip(held, sizes):
            if n:
                m = 10 + 90 * n * n_docs // total
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in set(terms(text)) & c.keys())
                if s > 0:
                    scores.append((-s, doc is None, doc or 0))
        out += [(item, rank, None if none else doc, -s) for rank, (s, none, doc) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_terms():
    for text in ["", "Don't stop—NOW! é\x00ß\x7fx_y`z{0}", "ÄÖ äö İ A1b2", "a" * 9 + " " * 9 + "b"]:
        assert R.term_counts(text.encode()) == Counter(t.encode() for t in terms(text))
    long = "Ab c! " * 300_000
    assert R.term_counts(long.encode()) == Counter({b"ab": 300_000, b"c": 300_000})


def test_odd_documents(spark):
    queries = [(1, "the river Stone under"), (2, None), (3, ""), (4, "nothing42 matches42"), (None, "THE of and thing over under mañana"),
               (5, "Straße élan x the the"), (5, "paper GREEN light"), (5, "paper GREEN light"), (6, "x" * 5000), (7, "end one two")]
    asked = spark.createDataFrame([(*q, "own") for q in queries], "item_id bigint, text string, doc_id string")
    docs = odd_docs(spark).withColumns({"rank": F.lit("own"), "score": F.lit("own"), "query": F.lit("own"), "n_terms": F.lit("own")})
    expected = brute(queries, [(r[0], r[1]) for r in rows()])
    assert found(R.search(asked, docs)) == expected
    # tiny blocks, several portions of queries
    assert found(R.search(asked, docs, limit=20, query_bytes=2500)) == expected
    assert R.search(asked, no_docs(spark)).count() == 0 and R.search(asked.limit(0), docs).count() == 0


def test_many_ties_and_common_terms(spark):
    draw = random.Random(5)
    vocabulary = [f"t{int(40 * draw.random() ** 3)}" for _ in range(400)]
    texts = [(i, " ".join(draw.choice(vocabulary) for _ in range(draw.choice([1, 2, 2, 5, 9, 30])))) for i in range(600)]
    queries = [(i, " ".join(draw.sample(vocabulary, 12))) for i in range(30)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(5)
    asked = spark.createDataFrame(queries, "item_id bigint, text string")
    expected = brute(queries, texts)
    for limit in (200, 10**6):
        assert found(R.search(asked, df, limit=limit)) == expected
    assert found(R.search(asked, df, top=3)) == brute(queries, texts, 3)


def block_of(texts, queries, **changes):
    asked = R.Queries([q.encode() for q in queries])
    held = [R.term_counts(t.encode()) for t in texts]
    df = np.zeros(len(asked.number), np.int64)
    for c in held:
        for t in c.keys() & asked.number.keys():
            df[asked.number[t]] += 1
    sizes = np.array([sum(c.values()) for c in held])
    plan = R.Plan(asked, df, int((sizes > 0).sum()), int(sizes.sum()))
    for name, value in changes.items():
        setattr(plan, name, value)
    lists = [sorted((asked.number[t], n) for t, n in c.items() if t in asked.number) for c in held]
    terms_ = np.array([t for x in lists for t, _ in x], np.int64)
    times = np.array([n for x in lists for _, n in x], np.int64)
    return plan, R.Block(plan, list(range(len(texts))), sizes, terms_, times, np.array([len(x) for x in lists]))


def test_pairs_bound_more_tightly():
    # two common terms that never meet: both together add no more than one of them
    draw = random.Random(9)
    texts = [" ".join(["rare"] * (i < 12) + [("left" if i % 2 else "right")] * draw.randrange(1, 4) + ["fill"] * 5) for i in range(400)]
    texts += ["fill " * 6] * 300
    queries = ["rare left right", "left right rare fill"]
    plan, block = block_of(texts, queries)
    asked = R.Queries([q.encode() for q in queries])
    pair = tuple(sorted(asked.number[t] for t in (b"left", b"right")))
    assert pair in plan.pairs and block.joint[pair][2] == 0
    assert block.bound(pair) == max(block.bound((t,)) for t in pair)
    _, alone = block_of(texts, queries, matched=[[], []], pairs=[])
    for q in range(2):
        docs, scores, read = block.best(q, 0, 10)
        plain_docs, plain_scores, plain_read = alone.best(q, 0, 10)
        every = np.zeros(len(texts), np.int64)
        for t in plan.queries[q]:
            own, gains = block.list_of(int(t))
            every[own] += gains
        tenth = np.sort(every)[-10]
        assert set(np.flatnonzero(every >= tenth)) <= set(docs) & set(plain_docs)
        assert all(every[d] == s for d, s in zip(docs, scores)) and all(every[d] == s for d, s in zip(plain_docs, plain_scores))
        assert read <= plain_read


def test_blocks_against_full_scores():
    draw = random.Random(11)
    vocabulary = [f"t{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    reads = []
    for seed in range(12):
        texts = [" ".join(draw.choices(vocabulary, weights, k=draw.choice([1, 3, 10, 40]))) for _ in range(500)]
        queries = [" ".join(draw.choices(vocabulary, k=14)) for _ in range(12)]
        plan, block = block_of(texts, queries)
        _, alone = block_of(texts, queries, matched=[[]] * len(queries), pairs=[])
        for q in range(len(queries)):
            every = np.zeros(len(texts), np.int64)
            for t in plan.queries[q]:
                own, gains = block.list_of(int(t))
                every[own] += gains
            tenth = np.sort(every)[-10]
            for least in (0, int(tenth), int(tenth) + 1):
                docs, scores, read = block.best(q, least, 10)
                assert all(every[d] == s for d, s in zip(docs, scores))
                assert {d for d in np.flatnonzero(every >= max(tenth, least)) if every[d] > 0} <= set(docs)
                reads.append((read, alone.best(q, least, 10)[2], sum(len(block.list_of(int(t))[0]) for t in plan.queries[q])))
    pairs, single, full = map(sum, zip(*reads))
    assert pairs < single < full
