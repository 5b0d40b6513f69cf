"""The filter audit against applying the filters one after the other."""

import random
import re
from collections import defaultdict
from itertools import permutations

import numpy as np
from odd import no_docs, odd_docs, rows
from pyspark.sql import functions as F

from corpusloom.llm import filter_audit as A


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {name for name, bad in [("A", len(words) < 50), ("B", 100 * len(set(words)) < 65 * len(words)),
                                   ("C", 100 * len(re.findall("[A-Z]", text)) > 5 * len(text)), ("D", bool(re.search("[#$%&*|]", text)))] if bad}


def brute(docs, labels):
    """{(part, order, step): columns} for docs (id, text, source) and labels (id, quality, toxic)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = defaultdict(list)
    for i, text, source in docs:
        copy = any(j is not None and i is not None and j < i and (t or "") == (text or "") for j, t, _ in docs)
        parts[source or ""].append((i, fails(text or "") | ({"E"} if copy else set())))
    out = {}
    for part, held in parts.items():
        shapley = defaultdict(int)
        for order in permutations("ABCDE"):
            left = held
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                before = len(left)
                left = [d for d in left if f not in d[1]]
                failing = sum(f in d[1] for d in held)
                out[part, "".join(order), step] = [len(left), before - len(left), failing - len(gone), sum(d[1] == {f} for d in held),
                                                  sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)]
                shapley[f] += len(gone)
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def found(df):
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in df.collect()}


def test_odd_documents(spark):
    docs = odd_docs(spark).withColumns({c: F.lit("own") for c in ("part", "mask", "digest", "n", "good", "toxic", "rows")})
    marks = [(1, 1, 0), (2, 1, 1), (4, 0, 1), (9, 1, 0), (9, 0, 1), (14, 1, 0), (14, 1, 0), (None, 1, 1), (15, None, None), (99, 1, 1)]
    labels = spark.createDataFrame([(*m, "own") for m in marks], "doc_id bigint, quality int, toxic int, part string")
    expected = brute([(r[0], r[1], r[3]) for r in rows()], marks)
    assert found(A.audit(A.mask_cells(docs, labels, F.col("source")))) == expected
    assert found(A.audit(A.mask_cells(docs, labels.limit(0), F.col("source")))) == brute([(r[0], r[1], r[3]) for r in rows()], [])
    assert A.audit(A.mask_cells(no_docs(spark), labels, F.col("source"))).count() == 0


def test_groups_of_copies(spark):
    draw = random.Random(2)
    kinds = ["word " * 60, "short", " ".join(f"w{i}" for i in range(80)), " ".join(f"W{i}" for i in range(80)), "", None, "a # b"]
    docs = [(draw.choice([i, i, None, i // 3]), draw.choice(kinds + kinds[:1] * 5), draw.choice(["x", "y", None, ""])) for i in range(200)]
    marks = [(i, draw.randrange(2), draw.randrange(2)) for i in range(0, 200, 2)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string").repartition(6)
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    assert found(A.audit(A.mask_cells(df, labels, F.col("source")))) == brute(docs, marks)


def test_states_of_any_number_of_filters():
    draw = random.Random(1)
    for filters in range(6):
        masks = [draw.randrange(1 << filters) for _ in range(9)]
        counts = np.array([[draw.randrange(9), draw.randrange(9)] for _ in masks])
        states = A.subset_states(masks, counts, filters)
        for active in range(1 << filters):
            assert states[active].tolist() == sum((c for m, c in zip(masks, counts) if not m & active), np.zeros(2, int)).tolist()


def test_masks_of_long_texts():
    text = ("Alpha beta\n" * 200_000 + "x" * (2 << 20)).encode()
    assert A.text_mask(text) == sum({"A": 1, "B": 2, "C": 4, "D": 8}[f] for f in fails(text.decode()))
