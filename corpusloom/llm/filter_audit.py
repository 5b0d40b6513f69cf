"""How filters interact: what each one removes, alone and after any others, in every order.

A document becomes the mask of the filters it fails. Per part only the documents of each mask are
counted, at most 32 cells, so the audit reads the texts once. A Gray-code walk then visits all 32 sets
of active filters, each one toggle away from the one before: every cell keeps how many active filters
it fails, and when that number leaves or returns to zero the cell leaves or joins the survivors. The
32 states are stored; each step of each of the 120 orders is the difference of two of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.arrays import pieces
from corpusloom.llm.base import query, table
from corpusloom.llm.blocks import text_bytes

FILTERS = ("A", "B", "C", "D", "E")
#: Least words; least distinct words and most capitals, in hundredths; marks that a text may not hold.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 50, 65, 5, b"#$%&*|"
_CAPITALS, _CONTINUATION = bytes(range(65, 91)), bytes(range(0x80, 0xC0))
#: What is counted of each set of documents: all, good ones, toxic ones.
COUNTED = ("n", "good", "toxic")


def text_mask(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words, distinct = 0, set()
    for piece in pieces(text):
        found = piece.split()  # bytes are split at space and the controls 9 to 13
        words += len(found)
        distinct.update(found)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _CONTINUATION))
    return ((words < LEAST_WORDS) | (100 * len(distinct) < LEAST_DISTINCT * words) << 1
            | (100 * capitals > MOST_CAPITALS * points) << 2 | (len(text.translate(None, MARKS)) < len(text)) << 3)


def masker(batches):
    for batch in batches:
        masks, digests = [], []
        for text in batch.column("data"):
            text = text.as_py()
            masks.append(text_mask(text))
            digests.append(hashlib.sha256(text).digest())
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "part": batch.column("part"),
                                          "mask": pa.array(masks, pa.int32()), "digest": pa.array(digests, pa.binary())})


def mask_cells(docs: DataFrame, labels: DataFrame, part: Column, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, mask, n, good, toxic): documents per part and set of failed filters; at most 32 rows a part.

    Equal rows meet before anything else, and of a text with many copies only the numbers per part and
    label go on, so a group of copies is a few rows wherever it is needed as a whole. Null texts are
    empty. A row without an id, and rows that repeat the smallest id of a text, are no later copies.
    A document is good or toxic if any row of `labels` says so; contradicting rows count as both.
    """
    facts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(part, F.lit("")).alias("part"),
                        text_bytes(F.col(text)).alias("data"))
    facts = facts.mapInArrow(masker, "doc_id long, part string, mask int, digest binary")
    rows = facts.groupBy("doc_id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("rows"))
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    rows = rows.join(marks, "doc_id", "left").fillna(False, ["good", "toxic"])
    copies = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.min("doc_id").alias("low"), F.min_by("rows", "doc_id").alias("at_low"), F.sum("rows").alias("rows"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("rows")).otherwise(0)).alias("no_id"))
    first = F.min("low").over(Window.partitionBy("digest"))  # a row per part and label
    kept = F.col("no_id") + F.when(F.col("low") == first, F.col("at_low")).otherwise(0)
    copies = copies.withColumn("kept", kept)
    split = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("kept").alias("n")),
                              F.struct((F.col("mask") + 16).alias("mask"), (F.col("rows") - F.col("kept")).alias("n"))))
    cells = copies.select("part", "good", "toxic", split.alias("cell")).select("part", "good", "toxic", "cell.*").filter("n > 0")
    return cells.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def subset_states(masks: Sequence[int], counts: np.ndarray, filters: int) -> np.ndarray:
    """Survivors of every set of active filters, by the set's bits; counts has a row per cell."""
    states = np.zeros((1 << filters, counts.shape[1]), np.int64)
    failures = [0] * len(masks)
    survivors = counts.sum(0)
    states[0] = survivors
    active = 0
    for turn in range(1, 1 << filters):
        bit = turn & -turn  # the one bit in which neighbouring Gray codes differ
        active ^= bit
        change = 1 if active & bit else -1
        for cell, mask in enumerate(masks):
            if mask & bit:
                before = failures[cell]
                failures[cell] = before + change
                if before == 0:
                    survivors = survivors - counts[cell]
                elif failures[cell] == 0:
                    survivors = survivors + counts[cell]
        states[active] = survivors
    return states


def all_orders(names: Sequence[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Orders as text, and per order and step the filter, the filters before it, and those up to it."""
    orders = list(permutations(range(len(names))))
    step = np.array(orders, np.int64).reshape(len(orders), len(names))
    upto = np.cumsum(1 << step, axis=1)
    return ["".join(names[i] for i in order) for order in orders], step, upto - (1 << step), upto


def step_rows(states: np.ndarray, names: Sequence[str]) -> dict[str, np.ndarray]:
    """Columns of the audit, for every order and step, from the stored states."""
    texts, step, before, upto = all_orders(names)
    lost = states[before] - states[upto]
    every = states.shape[0] - 1
    alone = states[0, 0] - states[1 << np.arange(len(names)), 0]
    unique = states[every ^ (1 << np.arange(len(names))), 0] - states[every, 0]
    removed = lost[..., 0]
    shapley = np.zeros(len(names), np.int64)
    np.add.at(shapley, step.ravel(), removed.ravel())
    return {"filter_order": np.repeat(np.array(texts, object), len(names)),
            "step": np.tile(np.arange(1, len(names) + 1, dtype=np.int32), len(texts)),
            "kept": states[upto, 0].ravel(), "removed": removed.ravel(), "redundant": (alone[step] - removed).ravel(),
            "unique_fails": unique[step].ravel(), "good_lost": lost[..., 1].ravel(), "toxic_lost": lost[..., 2].ravel(),
            "shapley": shapley[step].ravel()}


def audit(cells: DataFrame, names: Sequence[str] = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from `mask_cells`; bit i of a mask is the filter names[i].

    No cells give no rows. A group is the at most 2 ** len(names) cells of one part.
    """
    def walk(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        counts = np.column_stack([part.column(c).to_numpy() for c in COUNTED]).astype(np.int64)
        found = step_rows(subset_states(part.column("mask").to_pylist(), counts, len(names)), names)
        return pa.table({"part": pa.array([key[0].as_py()] * len(found["step"]), pa.string()),
                         **{c: pa.array(v) for c, v in found.items()}})

    schema = "part string, filter_order string, step int, " + ", ".join(
        f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    return cells.groupBy("part").applyInArrow(walk, schema)


@query("op12_filter_audit", r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM texts),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
          FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
masks AS (
  SELECT s.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
    CASE WHEN len(words) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN s.doc_id > min(s.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM split s LEFT JOIN marks m ON m.doc_id = s.doc_id),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY ALL),
names AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM names a JOIN names b ON b.f <> a.f JOIN names c ON c.f NOT IN (a.f, b.f)
  JOIN names d ON d.f NOT IN (a.f, b.f, c.f) JOIN names e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
steps AS (
  SELECT filter_order, CAST(s AS INTEGER) AS step, bits[s] AS bit,
         CAST(coalesce(list_sum(bits[1:s - 1]), 0) AS BIGINT) AS earlier
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s)),
found AS (
  SELECT part, filter_order, step, bit,
    CAST(sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN mask & earlier <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM found""")
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order of the five filters, per source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return audit(mask_cells(docs, table(spark, sf_dir, "labels"), F.col("source")))
