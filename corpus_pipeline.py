"""Corpus cleaning: quality rules, near and long duplicates, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last
return the columns of `docs`.

All stages: an empty table stays empty with its columns. Null and empty texts hold no words, so the quality
rules drop them; the later stages keep them if they get them (near copies of the empty text are one group,
of which the first stays). Rows without an id are judged by their text like others, but the near-copy stage,
which names documents by id, keeps them all; of other rows that repeat one stays. Ties go to the smallest id. Very long texts are read whole. Columns of other
names travel along, also under names that the operators use themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.base import table
from corpusloom.llm.byte_bpe import encode_texts, public_vocabulary
from corpusloom.llm.decontaminate import drop_leaks
from corpusloom.llm.quality_rules import keep_good
from corpusloom.llm.simhash_dedup import keep_first
from corpusloom.llm.suffix_dedup import remove_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return keep_first(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that repeat are cut from the texts; n_chars follows. All documents stay."""
    cut = remove_repeats(docs)
    text = F.col("kept").cast("string")
    own = {"text": text, "n_chars": F.char_length(text).cast("bigint")}
    return cut.select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of the decoded bytes, in place of the text.

    Columns of `docs` that are named like one of the new columns (case does not count) go with the text.
    """
    encoded = encode_texts(docs, *public_vocabulary())
    new = ("n_tokens", "ids", "ids_sha256", "decoded_sha256")
    rest = [c for c in docs.columns if c.lower() not in ("text", *new)]
    return encoded.select(*[F.col(f"row.`{c}`").alias(c) for c in rest], *new)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontaminate", decontaminate),
    ("byte_bpe", byte_bpe),
]

#: SQL cannot express the learned cutoffs, the index or the retrieval; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
