"""Texts dealt into blocks of bounded size, and questions that blocks put to hash buckets.

A block is a set of documents that one task holds in memory. To learn a fact about the whole corpus
for each of its keys (how often does this n-gram occur?) a block sends one packed row to every
bucket of keys; the bucket joins what it got and sends each block an answer in the order of its
keys. Answers meet the block's texts again in a cogroup. The texts are shuffled once: all steps
name the same exchange, which Spark reuses.

With b bytes of text, blocks * buckets packed rows are exchanged. Block sizes grow with the square
root of the input between two limits, so at 100 TB a row still stands for half a kilobyte of text.
"""

from __future__ import annotations

import math
import pickle

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import new_run_dir

#: Text bytes of a block: at least, and at most (a single longer text is a block on its own).
BLOCK_BYTES = (4 << 20, 256 << 20)
#: Bytes of text for each packed row that a block sends, and the least number of blocks.
ROW_BYTES, LEAST_BLOCKS = 512, 32


def count_blocks(docs: DataFrame, text: str = "text", block_bytes: int | None = None,
                 least: int = BLOCK_BYTES[0]) -> int:
    """Number of blocks for the texts of docs; one narrow scan."""
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    size = block_bytes or min(BLOCK_BYTES[1], max(least, int(math.sqrt(total * ROW_BYTES))))
    return max(LEAST_BLOCKS, math.ceil(total / size))


def text_bytes(column: Column) -> Column:
    """UTF-8 bytes of a text; a null text is empty."""
    return F.coalesce(column.cast("binary"), F.expr("X''"))


def in_blocks(docs: DataFrame, blocks: int, id_col: str = "doc_id", text: str = "text", **more: Column) -> DataFrame:
    """(block, id, data, row, …): row holds all columns but the text, so that no name can clash.

    Blocks are drawn from id and text, so equal ids (or none) spread as long as their texts differ.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    return docs.select(
        F.pmod(F.xxhash64(F.col(id_col), F.col(text)), F.lit(blocks)).cast("int").alias("block"),
        F.col(id_col).cast("bigint").alias("id"), text_bytes(F.col(text)).alias("data"),
        F.struct(*rest).alias("row"), *[c.alias(n) for n, c in more.items()])


def share(spark: SparkSession, thing) -> Broadcast:
    """Broadcast an object of this package with its code; its size must be bounded by parameters."""
    return spark.sparkContext.broadcast({"packed": cloudpickle.dumps(thing)})


def shared_thing(shared: Broadcast):
    """The object, which a worker unpacks once and keeps for its later tasks."""
    kept = shared.value
    if "thing" not in kept:
        kept["thing"] = pickle.loads(kept["packed"])
    return kept["thing"]


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts lineage, and leaves nothing of the plan behind.

    (checkpoint() hands on what the optimiser knows of the plan, which grows from round to round.)
    """
    path = new_run_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
