"""Tables with everything that can be odd about a document."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
_WORDS = "the of and thing over under mañana Straße élan river stone light water paper green".split()


def prose(seed: int, words: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(_WORDS) + draw.choice(["", "", str(draw.randrange(50))]) for _ in range(words))


def rows() -> list[tuple]:
    shared = prose(1, 60)
    long = prose(2, 30_000)
    return [
        (1, prose(3, 80), "en", "a", 10), (2, prose(3, 80), "en", "a", 10), (3, prose(3, 80) + " end", "en", "b", 10),
        (4, None, "en", "a", None), (5, "", None, None, 0), (6, " \n\t ", "xx", "a", 3), (7, "one", "de", "a", 3),
        (8, "one two", "de", "a", 7), (9, prose(4, 20) + "\n" + shared, "fr", "b", 1), (10, shared + " ñé " + prose(5, 20), "fr", "b", 1),
        (11, long, "es", "c", 1), (12, "x" * 5000, "es", "c", 1), (13, "\x00\x1c ' 's   \n\n12é\U0001f600", "en", "c", 1),
        (14, (prose(6, 6) + "\n") * 30, "en", "c", 1), (14, prose(7, 40), "en", "c", 1), (14, prose(7, 40), "en", "c", 1),
        (None, prose(8, 40), "en", "a", 1), (None, prose(8, 40), "en", "a", 1), (None, None, None, None, None),
        (15, "THE Stone### of$$$ " * 20, "en", "a", 1)]


def odd_docs(spark):
    """The rows, with more columns whose names the operators use themselves."""
    docs = spark.createDataFrame(rows(), SCHEMA)
    for name in ("block", "row", "data", "id", "fp", "kept", "n_words", "grade", "bucket", "held_out", "component_id"):
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    return docs


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def texts() -> list[bytes]:
    return [(r[1] or "").encode() for r in rows()]
