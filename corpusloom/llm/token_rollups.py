"""Token totals by source, language and tokenizer version, kept by adding signed batches.

A batch holds changes: inserts and deletes of documents, and revised counts. It is reduced to one
signed row per key before it is stored, so totals are sums of small rows and never need the texts
again. A batch is stored under its name and counts from the moment its name is in the commit log;
a name that is there is not stored again. So a batch may be repeated after any failure: files that a
lost attempt left behind are replaced, and a second commit changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.base import query, table
from corpusloom.session import new_run_dir, stable

KEYS = ("source", "lang", "version")
#: Words, and words with marks apart: patterns of two tokenizer versions.
VERSIONS = {"words-1": r"[^\x20\x09-\x0D]+", "words-2": r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]"}


def inserts(docs: DataFrame, tokens: str) -> DataFrame:
    """Changes that add documents with keys KEYS and the count in the column `tokens`."""
    return docs.select(*KEYS, F.lit(1).cast("bigint").alias("n_docs"), _number(tokens).alias("n_tokens"))


def deletes(docs: DataFrame, tokens: str) -> DataFrame:
    """Changes that take documents away; `tokens` is the count they had."""
    return docs.select(*KEYS, F.lit(-1).cast("bigint").alias("n_docs"), (-_number(tokens)).alias("n_tokens"))


def revisions(docs: DataFrame, old: str, new: str) -> DataFrame:
    """Changes of counts; the documents stay."""
    return docs.select(*KEYS, F.lit(0).cast("bigint").alias("n_docs"), (_number(new) - _number(old)).alias("n_tokens"))


def _number(column: str):
    return F.coalesce(F.col(column).cast("bigint"), F.lit(0).cast("bigint"))


class Rollups:
    """Totals in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        # the log begins with an empty name, so that it can always be read
        self._names([""]).write.mode("ignore").parquet(f"{self.folder}/log/batch=0")

    def _names(self, names: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in names], "name string").coalesce(1)

    def committed(self) -> DataFrame:
        return self.spark.read.schema("name string").parquet(f"{self.folder}/log/*").filter("name <> ''").distinct()

    def commit(self, name: str, changes: DataFrame) -> bool:
        """Add a batch; False if a batch of this name already counts."""
        if not name or not all(c.isalnum() or c in "-_." for c in name):
            raise ValueError("A batch name has letters, digits, '-', '_' and '.' only.")
        if self.committed().filter(F.col("name") == name).limit(1).count():
            return False
        delta = changes.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        delta.withColumn("name", F.lit(name)).write.mode("overwrite").parquet(f"{self.folder}/deltas/{name}")
        self._names([name]).write.mode("overwrite").parquet(f"{self.folder}/log/{name}")
        return True

    def totals(self) -> DataFrame:
        """Sums over the committed batches; keys whose documents are all gone are left out."""
        schema = "source string, lang string, version string, n_docs long, n_tokens long, name string"
        if not self.committed().limit(1).count():
            return self.spark.createDataFrame([], schema).drop("name")
        stored = self.spark.read.schema(schema).parquet(f"{self.folder}/deltas/*")
        counted = stored.join(self.committed(), "name", "left_semi")
        summed = counted.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return summed.filter((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))


def token_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per document its keys' columns, a provisional count (4 characters each) and one count per version."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select("doc_id", "source", "lang", F.ceil(F.char_length(body) / 4).alias("provisional"),
                       *[F.regexp_count(body, F.lit(p)).cast("bigint").alias(v) for v, p in VERSIONS.items()])


@query("op10_token_rollups", r"""
WITH kept AS (
  SELECT source, lang, coalesce(text, '') AS text FROM documents
  WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0 AND doc_id IS NOT NULL)),
counted AS (
  SELECT source, lang, 'words-1' AS version, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n FROM kept
  UNION ALL
  SELECT source, lang, 'words-2', len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]')) FROM kept)
SELECT source, lang, version, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens
FROM counted GROUP BY ALL""")
def op10_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents inserted with provisional counts, revised, counted again by a second tokenizer, and
    the bad ones deleted; two batches are sent twice.

    Null texts have no tokens; null sources and languages are keys of their own. A document without an
    id is counted and never deleted. Repeated rows are documents of their own; repeated labels delete
    once. Empty tables give no totals. Other columns are not read. Very long texts are counted in place.
    """
    counts = stable(token_counts(table(spark, sf_dir, "documents")))
    bad = table(spark, sf_dir, "labels").filter("quality = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    first, second = (counts.withColumn("version", F.lit(v)) for v in VERSIONS)
    gone = counts.join(bad, "doc_id", "left_semi")
    removed = deletes(gone.withColumn("version", F.lit("words-1")), "words-1").unionByName(
        deletes(gone.withColumn("version", F.lit("words-2")), "words-2"))
    rollups = Rollups(spark, new_run_dir(spark, "token-rollups"))
    batches = [("load", inserts(first, "provisional")), ("revise", revisions(first, "provisional", "words-1")),
               ("second-version", inserts(second, "words-2")), ("delete", removed)]
    for name, changes in [*batches, batches[1], batches[3]]:
        rollups.commit(name, changes)
    return rollups.totals()
