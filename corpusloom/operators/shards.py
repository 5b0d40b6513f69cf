"""A table of shards in which a write counts as a whole or not at all.

A write is a batch: its rows go to a folder of their own, one sub-folder per shard, and then one log entry
lists its shards with their rows and the least and greatest value of each column. Only batches with an entry
are read, so a killed write leaves nothing that can be seen, and the next attempt replaces it; a batch that
is written again after its entry finds it and changes nothing. Readers skip shards whose values cannot lie
in the ranges they ask for; a shard that is skipped is not even listed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.utils import AnalysisException

#: Characters of texts that the log keeps; cutting both sides keeps the order, so no match is lost.
PREFIX = 32
ORDERED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType)


def bound(value: Column, kind: T.DataType) -> Column:
    return F.substring(value, 1, PREFIX) if isinstance(kind, T.StringType) else value


class ShardTable:
    """Rows of `schema`, which holds the column `shard`. A null shard is a shard like others."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, shard: str = "shard_id") -> None:
        self.spark, self.path, self.schema, self.shard = spark, path.rstrip("/"), schema, shard
        self.measured = [f for f in schema.fields if f.name != shard and isinstance(f.dataType, ORDERED)]
        facts = [T.StructField(side, T.StructType(self.measured)) for side in ("low", "high")]
        self.entry = T.StructType([T.StructField("batch", T.LongType()), schema[shard], T.StructField("folder", T.StringType()),
                                   T.StructField("n_rows", T.LongType()), *facts])

    def log(self) -> DataFrame:
        """One row per visible shard of a batch: its folder, rows, and least and greatest values."""
        try:
            return self.spark.read.schema(self.entry).option("recursiveFileLookup", True).parquet(f"{self.path}/log")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.entry)

    def write(self, rows: DataFrame, batch: int) -> bool:
        """Add a batch; False if it is there already."""
        if not self.log().filter(F.col("batch") == batch).isEmpty():
            return False
        data = f"{self.path}/data/{batch}"
        # the shard is also a folder, by the column __shard, so that its own values keep their type
        named = rows.select(*self.schema.names).withColumn("__shard", F.md5(F.to_json(F.struct(F.col(f"`{self.shard}`").alias("s")))))
        named.hint("rebalance", "__shard").write.mode("overwrite").option("maxRecordsPerFile", 2_000_000) \
            .partitionBy("__shard").parquet(data)
        kind = T.StructType([*self.schema.fields, T.StructField("__shard", T.StringType())])
        stored = self.spark.read.schema(kind).parquet(data)
        sides = [F.struct(*[bound(f(F.col(f"`{c.name}`")), c.dataType).alias(c.name) for c in self.measured]).alias(side)
                 if self.measured else F.lit(None).cast(T.StructType()).alias(side)
                 for side, f in (("low", F.min), ("high", F.max))]
        facts = stored.groupBy("__shard").agg(F.first(F.col(f"`{self.shard}`")).alias(self.shard),
                                              F.count(F.lit(1)).alias("n_rows"), *sides)
        # a row without a shard marks a batch without rows, too
        mark = self.spark.createDataFrame([(batch, None, None, 0, None, None)], self.entry)
        listed = facts.select(F.lit(batch).cast("bigint").alias("batch"), self.shard,
                              F.concat(F.lit(f"{data}/__shard="), "__shard").alias("folder"), "n_rows", "low", "high")
        # one file, so that the entry appears at once
        listed.unionByName(mark).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/{batch}")
        return True

    def selected(self, ranges: Mapping[str, tuple] = {}) -> DataFrame:
        """Entries of the shards that may hold rows in all ranges (column: (least, greatest), None is open)."""
        kinds, tests = {f.name: f.dataType for f in self.measured}, [F.col("folder").isNotNull()]
        for name, (least, greatest) in ranges.items():
            if name == self.shard:
                tests += self._inside(F.col(f"`{name}`"), least, greatest)
            elif name in kinds:
                kind = kinds[name]
                low, high = F.col("low").getField(name), F.col("high").getField(name)
                tests.append(low.isNotNull())
                tests += [high >= bound(F.lit(least), kind)] if least is not None else []
                tests += [low <= bound(F.lit(greatest), kind)] if greatest is not None else []
        return self.log().filter(reduce(Column.__and__, tests))

    def _inside(self, value: Column, least, greatest) -> list[Column]:
        tests = [value.isNotNull()]
        tests += [value >= F.lit(least)] if least is not None else []
        return tests + ([value <= F.lit(greatest)] if greatest is not None else [])

    def read(self, columns: Sequence[str], ranges: Mapping[str, tuple] = {}) -> DataFrame:
        """The named columns of the visible rows in all ranges. A null is in no range."""
        folders = sorted(r.folder for r in self.selected(ranges).select("folder").collect())  # paths to read, as in any listing
        if not folders:
            return self.spark.createDataFrame([], self.schema).select(*columns)
        rows = self.spark.read.schema(self.schema).parquet(*folders)
        for name, (least, greatest) in ranges.items():
            rows = rows.filter(reduce(Column.__and__, self._inside(F.col(f"`{name}`"), least, greatest)))
        return rows.select(*columns)

    def manifest(self) -> DataFrame:
        """Rows and batches per shard, from the log alone."""
        return self.log().filter("folder IS NOT NULL").groupBy(self.shard).agg(
            F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_batches"))

    def broken(self) -> DataFrame:
        """Folders whose rows are not as many as the log says (`logged`, `actual`); none in a sound table."""
        folders = [r.folder for r in self.selected().select("folder").collect()]
        logged = self.selected().select("folder", F.col("n_rows").alias("logged"))
        if not folders:
            return logged.withColumn("actual", F.lit(0).cast("bigint")).limit(0)
        found = self.spark.read.schema(self.schema).option("ignoreMissingFiles", True).parquet(*folders)
        folder = F.regexp_extract(F.col("_metadata.file_path"), r"/(data/[^/]+/__shard=[^/]+)/[^/]+$", 1)
        actual = found.groupBy(folder.alias("__key")).agg(F.count(F.lit(1)).alias("actual"))
        logged = logged.withColumn("__key", F.regexp_extract("folder", r"/(data/[^/]+/__shard=[^/]+)$", 1))
        both = logged.join(actual, "__key", "left").drop("__key").withColumn("actual", F.coalesce("actual", F.lit(0)))
        return both.filter("logged <> actual")
