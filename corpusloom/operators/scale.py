"""Building blocks that stay exact when one key holds a large share of all rows.

A plain window puts every row of a group into one task. The helpers here check the largest
group first and use the plain window only below a limit; above it they split the group by
hash bucket or by sort range, so no task ever holds a whole hot group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusloom.functions.clock import epoch_micros
from corpusloom.functions.hashing import as_col, hash_unit
from corpusloom.session import stable

HOT_ROWS = 1_000_000
SMALL_SIDE_ROWS = 100_000
# above this, counting passes beat the value map of `percentile`
PERCENTILE_ROWS = 200_000


def hot_rows(spark: SparkSession) -> int:
    """Most rows one task may get for one group (`corpusloom.hotRows`)."""
    return int(spark.conf.get("corpusloom.hotRows", str(HOT_ROWS)))


def small_side_rows(spark: SparkSession) -> int:
    """Most rows a broadcast lookup may have (`corpusloom.smallSideRows`)."""
    return int(spark.conf.get("corpusloom.smallSideRows", str(SMALL_SIDE_ROWS)))


def collect_small(df: DataFrame, max_rows: int | None = None) -> list[Row] | None:
    """The rows on the driver if there are at most `max_rows`, else None. `take` reads partitions
    step by step, so a large table stops early and never sends more than `max_rows + 1` rows."""
    limit = small_side_rows(df.sparkSession) if max_rows is None else max_rows
    rows = df.take(limit + 1)
    return rows if len(rows) <= limit else None


def rows_to_local(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType) -> DataFrame:
    """A few driver rows as a local table, which joins need no job to read."""
    plain = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampNTZType)
    if not all(isinstance(f.dataType, plain) for f in schema.fields):
        return spark.createDataFrame(rows, schema)
    columns = list(zip(*rows)) if rows else [[] for _ in schema.fields]
    arrow = to_arrow_schema(schema)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow), schema)


def small_side(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Broadcast `df` if it has at most `max_rows` rows; otherwise leave the join to AQE. The rows
    read for the check are kept as a local table, so a small side is computed once."""
    rows = collect_small(df, max_rows)
    return df if rows is None else F.broadcast(rows_to_local(df.sparkSession, rows, df.schema))


def compute_once(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Keep a result that is used several times: as a local table if it is small, otherwise as a
    reliable checkpoint."""
    rows = collect_small(df, max_rows)
    return stable(df) if rows is None else rows_to_local(df.sparkSession, rows, df.schema)


def top_rows(df: DataFrame, order: Sequence, n: int) -> DataFrame:
    """First `n` rows in a total `order`. On a large table the best rows of all tasks are first
    reduced in 256 parts, so that no single task gets `n` rows from every task."""
    if df.count() > hot_rows(df.sparkSession):
        parts = df.withColumn("__salt", F.spark_partition_id() % 256)
        place = F.row_number().over(W.partitionBy("__salt").orderBy(*order))
        df = parts.withColumn("__rn", place).filter(F.col("__rn") <= n).drop("__salt", "__rn")
    return df.orderBy(*order).limit(n)


def lookup_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left",
                checked: bool = False) -> DataFrame:
    """Null-safe equality join with a lookup table that is broadcast only after a size check."""
    side = small if checked else small_side(small)
    renamed = side.withColumnsRenamed({name: f"__r_{name}" for name in on})
    condition = None
    for name in on:
        test = F.col(name).eqNullSafe(F.col(f"__r_{name}"))
        condition = test if condition is None else condition & test
    return big.join(renamed, condition, how).drop(*[f"__r_{name}" for name in on])


def largest_group(df: DataFrame, groups: Sequence[str]) -> int:
    if not groups:
        return df.count()
    row = df.groupBy(*groups).count().agg(F.max("count")).first()
    return int(row[0] or 0)


def _over(groups: Sequence[str], order: Sequence) -> W:
    spec = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))
    return spec.orderBy(*order)


def _combine(how: str, left: Column, right: Column) -> Column:
    if how == "sum":
        return F.coalesce(left, F.lit(0)) + F.coalesce(right, F.lit(0))
    return F.least(left, right) if how == "min" else F.greatest(left, right)


def running(df: DataFrame, groups: Sequence[str], order: Sequence, value, name: str,
            how: str = "sum", inclusive: bool = True, hot: int | None = None,
            largest: int | None = None) -> DataFrame:
    """Add the running sum, min or max of `value` in `order` inside each group.

    `order` must be total inside a group. Above the limit the rows are range-partitioned on
    (group, order), each range keeps a local running value, and the totals of earlier ranges
    (one row per range and group) are added. `largest` is the size of the largest group, if known.
    """
    value = as_col(value)
    fold = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    end = 0 if inclusive else -1
    limit = hot_rows(df.sparkSession) if hot is None else hot
    largest = largest_group(df, groups) if largest is None else largest
    if largest <= limit:
        spec = _over(groups, order).rowsBetween(W.unboundedPreceding, end)
        result = fold(value).over(spec)
        return df.withColumn(name, F.coalesce(result, F.lit(0)) if how == "sum" else result)
    keys = [*groups, *order]
    parts = stable(df.repartitionByRange(*keys).sortWithinPartitions(*keys))
    parts = parts.withColumn("__part", F.spark_partition_id())
    inside = ["__part", *groups]
    totals = parts.groupBy(*inside).agg(fold(value).alias("__total"))
    before = fold("__total").over(_over(groups, ["__part"]).rowsBetween(W.unboundedPreceding, -1))
    offsets = totals.withColumn("__before", before).drop("__total")
    local = fold(value).over(_over(inside, order).rowsBetween(W.unboundedPreceding, end))
    joined = lookup_join(parts.withColumn("__local", local), offsets, inside)
    return joined.withColumn(name, _combine(how, F.col("__local"), F.col("__before"))).drop(
        "__part", "__local", "__before")


def positions(df: DataFrame, groups: Sequence[str], order: Sequence, name: str,
              hot: int | None = None, largest: int | None = None) -> DataFrame:
    """1-based position of each row in a total `order`, per group or over the whole table.

    Above the limit the rows are range-partitioned and sorted once; a row's place inside its range
    comes from its row id, and the first place and size of each (range, group) run, a small table,
    turn it into a position. The rows are not shuffled again.
    """
    limit = hot_rows(df.sparkSession) if hot is None else hot
    largest = largest_group(df, groups) if largest is None else largest
    if largest <= limit:
        return df.withColumn(name, F.row_number().over(_over(groups, order)).cast("bigint"))
    keys = [*groups, *order]
    parts = stable(df.repartitionByRange(*keys).sortWithinPartitions(*keys))
    # a row id holds the partition above bit 33 and the place in the partition below
    parts = parts.withColumn("__id", F.monotonically_increasing_id())
    parts = parts.withColumns({"__part": F.shiftright("__id", 33), "__place": F.col("__id").bitwiseAND(2**33 - 1)}).drop("__id")
    inside = ["__part", *groups]
    runs = parts.groupBy(*inside).agg(F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(_over(groups, ["__part"]).rowsBetween(W.unboundedPreceding, -1))
    runs = runs.withColumn("__shift", F.coalesce(before, F.lit(0)) - F.col("__first") + 1).drop("__first", "__n")
    placed = lookup_join(parts, runs, inside)
    return placed.withColumn(name, (F.col("__place") + F.col("__shift")).cast("bigint")).drop("__part", "__place", "__shift")


def hash_positions(df: DataFrame, groups: Sequence[str], digest: str, name: str,
                   hot: int | None = None) -> DataFrame:
    """1-based position by a hex digest column. Hot groups are cut into digest buckets: the
    digest is uniform, so buckets are even, and their order is the digest order."""
    limit = hot_rows(df.sparkSession) if hot is None else hot
    largest = largest_group(df, groups)
    if largest <= limit:
        return df.withColumn(name, F.row_number().over(_over(groups, [digest])).cast("bigint"))
    buckets = -(-largest // limit) * 2
    work = df.withColumn("__bucket", F.floor(hash_unit(F.col(digest)) * buckets).cast("int"))
    inside = [*groups, "__bucket"]
    sizes = work.groupBy(*inside).agg(F.count(F.lit(1)).alias("__n"))
    spec = _over(groups, ["__bucket"]).rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(spec), F.lit(0))).drop("__n")
    ranked = work.withColumn("__rn", F.row_number().over(_over(inside, [digest])))
    return (lookup_join(ranked, sizes, inside)
            .withColumn(name, (F.col("__rn") + F.col("__before")).cast("bigint"))
            .drop("__bucket", "__rn", "__before"))


def hash_cutoffs(df: DataFrame, groups: Sequence[str], digest: str, bounds: DataFrame,
                 bound_names: Sequence[str], hot: int | None = None,
                 largest: int | None = None) -> DataFrame:
    """Digest of the last row inside each bound, per group.

    `bounds` has the group columns and one rank per bound name; broadcast it if it is small. Only (group, digest) is read,
    and above the limit only the rows of the bucket that contains a bound are ranked; all other
    rows are merely counted. A row then lies inside a bound iff its digest is not larger.
    """
    limit = hot_rows(df.sparkSession) if hot is None else hot
    slim = df.select(*groups, digest)
    largest = largest_group(slim, groups) if largest is None else largest
    if largest <= limit:
        ranked = slim.withColumn("__rank", F.row_number().over(_over(groups, [digest])))
        picked = lookup_join(ranked, bounds, groups, checked=True)
    else:
        buckets = -(-largest // limit) * 2
        slim = slim.withColumn("__bucket", F.floor(hash_unit(F.col(digest)) * buckets).cast("int"))
        inside = [*groups, "__bucket"]
        sizes = slim.groupBy(*inside).agg(F.count(F.lit(1)).alias("__n"))
        spec = _over(groups, ["__bucket"]).rowsBetween(W.unboundedPreceding, -1)
        sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(spec), F.lit(0)))
        sizes = lookup_join(sizes, bounds, groups, checked=True)
        hit = None
        for bound in bound_names:
            test = (F.col(bound) > F.col("__before")) & (F.col(bound) <= F.col("__before") + F.col("__n"))
            hit = test if hit is None else hit | test
        edge = lookup_join(slim, sizes.filter(hit).drop("__n"), inside, how="inner")
        rank = F.row_number().over(_over(inside, [digest])) + F.col("__before")
        picked = edge.withColumn("__rank", rank)
    marks = [F.max(F.when(F.col("__rank") == F.col(b), F.col(digest))).alias(f"__cut_{b}") for b in bound_names]
    return picked.groupBy(*groups).agg(*marks) if groups else picked.agg(*marks)


#: Buckets of a group in which rows are counted to find ranks, and rows that a bucket should hold at least.
RANK_BUCKETS, BUCKET_ROWS = 4096, 1000


def rows_at_ranks(df: DataFrame, groups: Sequence[str], digest: str, wanted: DataFrame, rank: str) -> DataFrame:
    """The rows whose 1-based rank by a hex digest is wanted, with the rank; `wanted` has the groups and `rank`,
    and may be broadcast if it is small.

    Rows are counted per group and digest bucket, so only buckets that hold a wanted rank are moved: at most
    one in RANK_BUCKETS of a large group for each rank.
    """
    sizes = compute_once(df.groupBy(*groups).agg(F.count(F.lit(1)).alias("__size")))
    dealt = F.least(F.lit(RANK_BUCKETS), F.greatest(F.lit(1), F.ceil(F.col("__size") / BUCKET_ROWS))).cast("int")
    work = lookup_join(df, sizes, groups).withColumn("__bucket", F.floor(hash_unit(F.col(digest)) * dealt).cast("int")).drop("__size")
    inside = [*groups, "__bucket"]
    counts = work.groupBy(*inside).agg(F.count(F.lit(1)).alias("__n"))
    counts = running(counts, groups, ["__bucket"], "__n", "__before", inclusive=False, hot=RANK_BUCKETS, largest=RANK_BUCKETS)
    hits = lookup_join(counts, wanted, groups, how="inner").filter(
        (F.col(rank) > F.col("__before")) & (F.col(rank) <= F.col("__before") + F.col("__n")))
    hits = compute_once(hits.select(*inside, "__before").distinct())
    moved = lookup_join(work, hits, inside, how="inner")
    place = F.row_number().over(_over(inside, [digest])) + F.col("__before")
    return moved.withColumn(rank, place.cast("bigint")).drop("__bucket", "__before")


def near_first(df: DataFrame, groups: Sequence[str], column: str, n: int, descending: bool = False) -> DataFrame:
    """Rows that may be among the first `n` of their group by a column of numbers or times: all of them, all that
    tie with the last, and few others. Nulls come first, NaN last; descending turns both round.

    Two passes count the rows of each group in RANK_BUCKETS steps between its least and its greatest value, and
    again within the step that holds the `n`-th; then a comparison in place decides. No row is moved. Columns of
    other types are returned uncut.
    """
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        key = epoch_micros(column, kind).cast("double")
    elif isinstance(kind, T.DateType):
        key = F.unix_date(column).cast("double")
    elif isinstance(kind, T.NumericType):
        key = F.col(column).cast("double")
    else:
        return df
    low, high = F.lit(float("-inf")), F.lit(float("inf"))
    key = F.when(key.isNull(), low).when(F.isnan(key), high).otherwise(key)
    work = df.withColumn("__key", -key if descending else key)
    slim = work.select(*groups, "__key")
    finite = F.when(F.abs("__key") < high, F.col("__key"))
    state = slim.groupBy(*groups).agg(F.count(F.lit(1)).alias("__n"), F.min(finite).alias("__lo"), F.max(finite).alias("__hi"))
    # rows still wanted; a group that has no more than `n` rows is not cut
    state = state.filter(F.col("__n") > n).select(*groups, "__lo", "__hi", F.lit(n).cast("bigint").alias("__left"), low.alias("__from"), high.alias("__to"))
    for _ in range(2):
        state = compute_once(state)
        step = (F.col("__key") - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0)) * RANK_BUCKETS
        bucket = F.when(F.col("__key") == low, -1).when(F.col("__key") == high, RANK_BUCKETS + 1).otherwise(F.coalesce(F.floor(step), F.lit(0)))
        rows = lookup_join(slim, state, groups, how="inner").filter(F.col("__key").between(F.col("__from"), F.col("__to")))
        counts = rows.groupBy(*groups, bucket.alias("__bucket")).agg(
            F.count(F.lit(1)).alias("__n"), F.min("__key").alias("__least"), F.max("__key").alias("__most"), F.first("__left").alias("__left"))
        counts = running(counts, groups, ["__bucket"], "__n", "__before", inclusive=False, hot=RANK_BUCKETS + 3, largest=RANK_BUCKETS + 3)
        hit = counts.filter((F.col("__before") < F.col("__left")) & (F.col("__before") + F.col("__n") >= F.col("__left")))
        state = hit.select(*groups, F.col("__least").alias("__lo"), F.col("__most").alias("__hi"),
                           (F.col("__left") - F.col("__before")).alias("__left"), F.col("__least").alias("__from"), F.col("__most").alias("__to"))
    kept = lookup_join(work, state.select(*groups, F.col("__hi").alias("__last")), groups)
    return kept.filter(F.col("__last").isNull() | (F.col("__key") <= F.col("__last"))).drop("__key", "__last")


def ordered_windows(df: DataFrame, groups: Sequence[str], order: Sequence, back: int,
                    build: Callable[[W], dict[str, Column]], hot: int | None = None) -> DataFrame:
    """Add window columns that look at most `back` rows behind the current row.

    Groups above the limit are cut into runs of consecutive rows; each run also gets the last
    `back` rows of the run before it, so every frame is complete and no task holds the group.
    """
    limit = hot_rows(df.sparkSession) if hot is None else hot
    spec = _over(groups, order)
    if largest_group(df, groups) <= limit:
        return df.withColumns(build(spec))
    run = max(limit, back + 1)
    if groups:
        heavy = df.groupBy(*groups).count().filter(F.col("count") > limit).select(*groups)
        heavy = small_side(heavy)
        plain = lookup_join(df, heavy, groups, how="left_anti", checked=True).withColumns(build(spec))
        rows = lookup_join(df, heavy, groups, how="left_semi", checked=True)
    else:
        plain, rows = None, df
    # the total order spreads a hot group over many ranges
    rows = positions(rows, groups, order, "__pos", hot=limit)
    home = F.floor((F.col("__pos") - 1) / run)
    tail = (F.col("__pos") - 1) % run >= run - back
    chunks = F.when(tail, F.array(home, home + 1)).otherwise(F.array(home))
    rows = rows.withColumn("__run", F.explode(chunks))
    rows = rows.withColumns(build(W.partitionBy(*groups, "__run").orderBy("__pos")))
    rows = rows.filter(F.col("__run") == home).drop("__pos", "__run")
    return rows if plain is None else plain.unionByName(rows)


def exact_quantiles(df: DataFrame, groups: Sequence[str], columns: Sequence[str],
                    probs: Sequence[float], hot: int | None = None, largest: int | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles: one row per group, one array per column.

    Up to the limit Spark's `percentile` is used, which holds a group's distinct values in one
    task. Above it the values are counted, range-partitioned and given running counts, and only
    the two values next to each wanted position are kept.
    """
    limit = hot_rows(df.sparkSession) if hot is None else hot
    slim = df.select(*groups, *columns)
    largest = largest_group(slim, groups) if largest is None else largest
    if largest <= limit:
        aggs = [F.percentile(F.col(c), F.array(*[F.lit(float(p)) for p in probs])).alias(c) for c in columns]
        return slim.groupBy(*groups).agg(*aggs) if groups else slim.agg(*aggs)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
                                for c in columns]))
    long = slim.select(*groups, cells.alias("__cell")).select(*groups, "__cell.*").filter("value is not null")
    keys = [*groups, "column"]
    counts = stable(long.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("__w")))
    ranked = running(counts, keys, ["value"], "__w", "__cum", hot=limit)
    totals = counts.groupBy(*keys).agg(F.sum("__w").alias("__n"))
    ranked = lookup_join(ranked, totals, keys)

    def at(position: Column) -> Column:
        inside = (F.col("__cum") - F.col("__w") <= position) & (position < F.col("__cum"))
        return F.max(F.when(inside, F.col("value")))

    picks, results = [], []
    for i, p in enumerate(probs):
        spot = F.lit(float(p)) * (F.col("__n") - 1)
        picks += [at(F.floor(spot)).alias(f"__lo{i}"), at(F.ceil(spot)).alias(f"__hi{i}")]
        share = F.lit(float(p)) * (F.col("__n") - 1)
        share = share - F.floor(share)
        low, high = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        results.append(F.when((share == 0) | (low == high), low).otherwise((1 - share) * low + share * high))
    picks.append(F.max("__n").alias("__n"))
    table = ranked.groupBy(*keys).agg(*picks).select(*keys, F.array(*results).alias("q"))
    wide = [F.max(F.when(F.col("column") == c, F.col("q"))).alias(c) for c in columns]
    if not groups:
        return table.agg(*wide)
    # a group without values has a row of nulls
    return lookup_join(slim.select(*groups).distinct(), table.groupBy(*groups).agg(*wide), groups)


def fit_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                  hot: int | None = None, n_rows: int | None = None) -> dict[str, list[float]]:
    """Whole-table quantiles as driver values: `len(columns) * len(probs)` numbers, empty for a
    column without values."""
    limit = min(hot_rows(df.sparkSession), PERCENTILE_ROWS) if hot is None else hot
    n_rows = df.count() if n_rows is None else n_rows
    if n_rows > limit:
        return _narrowed_quantiles(df, columns, probs, limit)
    row = exact_quantiles(df, [], columns, probs, hot=limit, largest=n_rows).first()
    return {c: list(row[c]) if row[c] is not None else [] for c in columns}


def _binade(x: Column) -> Column:
    """A whole number that never falls as x grows: one value per power of two, for zero, for the
    infinities and for NaN, which Spark orders last."""
    size = F.greatest(F.floor(F.log2(F.abs(x))), F.lit(-1080)).cast("int") + 1100
    return (F.when(F.isnan(x), 5000).when(x == float("inf"), 4500).when(x == float("-inf"), -4500)
            .when(x == 0, 0).when(x > 0, size).otherwise(-size))


def _narrow(lo: float, hi: float) -> bool:
    """Whether an interval lies within two powers of two, so that equal steps divide it well."""
    return math.isfinite(lo) and math.isfinite(hi) and lo * hi > 0 and 0.25 <= lo / hi <= 4


def _same(a: float, b: float) -> bool:
    return a == b or (math.isnan(a) and math.isnan(b))


def _between(low: float, high: float, share: float) -> float:
    """Linear interpolation as Spark's `percentile` does it; equal ends stay exact."""
    return low if share == 0 or _same(low, high) else (1 - share) * low + share * high


def _narrowed_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], limit: int,
                        buckets: int = 512) -> dict[str, list[float]]:
    """Exact quantiles without moving the values. Each pass counts the rows per bucket of the interval
    that holds a wanted rank, and the interval shrinks to the values of the right bucket, until it has
    one value or few enough to fetch. The first pass divides by powers of two, later ones by equal
    steps, so eight passes are enough for any doubles. A pass shuffles a few numbers per task.
    """
    slim = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    facts = slim.agg(*[F.struct(F.count(c).alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c)
                       for c in columns]).first()
    # (column, rank) → (lowest value, highest value, rows below, rows inside); ranks share intervals
    spans = {}
    for c in columns:
        whole = (facts[c].lo, facts[c].hi, 0, facts[c].n)
        for p in probs if facts[c].n else ():
            spot = p * (facts[c].n - 1)
            for rank in {math.floor(spot), math.ceil(spot)}:
                spans[c, rank] = whole

    def inside(c: str, lo: float, hi: float) -> Column:
        return F.col(c).between(F.lit(lo), F.lit(hi))

    def place(c: str, lo: float, hi: float) -> Column:
        if not _narrow(lo, hi):
            return _binade(F.col(c))
        width = max((hi - lo) / buckets, 5e-324)
        return F.least(F.floor((F.col(c) - F.lit(lo)) / F.lit(width)), F.lit(buckets - 1)).cast("int")

    while True:
        wide = list({(c, span[2]): (c, span) for (c, _), span in spans.items()
                     if not _same(span[0], span[1]) and span[3] > limit}.values())
        if not wide:
            break
        cells = [F.when(inside(c, span[0], span[1]), F.struct(F.lit(i).alias("i"), place(c, span[0], span[1]).alias("b"), F.col(c).alias("x")))
                 for i, (c, span) in enumerate(wide)]
        long = slim.select(F.explode(F.array(*cells)).alias("e")).filter("e is not null").select("e.*")
        found = long.groupBy("i", "b").agg(
            F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
        for i, (c, span) in enumerate(wide):
            seen, steps = span[2], []
            for r in sorted((r for r in found if r["i"] == i), key=lambda r: r["b"]):
                steps.append((r["lo"], r["hi"], seen, r["n"]))
                seen += r["n"]
            for key, old in spans.items():
                if key[0] == c and old[2] == span[2]:
                    spans[key] = next(x for x in steps if x[2] <= key[1] < x[2] + x[3])
    few = list({(c, span[2]): (c, span) for (c, _), span in spans.items() if not _same(span[0], span[1])}.values())
    values = {}
    if few:
        lists = slim.agg(*[F.sort_array(F.collect_list(F.when(inside(c, span[0], span[1]), F.col(c)))).alias(f"v{i}")
                           for i, (c, span) in enumerate(few)]).first()
        values = {(c, span[2]): lists[f"v{i}"] for i, (c, span) in enumerate(few)}

    def at(c: str, rank: int) -> float:
        lo, hi, below, _ = spans[c, rank]
        return lo if _same(lo, hi) else values[c, below][rank - below]

    result = {}
    for c in columns:
        result[c] = []
        for p in probs if facts[c].n else ():
            spot = p * (facts[c].n - 1)
            result[c].append(_between(at(c, math.floor(spot)), at(c, math.ceil(spot)), spot - math.floor(spot)))
    return result


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Exact distinct counts of the given columns, nulls not counted."""
    if not columns:
        return {}
    # one small aggregate per column meets equal values before the shuffle; all run in one job
    parts = [df.groupBy(F.col(c).alias("v")).agg(F.lit(1).alias("one")).agg(
        F.lit(i).alias("i"), F.count("v").alias("n")) for i, c in enumerate(columns)]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    found = {r["i"]: r["n"] for r in table.collect()}
    return {c: int(found[i]) for i, c in enumerate(columns)}


def _closes(amounts: np.ndarray, limit: float, held: float) -> tuple[list[int], float]:
    """Rows after which a group closes, if `held` is in the open group before them, and what is held at the end."""
    if not len(amounts):
        return [], held
    total = np.cumsum(amounts)
    found, at, base = [], 0, 0.0
    while at < len(total):
        close = max(at, int(np.searchsorted(total, base + limit - held)))
        if close >= len(total):
            return found, held + float(total[-1]) - base
        found.append(close)
        at, base, held = close + 1, float(total[close]), 0.0
    return found, held


def _transfer(limit: float) -> Callable:
    """One row per range: the function from what is held at its begin to what is held at its end and the
    groups that close in it. What was held decides the first row that closes a group; from there on the range
    runs by itself. So for every row that may be the first, the rest of the run is told in advance."""
    def run(batches):
        parts = [(b.column("__part"), b.column("__amount").to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
        if not parts:
            return
        total = np.cumsum(np.concatenate([a for _, a in parts]))
        n = len(total)
        before = np.concatenate([[0.0], total])  # sum before each row, and of all rows
        rows = np.arange(n)
        # the row that begins the next group for a group that begins at each row; n + 1: none closes
        follow = np.append(np.maximum(rows, np.searchsorted(total, before[:-1] + limit)) + 1, n)
        closes = np.append((follow[:-1] <= n).astype(np.int64), 0)
        last = np.where(follow > n, np.arange(n + 1), follow)
        while True:  # jumps double until all have arrived at the last begin of a group
            further = last[last]
            if np.array_equal(further, last):
                break
            closes, last = closes + closes[last], further
        held = before[n] - before[last]
        first = min(n, int(np.searchsorted(total, limit)) + 1)
        yield pa.RecordBatch.from_pydict({
            "part": parts[0][0].slice(0, 1).cast(pa.int32()), "total": pa.array([float(total[-1])]),
            "sums": pa.array([total[:first].tobytes()], pa.binary()), "held": pa.array([held[1:first + 1].tobytes()], pa.binary()),
            "closes": pa.array([closes[1:first + 1].tobytes()], pa.binary())})
    return run


def _composed(limit: float) -> Callable:
    """(part, held, closed): what is held, and how many groups have closed, where each range begins."""
    def run(batches):
        held, closed = 0.0, 0
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                found.append((row["part"], held, closed))
                sums, ends, closes = (np.frombuffer(row[c], t) for c, t in (("sums", float), ("held", float), ("closes", np.int64)))
                first = int(np.searchsorted(sums, limit - held))
                if first < len(sums):
                    held, closed = float(ends[first]), closed + 1 + int(closes[first])
                else:
                    held += row["total"]
            part, carry, number = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "held": pa.array(carry, pa.float64()),
                                              "closed": pa.array(number, pa.int64())})
    return run


def _numbered(limit: float, begins: dict, output: str) -> Callable:
    """The rows with their group; `begins` tells held and closed for the begin of each range."""
    def run(batches):
        state = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if state is None:
                state = begins[batch.column("__part")[0].as_py()]
            held, closed = state
            rows, held = _closes(batch.column("__amount").to_numpy(zero_copy_only=False), limit, held)
            ends = np.zeros(batch.num_rows + 1, np.int64)
            ends[np.array(rows, np.int64) + 1] = 1
            groups = closed + np.cumsum(ends)[:-1]
            state = held, closed + len(rows)
            kept = batch.drop_columns(["__part", "__amount"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(groups)], names=[*kept.schema.names, output])
    return run


def closing_groups(df: DataFrame, order: Sequence, size: str, limit: int, output: str) -> DataFrame:
    """0-based group of each row when rows are appended in a total `order` and a group closes once its
    sizes add up to `limit` or more. Sizes are taken as 0 when null and must not be negative.

    Up to the limit of hot groups the rows are sorted in one task. Above it they are sorted in ranges; each
    range publishes how it turns what is held before it into what is held after it, one small task composes
    these functions in order, and every range then numbers its own rows. The number of jobs does not grow with the rows.
    """
    rows = df.drop(output).withColumn("__amount", F.coalesce(F.col(size).cast("double"), F.lit(0.0)))
    schema = T.StructType([*df.drop(output).schema.fields, T.StructField(output, T.LongType())])
    if df.count() <= hot_rows(df.sparkSession):
        begins = {0: (0.0, 0)}
        parts = rows.repartition(1).sortWithinPartitions(*order).withColumn("__part", F.lit(0))
    else:
        parts = stable(rows.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("__part", F.spark_partition_id())
        functions = parts.select("__part", "__amount").mapInArrow(
            _transfer(float(limit)), "part int, total double, sums binary, held binary, closes binary")
        composed = functions.repartition(1).sortWithinPartitions("part").mapInArrow(
            _composed(float(limit)), "part int, held double, closed long")
        begins = {r.part: (r.held, r.closed) for r in composed.collect()}  # one row per range
    return parts.mapInArrow(_numbered(float(limit), begins, output), schema)
