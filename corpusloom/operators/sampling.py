"""Exact, repeatable splits, samples, episodes and orders, all driven by a seeded row hash.

The key given to each operator must identify a row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from corpusloom.functions.hashing import hash_unit, row_hash
from .scale import (closing_groups, collect_small, compute_once, hash_cutoffs, hash_positions, hot_rows, largest_group,
                    lookup_join, positions, rows_at_ranks, rows_to_local, small_side, top_rows)


@dataclass(frozen=True)
class Classes:
    """Class counts (target, n) with their number, extremes and sum. Few classes are also kept as
    driver rows, so that quotas need no further job."""

    counts: DataFrame
    number: int
    smallest: int
    largest: int
    total: int
    rows: list[tuple] | None = None


def class_table(df: DataFrame, target: str) -> Classes:
    return _classes(df.groupBy(target).agg(F.count(F.lit(1)).alias("n")), target)


def _classes(counts: DataFrame, target: str) -> Classes:
    rows = collect_small(counts.select(target, "n"))
    if rows is not None:
        rows = [tuple(r) for r in rows]
        return _few_classes(rows_to_local(counts.sparkSession, rows, counts.select(target, "n").schema), rows)
    row = counts.agg(F.count(F.lit(1)), F.min("n"), F.max("n"), F.sum("n")).first()
    return Classes(counts, row[0], row[1] or 0, row[2] or 0, row[3] or 0)


def _few_classes(counts: DataFrame, rows: list[tuple]) -> Classes:
    sizes = [n for _, n in rows]
    return Classes(counts, len(rows), min(sizes, default=0), max(sizes, default=0), sum(sizes), rows)


def class_quotas(classes: Classes, target: str, size: int) -> Classes:
    """Split `size` over the classes by largest remainder; ties go to the smaller class value.
    Classes without a share drop out."""
    if classes.rows is not None:
        shares = [(value, *divmod(size * n, classes.total)) for value, n in classes.rows]
        spare = size - sum(base for _, base, _ in shares)
        # nulls first, as in a Spark sort
        shares.sort(key=lambda s: (-s[2], s[0] is not None, s[0] if s[0] is not None else 0))
        rows = [(value, base + (place < spare)) for place, (value, base, _) in enumerate(shares)]
        rows = [r for r in rows if r[1] > 0]
        return _few_classes(rows_to_local(classes.counts.sparkSession, rows, classes.counts.schema), rows)
    wide = F.col("n").cast("decimal(38,0)") * F.lit(size).cast("decimal(20,0)")
    whole = F.lit(classes.total).cast("decimal(20,0)")
    shares = classes.counts.withColumn("__base", F.floor(wide / whole).cast("bigint"))
    shares = shares.withColumn("__rest", (wide - F.col("__base") * whole).cast("decimal(38,0)"))
    spare = size - (shares.agg(F.sum("__base")).first()[0] or 0)
    ranked = positions(shares, [], [F.desc("__rest"), target], "__place", largest=classes.number)
    quota = F.col("__base") + (F.col("__place") <= spare).cast("bigint")
    return _classes(compute_once(ranked.select(target, quota.alias("n")).filter("n > 0")), target)


def can_stratify(classes: Classes, size: int) -> bool:
    """Every class needs two rows and each side room for every class."""
    return classes.smallest >= 2 and size >= classes.number and classes.total - size >= classes.number


def _cut(df: DataFrame, rows: DataFrame, target: str | None, digest: str, quotas: dict[str, Classes | int],
         largest: int) -> tuple[DataFrame, dict[str, Column]]:
    """One condition per quota: true for that many of `rows`, smallest digests first, per class of
    `target` or over all. Only the digest at each quota is looked up; it is joined to `df` (or
    becomes a literal) and compared in place, so no row is shuffled."""
    names = list(quotas)
    if target is None:
        spark = rows.sparkSession
        bounds = spark.range(1).select(F.lit(0).alias("__all"), *[F.lit(q).cast("bigint").alias(n) for n, q in quotas.items()])
        marked = rows.select(digest).withColumn("__all", F.lit(0))
        cut = hash_cutoffs(marked, ["__all"], digest, F.broadcast(bounds), names, largest=largest).first()
        edges = {n: cut[f"__cut_{n}"] if cut else None for n in names}
        return df, {n: F.lit(False) if e is None else F.col(digest) <= F.lit(e) for n, e in edges.items()}
    cuts = hash_cutoffs(rows, [target], digest, _bounds(quotas, target), names, largest=largest)
    out = lookup_join(df, cuts, [target])
    return out, {n: F.coalesce(F.col(digest) <= F.col(f"__cut_{n}"), F.lit(False)) for n in names}


def _bounds(quotas: dict[str, Classes], target: str) -> DataFrame:
    """(target, one column per quota); a class without a share has null."""
    tables = list(quotas.values())
    if all(t.rows is not None for t in tables):
        shares = [dict(t.rows) for t in tables]
        rows = [(value, *[s.get(value) for s in shares]) for value in shares[0]]
        fields = [tables[0].counts.schema[target], *[T.StructField(n, T.LongType()) for n in quotas]]
        return F.broadcast(rows_to_local(tables[0].counts.sparkSession, rows, T.StructType(fields)))
    bounds = None
    for name, table in quotas.items():
        part = table.counts.select(target, F.col("n").alias(name))
        bounds = part if bounds is None else lookup_join(bounds, part, [target])
    return small_side(bounds)


def cap_rows_stratified(df: DataFrame, n: int | None, target: str, task: str, key: Sequence[str],
                        seed: int = 7) -> DataFrame:
    """Exactly `n` rows, class-proportional unless the task is regression."""
    if n is None:
        return df
    work = df.withColumn("__digest", row_hash(seed, *key))
    classes = class_table(work, target) if task != "regression" else None
    total = classes.total if classes else df.count()
    if total <= n:
        return df
    if classes and can_stratify(classes, n):
        work, inside = _cut(work, work, target, "__digest", {"taken": class_quotas(classes, target, n)}, classes.largest)
    else:
        work, inside = _cut(work, work, None, "__digest", {"taken": n}, total)
    return work.filter(inside["taken"]).select(*df.columns)


def split_table(df: DataFrame, target: str, task: str, key: Sequence[str], seed: int = 7,
                val_fraction: float = 0.1, test_fraction: float = 0.1, label: str = "split") -> DataFrame:
    """Add `split` = train / val / test with exact sizes, stratified for classification.

    Falls back to a plain split when a class is too small. Sizes round up on the held-out side.
    Test rows are the held-out rows with the smallest digests, so both cuts come from one ranking.
    """
    held = val_fraction + test_fraction
    if val_fraction < 0 or test_fraction < 0 or held >= 1:
        raise ValueError("Held-out fractions cannot be negative, and some rows must be left for training.")
    if held == 0:
        return df.withColumn(label, F.lit("train"))
    work = df.withColumn("__digest", row_hash(seed, *key))
    classes = class_table(work, target) if task != "regression" else None
    total = classes.total if classes else df.count()
    n_held = math.ceil(held * total)
    n_test = math.ceil(test_fraction / held * n_held)
    first = class_quotas(classes, target, n_held) if classes and can_stratify(classes, n_held) else None
    second = class_quotas(first, target, n_test) if first and n_test and can_stratify(first, n_test) else None
    if second:
        work, inside = _cut(work, work, target, "__digest", {"held": first, "test": second}, classes.largest)
    elif classes is None or not n_test:
        quotas = {"held": n_held, "test": n_test} if first is None else {"held": first}
        work, inside = _cut(work, work, target if first else None, "__digest", quotas, classes.largest if first else total)
        inside.setdefault("test", F.lit(False))
    else:
        # one of the two cuts cannot be stratified, so the second works on the rows of the first
        work, inside = _cut(work, work, target if first else None, "__digest", {"held": first if first else n_held},
                            classes.largest if first else total)
        work = work.withColumn("__held", inside["held"]).drop("__cut_held")
        rows = work.filter("__held")
        left = first or class_table(rows, target)
        again = class_quotas(left, target, n_test) if can_stratify(left, n_test) else None
        work, inside = _cut(work, rows, target if again else None, "__digest", {"test": again if again else n_test},
                            left.largest if again else n_held)
        inside["held"] = F.col("__held")
    name = F.when(~inside["held"], "train").when(inside["test"], "test").otherwise("val")
    return work.select(*df.columns, name.alias(label))


def fixed_size_sample(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """`n` rows without replacement, those with the smallest digests. Digests are uniform, so rows
    beyond a bound a little over `n / count` need not be sorted; for large `n` the exact cut-off is
    looked up instead."""
    work = df.withColumn("__digest", row_hash(seed, *key))
    if n <= 100_000:
        return likely_smallest(work, n).orderBy("__digest").limit(n).drop("__digest")
    work, inside = _cut(work, work, None, "__digest", {"taken": n}, df.count())
    return work.filter(inside["taken"]).drop("__digest")


def likely_share(n, count) -> Column:
    """Share of the digest range that holds the `n` smallest of `count` digests but for one case in
    millions."""
    n = F.lit(n) if isinstance(n, (int, float)) else n
    return (n + 6 * F.sqrt(n) + 20) / count


def likely_smallest(work: DataFrame, n: int) -> DataFrame:
    """Rows whose `__digest` can be among the `n` smallest; all rows if the bound was too low."""
    cut = work.filter(hash_unit(F.col("__digest")) <= likely_share(n, F.lit(max(work.count(), 1))))
    return cut if cut.limit(n).count() >= n else work


def check_episode_sizes(df: DataFrame, dataset: Sequence[str], needed: int) -> None:
    row = df.groupBy(*dataset).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()
    if row[0] is None or row[0] < needed:
        raise ValueError(f"Every dataset needs at least {needed} rows; the smallest has {row[0] or 0}.")


def sample_episode(df: DataFrame, dataset: Sequence[str], key: Sequence[str], support: int, query: int,
                   seed: int = 0) -> DataFrame:
    """Disjoint support and query rows per dataset. Digests are uniform, so only rows below a bound a
    little over the wanted share of their dataset are shuffled and ranked, however large it is."""
    wanted = support + query
    check_episode_sizes(df, dataset, wanted)
    work = df.withColumn("__digest", row_hash(seed, *key))
    sizes = df.groupBy(*dataset).agg(F.count(F.lit(1)).alias("__size"))
    near = lookup_join(work, sizes, list(dataset)).filter(hash_unit(F.col("__digest")) <= likely_share(wanted, F.col("__size"))).drop("__size")
    left = near.groupBy(*dataset).agg(F.count(F.lit(1)).alias("__left")).filter(F.col("__left") >= wanted)
    # a dataset that kept too few, which is next to impossible, sends all its rows
    if left.count() == sizes.count():
        work = near
    ranked = work.withColumn("__rn", F.row_number().over(W.partitionBy(*dataset).orderBy("__digest")))
    chosen = ranked.filter(F.col("__rn") <= support + query)
    role = F.when(F.col("__rn") <= support, "support").otherwise("query")
    return chosen.withColumn("role", role).drop("__digest", "__rn")


def sample_episode_with_replacement(df: DataFrame, dataset: Sequence[str], key: Sequence[str], support: int,
                                    query: int, seed: int = 0) -> DataFrame:
    """Independent draws: the i-th draw of a dataset is a hashed row index. Of large datasets only the digest
    buckets that hold a drawn index are moved."""
    sizes = df.groupBy(*dataset).agg(F.count(F.lit(1)).alias("__n"))
    draws = sizes.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(support + query))))
    bits = F.conv(F.substring(row_hash(seed, F.lit("draw"), *dataset, "draw"), 1, 8), 16, 10).cast("bigint")
    draws = draws.select(*dataset, "draw", (bits % F.col("__n") + 1).alias("__row"))
    work = df.withColumn("__digest", row_hash(seed, *key))
    if largest_group(df, dataset) > hot_rows(df.sparkSession):
        rows = rows_at_ranks(work, list(dataset), "__digest", draws.select(*dataset, "__row").distinct(), "__row")
    else:
        rows = hash_positions(work, dataset, "__digest", "__row")
    role = F.when(F.col("draw") <= support, "support").otherwise("query")
    return lookup_join(draws, rows, [*dataset, "__row"], how="inner", checked=True).withColumn("role", role).drop("__row", "__digest")


def weighted_order(df: DataFrame, weight: str, key: Sequence[str], seed: int = 0,
                   output: str = "position") -> DataFrame:
    """Order of repeated weighted draws without replacement (exponential keys)."""
    u = F.greatest(hash_unit(row_hash(seed, *key)), F.lit(1e-18))
    race = -F.ln(u) / F.greatest(F.col(weight).cast("double"), F.lit(1e-6))
    return positions(df.withColumn("__race", race), [], ["__race", *key], output).drop("__race")


def shuffle_pool(df: DataFrame, shard: str, key: Sequence[str], pool_rows: int, seed: int = 0) -> DataFrame:
    """Permute shards, fill pools of at least `pool_rows` rows, permute the rows of each pool.
    Adds `pool` (0-based) and `pool_position` (1-based)."""
    sizes = df.groupBy(shard).agg(F.count(F.lit(1)).alias("n")).withColumn("__order", row_hash(seed, shard))
    pools = closing_groups(sizes, ["__order", shard], "n", pool_rows, "pool").select(shard, "pool")
    placed = lookup_join(df, pools, [shard]).withColumn("__digest", row_hash(seed, F.lit("row"), *key))
    return hash_positions(placed, ["pool"], "__digest", "pool_position").drop("__digest")


def interleave_datasets(tables: Sequence[DataFrame], key: Sequence[str], batch: int, factor: int = 2,
                        seed: int = 0) -> DataFrame:
    """Append tables until `factor * batch` rows are there, then draw one shuffled batch.
    Only counts come to the driver."""
    needed, taken = batch * factor, []
    for df in tables:
        taken.append(df)
        needed -= df.count()
        if needed <= 0:
            break
    pool = taken[0]
    for df in taken[1:]:
        pool = pool.unionByName(df, allowMissingColumns=True)
    return fixed_size_sample(pool, batch, key, seed)
