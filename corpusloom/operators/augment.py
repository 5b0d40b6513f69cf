"""Label rules, binning, noise and blending over existing numeric columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from corpusloom.functions.hashing import as_col, row_hash, uniform
from .scale import fit_quantiles, hash_positions, lookup_join, positions, rows_to_local

# Ordered words for ordinal columns.
ORDINAL_WORDS = (
    ("low", "medium", "high"),
    ("small", "medium", "large", "xlarge"),
    ("poor", "fair", "good", "excellent"),
    ("never", "rarely", "sometimes", "often", "always"),
    ("strongly_disagree", "disagree", "neutral", "agree", "strongly_agree"),
)


def _total(parts: Sequence[Column]) -> Column:
    return sum(parts[1:], parts[0])


def weighted_score(weights: dict[str, float], noise=None) -> Column:
    """Sum of weight times column, plus an optional noise column."""
    parts = [F.lit(float(w)) * F.col(c) for c, w in weights.items()]
    return _total(parts if noise is None else [*parts, as_col(noise)])


def quadratic_score(columns: Sequence[str], matrix: Sequence[Sequence[float]],
                    linear: dict[str, float] | None = None) -> Column:
    """x'Wx plus an optional linear part; without it, the pure interaction response."""
    parts = [F.lit(float(matrix[i][j])) * F.col(a) * F.col(b)
             for i, a in enumerate(columns) for j, b in enumerate(columns) if matrix[i][j]]
    return _total(parts if linear is None else [*parts, weighted_score(linear)])


def polynomial_score(terms: Sequence[dict[str, float]]) -> Column:
    """terms[d-1] holds the weights of columns raised to degree d."""
    return _total([F.lit(float(w)) * F.pow(F.col(c), F.lit(float(degree)))
                   for degree, weights in enumerate(terms, 1) for c, w in weights.items()])


def additive_response(terms: dict[str, tuple[str, float]]) -> Column:
    """Weighted sum of one shape per column: id, sq, sin (of 3·w·x) or abs."""
    shapes = {"id": lambda x, w: x, "sq": lambda x, w: x * x,
              "sin": lambda x, w: F.sin(x * F.lit(3.0 * w)), "abs": lambda x, w: F.abs(x)}
    return _total([shapes[kind](F.col(c), w) * F.lit(float(w)) for c, (kind, w) in terms.items()])


def median_threshold_label(df: DataFrame, score: str, output: str = "label") -> DataFrame:
    cut = fit_quantiles(df, [score], [0.5])[score][0]
    return df.withColumn(output, (F.col(score) > F.lit(cut)).cast("int"))


def _digitize(x: Column, edges: Sequence[float]) -> Column:
    """Number of edges that are not above x."""
    return _total([(x >= F.lit(float(e))).cast("int") for e in edges]) if edges else F.lit(0)


def quantile_digitize(df: DataFrame, score: str, k: int, output: str = "label") -> DataFrame:
    """Bin by the k-1 interior quantiles of the whole column."""
    edges = fit_quantiles(df, [score], [i / k for i in range(1, k)])[score]
    return df.withColumn(output, _digitize(F.col(score), edges))


def binary_indicator(df: DataFrame, column: str, output: str) -> DataFrame:
    return median_threshold_label(df, column, output)


def bin_to_words(df: DataFrame, column: str, words: Sequence[str], output: str) -> DataFrame:
    """Word per quantile bin. Equal edges are merged; a constant column falls into the first bin."""
    k = len(words)
    edges = sorted(set(fit_quantiles(df, [column], [i / k for i in range(k + 1)])[column]))
    upper = edges[1:] if len(edges) >= 2 else [edges[0] + 1] if edges else []
    spot = F.least(_digitize(F.col(column), upper), F.lit(k - 1))
    return df.withColumn(output, F.element_at(F.array(*[F.lit(w) for w in words]), spot + 1))


def bin_to_categories(df: DataFrame, column: str, k: int, output: str, prefix: str = "v") -> DataFrame:
    return bin_to_words(df, column, [f"{prefix}{i}" for i in range(k)], output)


def tree_rule_label(df: DataFrame, features: Sequence[str], fractions: Sequence[float], classes: int,
                    seed: int = 0, output: str = "label") -> DataFrame:
    """Label by a tree grown from a given rule: level i splits every node on `features[i]` at
    `fractions[i]` of the node's range, low side left. A node with fewer than two rows or a
    constant feature becomes a leaf; a leaf's class is a hash of its path. One aggregate per
    level over at most 2^level nodes; no row moves."""
    spark = df.sparkSession
    out = df.withColumn("__node", F.lit("r"))
    for level, (feature, fraction) in enumerate(zip(features, fractions)):
        # nodes that are still open have one letter per level
        work = out.filter(F.length("__node") == level + 1).select("__node", F.col(feature).cast("double").alias("x"))
        stats = work.groupBy("__node").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n"))
        cuts = [(r["__node"], r.lo + fraction * (r.hi - r.lo)) for r in stats.collect()
                if r.n >= 2 and r.lo is not None and r.lo < r.hi]
        if not cuts:
            break
        side = F.broadcast(rows_to_local(spark, cuts, T.StructType([T.StructField("__node", T.StringType()), T.StructField("__cut", T.DoubleType())])))
        step = F.when(F.col("__cut").isNull(), F.col("__node")).otherwise(F.concat(
            "__node", F.when(F.col(feature).cast("double") <= F.col("__cut"), "L").otherwise("R")))
        out = lookup_join(out, side, ["__node"], checked=True).withColumn("__node", step).drop("__cut")
    bits = F.conv(F.substring(row_hash(seed, "__node"), 1, 8), 16, 10).cast("bigint")
    return out.withColumn(output, bits % classes).drop("__node")


def structural_columns(df: DataFrame, rules: dict[str, dict[str, float]]) -> DataFrame:
    """Columns as weighted sums of earlier ones; `rules` must be in dependency order."""
    known = set(df.columns)
    for name, parents in rules.items():
        unknown = set(parents) - known
        if unknown:
            raise ValueError(f"{name} depends on {sorted(unknown)}, which come later or do not exist.")
        df = df.withColumn(name, weighted_score(parents))
        known.add(name)
    return df


def inject_missing(df: DataFrame, columns: Sequence[str], rate: float, key: Sequence[str], seed: int = 0,
                   skip_below: float = 0.01) -> DataFrame:
    """Null out cells at random, each column on its own; rates up to `skip_below` do nothing."""
    if rate <= skip_below:
        return df
    return df.withColumns({c: F.when(uniform(seed, F.lit(c), *key) >= rate, F.col(c)) for c in columns})


def inject_drift(df: DataFrame, shifts: dict[str, float], key: Sequence[str], min_rows: int = 200) -> DataFrame:
    """Add a constant per column to the second half of the rows in key order. Only the key columns
    are sorted, to find the middle key."""
    total = df.count()
    if total < min_rows:
        return df
    middle = positions(df.select(*key), [], list(key), "__pos", largest=total).filter(F.col("__pos") == total // 2).first()
    edge = F.struct(*[F.lit(middle[c]).cast(df.schema[c].dataType).alias(c) for c in key])
    late = F.struct(*[F.col(c) for c in key]) > edge
    return df.withColumns({c: F.when(late, F.col(c) + F.lit(float(s))).otherwise(F.col(c)) for c, s in shifts.items()})


def mixup(df: DataFrame, numeric: Sequence[str], label: str, share: float, key: Sequence[str], seed: int = 0) -> DataFrame:
    """Blend each row with a partner from a permutation; categories stay, both labels are kept."""
    rows = df.withColumn("__digest", row_hash(seed, F.lit("row"), *key))
    rows = hash_positions(rows, [], "__digest", "__place").drop("__digest")
    mates = df.select(*numeric, label, row_hash(seed, F.lit("mate"), *key).alias("__digest"))
    mates = hash_positions(mates, [], "__digest", "__place").select(
        "__place", *[F.col(c).alias(f"__m_{c}") for c in numeric], F.col(label).alias(f"{label}_partner"))
    blended = {c: F.lit(share) * F.col(c) + F.lit(1 - share) * F.col(f"__m_{c}") for c in numeric}
    out = rows.join(mates, "__place").withColumns(blended)
    return out.withColumn("mix_share", F.lit(share)).drop("__place", *[f"__m_{c}" for c in numeric])


def zscore_by_dataset(df: DataFrame, dataset: Sequence[str], columns: Sequence[str], fill: float | None = 0.0) -> DataFrame:
    """Per dataset (x - mean) / population std; a tiny std counts as 1 and nulls become `fill`.
    The statistics are aggregated and joined back, so a large dataset stays spread out."""
    stats = df.groupBy(*dataset).agg(*[F.avg(c).alias(f"__m_{c}") for c in columns],
                                     *[F.stddev_pop(c).alias(f"__s_{c}") for c in columns])
    out = lookup_join(df, stats, list(dataset))
    scaled = {}
    for c in columns:
        std = F.when(F.col(f"__s_{c}") < 1e-8, F.lit(1.0)).otherwise(F.col(f"__s_{c}"))
        z = (F.col(c) - F.col(f"__m_{c}")) / std
        scaled[c] = z if fill is None else F.coalesce(z, F.lit(fill))
    return out.withColumns(scaled).drop(*[f"__{p}_{c}" for c in columns for p in "ms"])


def series_label(summary: DataFrame, mean: str, classes: int | None, output: str = "label") -> DataFrame:
    """Label per series from its mean: the mean itself, above the median of means, or its bin."""
    if classes is None:
        return summary.withColumn(output, F.col(mean).cast("float"))
    if classes == 2:
        return median_threshold_label(summary, mean, output)
    return quantile_digitize(summary, mean, classes, output)
