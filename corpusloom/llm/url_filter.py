"""URL verdicts from rules and, where none fits, from gradient-boosted trees on lexical features.

All of it is DataFrame and SQL functions. URLs that a rule judges are the labelled ones. Features are
small integers: lengths, depth, ratios, entropy, parameters, and statistics of the host's last labels
(smoothed log odds of block among the labelled URLs, by hash of the label, in fixed tables). Equal
feature rows of the labelled URLs are added up first; each level of each tree is then one aggregate
of gradients by node, feature and value, of which a bounded number of rows reaches the driver.
Gradients are added as integers, so the trees do not depend on the order of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.base import query, table
from corpusloom.session import stable

#: Rules as (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
         ("allow", "org", "/fr/"))
#: Expected labelled URLs used for the trees (drawn by hash); trees, depth, shrinkage, penalty.
SAMPLE, TREES, DEPTH, RATE, PENALTY = 200_000, 10, 3, 0.3, 1.0
#: Values of a feature, and entries of the tables of the last and the last two host labels.
VALUES, LAST, LAST_TWO = 32, 64, 256
_UNIT = 1_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> dict[str, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return {"host": F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER),
            "path": F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)}


def matching_rule(host: Column, path: Column, rules: Sequence = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a parent domain, and the path; else nulls."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, domain, prefix in reversed(ordered):
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(prefix))
        rule = F.when(fits, F.lit(domain + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(name)).otherwise(verdict)
    return rule, verdict


def lexical() -> dict[str, Column]:
    """Features of the columns url, host and path, as whole numbers from 0 to VALUES - 1."""
    url = F.coalesce(F.col("url"), F.lit(""))
    size = F.greatest(F.length(url), F.lit(1))

    def small(x: Column) -> Column:
        return F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(VALUES - 1)).cast("int")

    def ratio(pattern: str, text: Column = url) -> Column:
        return small(F.lit(VALUES) * F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1)))
    letters = F.array_distinct(F.split(url, ""))
    entropy = F.aggregate(letters, F.lit(0.0), lambda acc, c: acc + F.when(c == "", 0.0).otherwise(
        -((F.length(url) - F.length(F.replace(url, c, F.lit("")))) / size)
        * F.log2((F.length(url) - F.length(F.replace(url, c, F.lit("")))) / size)))
    return {
        "length": small(F.length(url) / 8), "host_length": small(F.length("host") / 2),
        "depth": small(F.regexp_count(F.col("path"), F.lit("/"))), "digits": ratio("[0-9]"), "entropy": small(entropy * 4),
        "parameters": small(F.regexp_count(url, F.lit("[?&][^=&#]*="))), "fragment": F.instr(url, "#").cast("boolean").cast("int"),
        "hyphens": small(F.regexp_count(F.col("host"), F.lit("-"))), "labels": small(F.regexp_count(F.col("host"), F.lit("[.]"))),
        "vowels": ratio("[aeiou]", F.col("host")), "secure": F.startswith(url, F.lit("https:")).cast("int"),
        "extension": F.regexp_like(F.col("path"), F.lit("[.][a-z0-9]{1,5}$")).cast("int"),
    }


def last_labels(n: int, size: int) -> Column:
    """Place of the host's last n labels in a table of `size` entries."""
    return F.pmod(F.xxhash64(F.substring_index(F.col("host"), ".", -n)), F.lit(size)).cast("int")


def suffix_table(labelled: DataFrame, place: Column, size: int) -> list[int]:
    """Smoothed log odds of block by entry, as values from 0 to VALUES - 1."""
    rows = labelled.groupBy(place.alias("place")).agg(F.sum("block").alias("pos"), F.count(F.lit(1)).alias("n")).collect()
    odds = [0.0] * size
    for r in rows:
        odds[r["place"]] = math.log((r["pos"] + 1.0) / (r["n"] - r["pos"] + 1.0))
    return [min(VALUES - 1, max(0, math.floor(2 * x) + VALUES // 2)) for x in odds]


def looked_up(values: list[int], place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), place + 1)


def leaf_of(tree: dict, then) -> Column:
    """A tree as an expression; `then` gives the column of a leaf."""
    if "feature" not in tree:
        return then(tree)
    return F.when(F.col(tree["feature"]) <= tree["value"], leaf_of(tree["low"], then)).otherwise(leaf_of(tree["high"], then))


def margin_of(trees: list[dict], prior: float) -> Column:
    total = F.lit(prior)
    for tree in trees:
        total = total + leaf_of(tree, lambda leaf: F.lit(leaf["weight"]))
    return total


def best_split(cells: list, features: list[str]) -> dict | None:
    """Split with the largest gain from (feature, value, gradient, curvature) sums of one node."""
    best, top = None, 1e-6
    for feature in features:
        own = sorted((v, g, h) for f, v, g, h in cells if f == feature)
        total_g, total_h = sum(g for _, g, _ in own), sum(h for _, _, h in own)
        g = h = 0
        for value, cell_g, cell_h in own[:-1]:
            g, h = g + cell_g, h + cell_h
            gain = _gain(g, h) + _gain(total_g - g, total_h - h) - _gain(total_g, total_h)
            if gain > top:
                best, top = {"feature": feature, "value": value, "sums": ((g, h), (total_g - g, total_h - h))}, gain
    return best


def _gain(g: int, h: int) -> float:
    g, h = g / _UNIT, h / _UNIT
    return g * g / (h + PENALTY)


def _leaf(g: int, h: int) -> dict:
    return {"weight": -RATE * (g / _UNIT) / (h / _UNIT + PENALTY)}


def boost(rows: DataFrame, features: list[str], trees: int = TREES, depth: int = DEPTH) -> tuple[list[dict], float]:
    """Trees and prior log odds from rows of (features, n, pos); logistic loss."""
    found = rows.agg(F.sum("n"), F.sum("pos")).first()
    n, pos = found[0] or 0, found[1] or 0
    prior = math.log((pos + 1.0) / (n - pos + 1.0))
    grown: list[dict] = []
    for _ in range(trees if n else 0):
        p = 1 / (1 + F.exp(-margin_of(grown, prior)))
        graded = rows.withColumns({"__g": F.round((F.col("n") * p - F.col("pos")) * _UNIT).cast("bigint"),
                                   "__h": F.round(F.col("n") * p * (1 - p) * _UNIT).cast("bigint")})
        root: dict = {"open": True}
        level = [root]
        for _ in range(depth):
            numbers = {id(node): i for i, node in enumerate(level)}
            place = leaf_of(root, lambda leaf: F.lit(numbers.get(id(leaf), -1)))
            cells = graded.withColumn("__node", place).filter("__node >= 0").select(
                "__node", "__g", "__h", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in features])).alias("c"))
            sums = cells.groupBy("__node", "c.f", "c.v").agg(F.sum("__g"), F.sum("__h")).collect()
            following = []
            for i, node in enumerate(level):
                split = best_split([tuple(r)[1:] for r in sums if r[0] == i], features)
                if split is None:
                    continue
                (lg, lh), (hg, hh) = split.pop("sums")
                node.pop("weight", None)
                node.update(split, low=_leaf(lg, lh), high=_leaf(hg, hh))
                following += [node["low"], node["high"]]
            level = following
            if not level:
                break
        if "feature" not in root:
            break
        root.pop("open", None)
        grown.append(root)
    return grown, prior


def filter_urls(pages: DataFrame, rules: Sequence = RULES, sample: int = SAMPLE, trees: int = TREES) -> DataFrame:
    """All columns of `pages` but those of the result, with host, path, rule, verdict and score.

    A null URL, or one without `://`, has an empty host and path, fits no rule and is judged by the
    trees. Repeated rows are judged alike; an empty table gives no rows; columns named like a result
    are replaced. Long URLs are read whole. Without labelled URLs, or with one verdict only, the prior
    decides, and a tie allows.
    """
    named = pages.withColumns(parts(F.col("url")))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    named = named.withColumns({"rule": rule, "verdict": verdict})
    labelled = named.filter(F.col("verdict").isNotNull()).select(
        "url", "host", "path", (F.col("verdict") == "block").cast("bigint").alias("block"))
    known = labelled.count()
    if known > sample:
        labelled = labelled.filter(F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < int(sample / known * (1 << 30)))
    last = looked_up(suffix_table(labelled, last_labels(1, LAST), LAST), last_labels(1, LAST))
    two = looked_up(suffix_table(labelled, last_labels(2, LAST_TWO), LAST_TWO), last_labels(2, LAST_TWO))
    made = {f"__{k}": c for k, c in (lexical() | {"last": last, "last_two": two}).items()}
    rows = stable(labelled.withColumns(made).groupBy(*made).agg(F.count(F.lit(1)).alias("n"), F.sum("block").alias("pos")))
    grown, prior = boost(rows, list(made), trees)
    judged = named.withColumns(made).withColumn("score", margin_of(grown, prior))
    return judged.withColumn("verdict", F.coalesce("verdict", F.when(F.col("score") > 0, "block").otherwise("allow"))) \
        .drop(*made)


@query("op2_url_filter")
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "score")
