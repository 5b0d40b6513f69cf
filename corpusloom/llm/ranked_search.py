"""Ranked lexical search: the best documents for each query, by MaxScore with bounds for pairs of terms.

Score: terms are lower-cased runs of letters, digits and bytes above 127. With N documents that have a
term, L terms in all, n terms in a document, df documents holding a term and tf times in this one, a term
adds w * ((10^9 tf) div (1000 tf + 8 m)), with w = floor(1000 ln((2N + 2) / (2 df + 1))) and
m = 10 + (90 n N) div L; all but the logarithm is whole numbers.

Index: one pass over the texts stores, per document, the query terms it holds and how often; further
passes read these numbers only. Totals and df come from all documents. Each block of the index gets a
posting list per term with its greatest impact, and, for pairs of terms that many queries share, the
intersection of both lists with joint impacts and their greatest.

Search: per query and block, lists are added from the greatest impact on. The rest of the terms is
bounded by its pairs: documents that hold both terms of a pair add at most the greatest joint impact,
others the greater of the single ones. That is often far below the sum of both, so lists are left out
earlier than by single bounds. Once no document outside those seen can reach the tenth best score, only
documents seen go on, and leave as soon as their own bound falls below it: a document in an
intersection takes the stored joint impact, one outside it is bounded by the greater single impact.
The tenth best score of one block in SEEDS is known to all others. Bounds are compared strictly, so
ties are never lost; results are exact.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.arrays import pieces
from corpusloom.llm.base import query, table
from corpusloom.llm.blocks import share, shared_thing, stored, text_bytes

#: Documents that are reported for each query.
TOP = 10
#: Bytes of query texts that are searched in one go; more are searched in several, each by a pass of its own.
QUERY_BYTES = 16 << 20
#: Postings of a block at most (a longer document is a block on its own); one block in SEEDS goes first.
BLOCK_POSTINGS, SEEDS = 2_000_000, 16
#: Common terms of a query that are paired, queries that must share a pair, and pairs kept at most.
#: A pair that is not kept is bounded by its two terms; results do not depend on it.
PAIRED, SHARED, PAIRS = 12, 2, 4_000
#: Letters, digits and all bytes above 127, lower-cased; every other byte parts terms.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def term_counts(text: bytes) -> Counter:
    """How often a text holds each of its terms."""
    found: Counter = Counter()
    for piece in pieces(text.translate(_TERMS)):
        found.update(piece.split(b" "))
    found.pop(b"", None)
    return found


class Queries:
    """Distinct terms of some queries, by number, and the terms of each query."""

    def __init__(self, texts: list[bytes]):
        held = [sorted(term_counts(t)) for t in texts]
        self.number = {t: i for i, t in enumerate(sorted({t for terms in held for t in terms}))}
        self.terms = [np.array([self.number[t] for t in terms], np.int64) for terms in held]


def indexer(shared):
    """Per document: id, number of terms, numbers of the query terms it holds, and how often each."""
    def run(batches):
        number = shared_thing(shared).number
        for batch in batches:
            sizes, terms, times = [], [], []
            for text in batch.column("data"):
                found = term_counts(text.as_py())
                held = sorted((number[t], found[t]) for t in found.keys() & number.keys())
                sizes.append(sum(found.values()))
                terms.append(np.array([t for t, _ in held], np.int32).tobytes())
                times.append(np.array([n for _, n in held], np.int64).tobytes())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_terms": pa.array(sizes, pa.int64()),
                "terms": pa.array(terms, pa.binary()), "times": pa.array(times, pa.binary())})
    return run


INDEX = "doc_id long, n_terms long, terms binary, times binary"


def df_counter(count: int):
    """(term, df) of a task's documents."""
    def run(batches):
        total = np.zeros(count, np.int64)
        for batch in batches:
            flat = b"".join(batch.column("terms").to_pylist())
            total += np.bincount(np.frombuffer(flat, np.int32), minlength=count)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(held, pa.int64()), "df": pa.array(total[held], pa.int64())})
    return run


def term_weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Plan:
    """What every block needs: weights, the terms of each query, its pairs, and the totals N and L."""

    def __init__(self, queries: Queries, df: np.ndarray, documents: int, total: int):
        self.documents, self.total = documents, total
        self.weights = np.array([term_weight(documents, int(d)) for d in df], np.int64)
        self.queries = queries.terms
        order = np.argsort(-df, kind="stable")
        place = np.empty(len(df), np.int64)
        place[order] = np.arange(len(df))
        common = [sorted(terms.tolist(), key=lambda t: place[t])[:PAIRED] for terms in self.queries]
        uses: Counter = Counter()
        for terms in common:
            uses.update((min(p), max(p)) for p in combinations(terms, 2))
        least = min(SHARED, max(len(self.queries), 1))
        kept = sorted((p for p, n in uses.items() if n >= least), key=lambda p: (-uses[p], place[p[0]] + place[p[1]], p))[:PAIRS]
        rank = {p: i for i, p in enumerate(kept)}

        def ranked(terms):
            return sorted((p for p in map(tuple, map(sorted, combinations(terms, 2))) if p in rank), key=rank.get)

        # each term of a query stands in at most one of its pairs; the most shared and most common go first
        self.matched: list = []
        used: dict = {}
        for terms in common:
            mine, taken = [], set()
            for p in ranked(terms):
                if not taken & set(p):
                    taken.update(p)
                    mine.append(p)
                    used.setdefault(p, len(used))
            self.matched.append(mine)
        self.pairs = list(used)

    def lengths(self, sizes: np.ndarray) -> np.ndarray:
        """8 m for each document; whole numbers of any size."""
        distinct, which = np.unique(sizes, return_inverse=True)
        return np.array([8 * (10 + 90 * int(n) * self.documents // max(self.total, 1)) for n in distinct], np.int64)[which]


class Block:
    """Posting lists of a block, with greatest impacts, and the intersection lists of the pairs."""

    def __init__(self, plan: Plan, ids: list, sizes: np.ndarray, terms: np.ndarray, times: np.ndarray, held: np.ndarray):
        self.plan, self.ids = plan, ids
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), held)
        gain = plan.weights[terms] * (1_000_000_000 * times // (1000 * times + plan.lengths(sizes)[doc]))
        order = np.argsort(terms, kind="stable")  # documents stay ascending within a term
        self.docs, self.gains = doc[order], gain[order]
        self.starts = np.searchsorted(terms[order], np.arange(len(plan.weights) + 1))
        self.most = np.zeros(len(plan.weights), np.int64)
        full = np.flatnonzero(np.diff(self.starts))
        if len(full):
            self.most[full] = np.maximum.reduceat(self.gains, self.starts[full])
        self.joint = {p: self.intersect(*p) for p in plan.pairs}
        self.scores = np.zeros(len(ids), np.int64)

    def list_of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.starts[term], self.starts[term + 1])
        return self.docs[part], self.gains[part]

    def intersect(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents that hold both terms, their joint impacts, and the greatest of them."""
        (docs_a, gains_a), (docs_b, gains_b) = self.list_of(a), self.list_of(b)
        docs, at_a, at_b = np.intersect1d(docs_a, docs_b, assume_unique=True, return_indices=True)
        gains = gains_a[at_a] + gains_b[at_b]
        return docs, gains, int(gains.max(initial=0))

    def bound(self, unit: tuple) -> int:
        """The most that a term, or a pair of terms, adds to any document of the block."""
        single = max(int(self.most[t]) for t in unit)
        return single if len(unit) == 1 else max(single, self.joint[unit][2])

    def gains_of(self, term: int, docs: np.ndarray) -> np.ndarray:
        """What a term adds to each of some documents."""
        own, gains = self.list_of(term)
        out = np.zeros(len(docs), np.int64)
        if len(own):
            at = np.minimum(np.searchsorted(own, docs), len(own) - 1)
            hit = own[at] == docs
            out[hit] = gains[at[hit]]
        return out

    def best(self, query: int, least: int, top: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents, scores, and the number of postings added before lists were skipped. All documents with one of the `top` best
        scores of the block are among them, unless their score lies below `least`."""
        terms = sorted((int(t) for t in self.plan.queries[query] if self.most[t] > 0), key=lambda t: (-self.most[t], t))
        partner = {t: p for p in self.plan.matched[query] for t in p}
        # rest[i]: the most that the terms from place i on can add, by the pairs that lie among them
        rest = [0]
        later: set = set()
        for t in reversed(terms):
            pair = partner.get(t)
            if pair and later & set(pair):
                rest.append(rest[-1] + self.bound(pair) - int(self.most[(later & set(pair)).pop()]))
            else:
                rest.append(rest[-1] + int(self.most[t]))
            later.add(t)
        rest.reverse()
        self.scores[:] = 0
        least, read, done = max(least, 1), 0, 0
        while done < len(terms) and rest[done] >= least:
            docs, gains = self.list_of(terms[done])
            self.scores[docs] += gains
            read += len(docs)
            done += 1
            if len(self.scores) > top:  # a score only grows, so the tenth best so far bounds the last one
                least = max(least, int(np.partition(self.scores, -top)[-top]))
        docs = np.flatnonzero(self.scores)
        scores = self.scores[docs]
        left = set(terms[done:])
        units = {partner[t] if t in partner and set(partner[t]) <= left else (t,) for t in left}  # disjoint
        open_ = rest[done]
        for unit in sorted(units, key=lambda u: (-self.bound(u), u)):
            kept = scores + open_ >= least
            docs, scores = docs[kept], scores[kept]
            open_ -= self.bound(unit)
            if len(unit) == 2:
                both, gains, _ = self.joint[unit]
                hit = np.zeros(len(docs), bool)
                if len(both):
                    at = np.minimum(np.searchsorted(both, docs), len(both) - 1)
                    hit = both[at] == docs
                    scores[hit] += gains[at[hit]]
                # outside the intersection a document holds one of the terms at most
                for term in sorted(unit, key=lambda t: -self.most[t]):
                    alive = hit | (scores + int(self.most[term]) + open_ >= least)
                    docs, scores, hit = docs[alive], scores[alive], hit[alive]
                    gained = self.gains_of(term, docs[~hit])
                    scores[~hit] += gained
                    hit[~hit] = gained > 0
            else:
                scores = scores + self.gains_of(unit[0], docs)
            if len(scores) > top:
                least = max(least, int(np.partition(scores, -top)[-top]))
        kept = scores >= least
        return docs[kept], scores[kept], read


def blocks_of(batches, limit: int):
    """Documents with query terms, in blocks of at most `limit` postings (or one document)."""
    ids, sizes, terms, times, count = [], [], [], [], 0
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("doc_id", "n_terms", "terms", "times"))
        for doc_id, size, term, time in zip(*columns):
            if count and count + len(term) // 4 > limit:
                yield ids, sizes, terms, times
                ids, sizes, terms, times, count = [], [], [], [], 0
            ids.append(doc_id)
            sizes.append(size)
            terms.append(term)
            times.append(time)
            count += len(term) // 4
    if ids:
        yield ids, sizes, terms, times


def searcher(shared, least, top: int, limit: int):
    """(query, doc_id, score): the best documents of each block."""
    def run(batches):
        plan = shared_thing(shared)
        known = shared_thing(least)
        for ids, sizes, terms, times in blocks_of(batches, limit):
            held = np.array([len(t) // 4 for t in terms], np.int64)
            block = Block(plan, ids, np.array(sizes, np.int64), np.frombuffer(b"".join(terms), np.int32).astype(np.int64),
                          np.frombuffer(b"".join(times), np.int64), held)
            key = np.array([(i is None, i or 0) for i in ids], [("none", bool), ("id", np.int64)])
            found = []
            for q in range(len(plan.queries)):
                docs, scores, _ = block.best(q, known.get(q, 0), top)
                order = np.lexsort((key["id"][docs], key["none"][docs], -scores))[:top]
                found.append((np.full(len(order), q), docs[order], scores[order]))
            which, docs, scores = (np.concatenate(c) for c in zip(*found))
            yield pa.RecordBatch.from_pydict({
                "query": pa.array(which, pa.int64()), "doc_id": pa.array([ids[d] for d in docs], pa.int64()),
                "score": pa.array(scores, pa.int64())})
    return run


FOUND = "query long, doc_id long, score long"


def top_rows(found: DataFrame, top: int) -> DataFrame:
    """The best rows of each query with their rank; tasks keep only their own best before the shuffle."""
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def search_some(texts: list[bytes], rows: DataFrame, top: int, limit: int) -> DataFrame:
    """(query, rank, doc_id, score) for some queries; `rows` has doc_id and data."""
    spark = rows.sparkSession
    queries = Queries(texts)
    count = len(queries.number)
    index = stored(rows.mapInArrow(indexer(share(spark, queries)), INDEX), "search-index")
    totals = index.agg(F.count_if(F.col("n_terms") > 0).alias("n"), F.sum("n_terms").alias("l")).first()
    df = np.zeros(count, np.int64)
    for r in index.mapInArrow(df_counter(count), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r.term] = r.df
    plan = share(spark, Plan(queries, df, totals.n, totals.l or 0))
    held = index.filter(F.octet_length("terms") > 0)
    seed = F.pmod(F.xxhash64("doc_id", "n_terms", "terms"), F.lit(SEEDS)) == 0
    first = stored(top_rows(held.filter(seed).mapInArrow(searcher(plan, share(spark, {}), top, limit), FOUND), top), "search-seeds")
    known = {r.query: r.least for r in first.filter(F.col("rank") == top).select("query", F.col("score").alias("least")).collect()}
    rest = held.filter(~seed).mapInArrow(searcher(plan, share(spark, known), top, limit), FOUND)
    return top_rows(first.drop("rank").unionByName(rest), top)


def search(queries: DataFrame, docs: DataFrame, top: int = TOP, query_id: str = "item_id", query_text: str = "text",
           id_col: str = "doc_id", text: str = "text", query_bytes: int = QUERY_BYTES,
           limit: int = BLOCK_POSTINGS) -> DataFrame:
    """The `top` best documents with a score above 0 for each row of `queries`: query_id, rank, doc_id, score.

    Equal scores are ranked by ascending id, null ids last. Null and empty texts have no terms: such a query
    finds nothing, such a document is not counted and never found. Every row of `queries` is a query of its
    own, also if ids or texts repeat or are null, and every row of `docs` a document. Empty tables give no
    rows. Other columns are not read, so names cannot clash. Very long texts are read in pieces. Queries come
    to the driver in portions of at most `query_bytes` (or one query), each searched on its own.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_bytes(F.col(text)).alias("data"))
    asked = stored(queries.select(F.col(query_id).alias("id"), text_bytes(F.col(query_text)).alias("data"))
                   .withColumns({"bytes": F.octet_length("data"), "row": F.monotonically_increasing_id()}), "search-queries")
    portions = max(1, -(-(asked.agg(F.sum(F.col("bytes") + 64)).first()[0] or 0) // query_bytes))
    kind = asked.schema["id"].dataType
    spark, out = docs.sparkSession, None
    for portion in range(portions):
        mine = asked.filter(F.pmod(F.xxhash64("row"), F.lit(portions)) == portion).select("id", "data").collect()
        mine.sort(key=lambda r: (r.id is None, r.id if r.id is not None else 0, bytes(r.data)))
        names = spark.createDataFrame([(i, r.id) for i, r in enumerate(mine)], f"query long, `{query_id}` {kind.simpleString()}")
        found = search_some([bytes(r.data) for r in mine], rows, top, limit)
        named = found.join(F.broadcast(names), "query").select(query_id, "rank", "doc_id", "score")  # a row per query of a portion
        out = named if out is None else out.unionByName(named)
    return out


@query("op11_ranked_search", r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
size AS (SELECT doc_id, count(*) AS n FROM words GROUP BY ALL),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM size),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
weighed AS (
  SELECT item_id, term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w
  FROM asked JOIN df USING (term), total),
scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM weighed JOIN tf USING (term) JOIN size USING (doc_id), total GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10""")
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search(table(spark, sf_dir, "benchmark").select("item_id", "text"), docs)
