"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most three bits differ in at most three of their eight bytes,
so they share at least five bytes in place. The index posts every distinct fingerprint under
(place, byte) triples: any five places include three of places 0-3 or three of 4-7, so the eight
triples within the halves suffice to bring each such pair into a common posting list. Within a list
the shared positional bytes of each pair are tallied; pairs with five or more are verified by their
differing bits. A list reports only a forest of its links, as stars, never all pairs.

Lists of more than LIST members are cut into chunks by hash; every pair of chunks is a list of its own,
so no pair is lost and no task gets more than two chunks. Components of links come from rounds of
minimum propagation with hooking and pointer jumping, whose state is written to the shared folder.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.arrays import LOWER
from corpusloom.llm.base import query, table
from corpusloom.llm.blocks import stored, text_bytes

SHINGLE, SEED, BITS, MATCHES = 3, 42, 3, 5
#: Members of a posting list that one task compares.
LIST = 2048
TRIPLES = [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]
_LOWER = LOWER.tobytes()
_STEP = 1 << 16


def fingerprint(text: bytes) -> int:
    """SimHash of a text's word shingles as an unsigned number; 0 without words."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    hash_of = partial(xxhash.xxh64_intdigest, seed=SEED)
    if len(words) < SHINGLE:
        return hash_of(b" ".join(words))
    n = len(words) - SHINGLE + 1
    shingles = map(b" ".join, zip(words, words[1:], words[2:]))
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _STEP):
        size = min(_STEP, n - at)
        hashes = np.fromiter(map(hash_of, (next(shingles) for _ in range(size)) if n > _STEP else shingles), np.uint64, size)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(batches):
    for batch in batches:
        found = np.array([fingerprint(t) for t in batch.column("data").to_pylist()], np.uint64)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fp": pa.array(found.view(np.int64))})


def forest(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a list as (member, smallest member of its group); only members that are linked."""
    members = np.unique(members)
    n = len(members)
    parent = np.arange(n)
    for at in range(0, n, 256):  # a strip of the pairs at a time
        differ = members[at:at + 256, None] ^ members[None, at:]
        shared = (differ[..., None].view(np.uint8) == 0).sum(-1)
        a, b = np.nonzero(shared >= MATCHES)
        a, b, x = a + at, b + at, differ[a, b]
        fits = (a < b) & (np.bitwise_count(x) <= BITS)
        a, b = a[fits], b[fits]
        while len(a):  # join groups by their smallest member, then point members at it
            low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
            open_ = low != high
            a, b = a[open_], b[open_]
            np.minimum.at(parent, high[open_], low[open_])
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
    linked = np.flatnonzero(parent != np.arange(n))
    return members[linked], members[parent[linked]]


def list_links(batches):
    """Links within the posting lists of a partition sorted by list; a list may span batches."""
    rest: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([rest, rows]) if rest is not None else rows
        rest, out = _links(rows, False)
        yield out
    if rest is not None:
        yield _links(rest, True)[1]


def _links(rows: pa.Table, final: bool) -> tuple[pa.Table | None, pa.RecordBatch]:
    keys = [rows.column(c).to_numpy() for c in ("triple", "bytes", "chunk")]
    fps = rows.column("fp").to_numpy().view(np.uint64)
    new = np.ones(len(fps), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys]) if len(fps) else True
    starts = np.append(np.flatnonzero(new), len(fps))
    lists = len(starts) - 1
    upto = lists if final else max(lists - 1, 0)
    sizes = np.diff(starts)[:upto]
    found = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
    two = starts[:upto][sizes == 2]  # most lists with any pair have one
    x = fps[two] ^ fps[two + 1] if len(two) else np.zeros(0, np.uint64)
    shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(1)
    fits = (shared >= MATCHES) & (np.bitwise_count(x) <= BITS) & (x != 0)
    low, high = np.minimum(fps[two[fits]], fps[two[fits] + 1]), np.maximum(fps[two[fits]], fps[two[fits] + 1])
    found.append((high, low))
    for i in np.flatnonzero(sizes > 2):
        found.append(forest(fps[starts[i]:starts[i + 1]]))
    out = pa.RecordBatch.from_pydict({
        "a": pa.array(np.concatenate([f[0] for f in found]).view(np.int64)),
        "b": pa.array(np.concatenate([f[1] for f in found]).view(np.int64))})
    return (None if final else rows.slice(starts[upto])), out


def near_links(nodes: DataFrame, limit: int = LIST) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp`; enough of them to connect every group."""
    byte_masks = [sum(0xFF << (8 * i) for i in t) for t in TRIPLES]
    signed = [m - (1 << 64) if m >> 63 else m for m in byte_masks]
    posts = nodes.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("triple"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bytes"))
        for i, m in enumerate(signed)])).alias("post")).select("fp", "post.*")
    sizes = posts.groupBy("triple", "bytes").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > 1)
    lists = posts.join(sizes, ["triple", "bytes"])
    chunks = F.ceil(F.col("size") / F.lit(limit)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda other: (
        F.least(F.col("own"), other).cast("long") * F.col("chunks") + F.greatest(F.col("own"), other)))
    dealt = lists.withColumn("chunks", chunks).withColumn("own", own).select(
        "fp", "triple", "bytes", F.explode(pairs).alias("chunk"))
    dealt = dealt.repartition("triple", "bytes", "chunk").sortWithinPartitions("triple", "bytes", "chunk")
    return dealt.mapInArrow(list_links, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(fp, root) for every linked fingerprint; equal roots mean one component."""
    edges = stored(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    state = stored(edges.groupBy(F.col("a").alias("fp")).agg(F.least(F.col("a"), F.min("b")).alias("root")), "roots")
    while True:
        around = edges.join(state.select(F.col("fp").alias("b"), "root"), "b").groupBy(F.col("a").alias("fp")) \
            .agg(F.min("root").alias("near"))
        # a node's smallest neighbouring root is offered to the node and to the root that it has now
        offers = state.join(around, "fp").select(F.explode(F.array("fp", "root")).alias("fp"), "near") \
            .groupBy("fp").agg(F.min("near").alias("near"))
        nearer = state.join(offers, "fp").select("fp", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = nearer.select(F.col("fp").alias("root"), F.col("root").alias("far"))
        after = stored(nearer.join(jump, "root").select("fp", "old", F.least("root", "far").alias("root")), "roots")
        changed = after.filter(F.col("old") != F.col("root")).limit(1).count()
        state = after.select("fp", "root")
        if not changed:
            return state


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", limit: int = LIST) -> DataFrame:
    """doc_id, fingerprint and component_id (the smallest id in the component) for every document.

    Null and empty texts, or texts of white space, have fingerprint 0 and are linked like any other.
    Repeated rows are copies. A row without an id takes part but names no component; a component
    without any id has none. An empty table gives no rows. Other columns are not read. Very long texts
    are hashed in steps.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(F.col(text)).alias("data"))
    marked = stored(rows.mapInArrow(fingerprints, "doc_id long, fp long"), "fingerprints")
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(near_links(nodes, limit))
    rooted = nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component: the one with the smallest id, with all its columns.

    Rows without an id cannot be named, so they stay. Of repeated rows with one id one stays, the
    first by text.
    """
    first = near_duplicates(docs, id_col, text).filter(F.col("doc_id") == F.col("component_id")) \
        .select(F.col("doc_id").alias("__first")).distinct()
    packed = docs.select(F.struct("*").alias("__row"), F.col(id_col).cast("long").alias("__first"),
                         F.col(text).alias("__text"))
    kept = packed.join(first, "__first", "left_semi")
    once = kept.groupBy("__first").agg(F.min_by("__row", F.coalesce("__text", F.lit(""))).alias("__row"))
    return once.select("__row.*").unionByName(packed.filter(F.col("__first").isNull()).select("__row.*"))


@query("op8_simhash_dedup")
def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
