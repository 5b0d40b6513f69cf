"""Benchmark decontamination by latent semantic retrieval with order and answer checks.

1. The benchmark's words in each passage of all documents are counted and stored once, as a sparse
   matrix A. Words are hashed; document frequencies are counted over all of its rows.
2. Passages are TF-IDF vectors over the benchmark's words (others cannot add to a product with a
   benchmark item). A randomised SVD of the items and of all passages gives the latent space: random
   directions, then rounds of A'A applied by Spark over the stored rows, and an orthonormal basis after each.
   The items together weigh as much as all passages together, or a large corpus would leave them no direction.
3. The rarest words of each item are looked up in every document. Stretches with too few of them to
   hold the item in order are left out; this is an exact test, so no match is lost by it.
4. The windows in what is left are projected and compared with the item by cosine, the nearest first.
   Only the item's words count, in windows about as long as the item, so the words beside a match do
   not matter.
5. Passages are checked by their longest common subsequence with the item, in words: nearly all of the
   item in order is a copy, whatever its cosine; a looser match is a paraphrase if it is near by cosine
   and also holds the answer, which is the item's last sentence.

The model is bounded by the benchmark, not by the corpus, and larger benchmarks are searched in blocks of
items; items of any length are held as a whole, so a block's broadcast grows with their words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import arrays as A
from corpusloom.llm.base import query, table
from corpusloom.llm.blocks import share, shared_thing, stored, text_bytes

#: Hashed words, words of a passage, and words in a step of a window.
FEATURES, PASSAGE, STEP = 1 << 17, 64, 4
#: Dimensions of the latent space, extra random directions, rounds; passages that are multiplied at once, and words of
#: a packed part of the product.
RANK, EXTRA, ROUNDS, ROWS, PART = 128, 8, 2, 16, 32
#: Sizes in words: an item is searched in passages of twice the smallest that holds it, a longer one in twice its length.
SIZES = (8, 12, 16, 24, 32, 48, 64)
#: Least cosine of a paraphrase; least share of the item in order for a copy and for a paraphrase, and
#: of the answer for a paraphrase.
COSINE, COPY, PARAPHRASE, ANSWER = 0.5, 0.8, 0.6, 0.8
#: Looked-up words that are sorted at once, and passages of a text that are projected at once.
EVENTS, PASSAGES = 1 << 21, 1024
#: Items searched at once.
ITEM_BLOCK = 5000


def normal_words(data: np.ndarray, offsets: np.ndarray):
    """Hash of each lower-cased word without ASCII marks around it, and the first word of each text."""
    low = A.LOWER[data]
    starts, ends, first = A.words(low, offsets)
    mark = _MARKS[low]
    # a word that is all marks keeps its last byte
    for _ in range(3):
        trim = mark[starts] & (starts < ends - 1)
        starts = starts + trim
        trim = mark[ends - 1] & (starts < ends - 1)
        ends = ends - trim
    return A.span_hashes(low, starts, ends), first


_MARKS = np.zeros(256, bool)
_MARKS[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def text_parts(data: np.ndarray, offsets: np.ndarray):
    """Ranges of texts of some megabytes, so that memory follows the longest text and not the batch."""
    parts = np.unique(np.searchsorted(offsets[:-1], np.arange(0, len(data), 4 << 20)))
    parts = parts[parts < len(offsets) - 1]
    return zip(parts, [*parts[1:], len(offsets) - 1])


class Items:
    """Benchmark items: word hashes, answers, and the compact numbers of their hashed words."""

    def __init__(self, ids: list, texts: list[bytes], idf: np.ndarray | None = None):
        self.ids, self.words, self.answers = [], [], []
        for item, text in zip(ids, texts):
            hashes, _ = normal_words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
            if not len(hashes):
                continue
            sentences = [s for s in text.replace(b"!", b".").replace(b"?", b".").split(b".") if s.strip()]
            last = sentences[-1] if sentences else text
            answer, _ = normal_words(np.frombuffer(last, np.uint8), np.array([0, len(last)]))
            self.ids.append(item)
            self.words.append(hashes)
            self.answers.append(answer)
        used = np.unique(np.concatenate(self.words) % np.uint64(FEATURES)).astype(np.int64) if self.ids else np.zeros(0, np.int64)
        self.code = np.zeros(FEATURES, np.int32)  # 0: no word of the benchmark
        self.code[used] = np.arange(1, len(used) + 1)
        # by code; without document frequencies the weights are set when they are known
        self.weight = np.zeros(len(used) + 1) if idf is None else np.concatenate([[0.0], idf[used]])

    def size(self, item: int) -> int:
        """The size in which an item is searched; above SIZES its own length in whole steps."""
        words = len(self.words[item])
        return next((s for s in SIZES if s >= words), -(-words // STEP) * STEP)

    def vector(self, words: np.ndarray) -> np.ndarray:
        """TF-IDF over the benchmark's words; entry 0 stays 0."""
        codes = self.code[(words % np.uint64(FEATURES)).astype(np.int64)]
        return np.bincount(codes, minlength=len(self.weight)) * self.weight


def passage_words(code: np.ndarray):
    """The benchmark's words of every passage as numbers code * PASSAGE + occurrences - 1; none: an empty row."""
    def run(batches):
        for batch in batches:
            data, offsets = A.buffer_of(batch.column("data"))
            for a, z in text_parts(data, offsets):
                hashes, first = normal_words(data[offsets[a]:offsets[z]], offsets[a:z + 1] - offsets[a])
                if not len(hashes):
                    continue
                place = np.arange(len(hashes)) - np.repeat(first[:-1], np.diff(first))
                passage = np.cumsum(place % PASSAGE == 0) - 1
                codes = code[(hashes % np.uint64(FEATURES)).astype(np.int64)]
                own = np.flatnonzero(codes)
                keys = np.sort(passage[own] * (FEATURES + 1) + codes[own])
                new = np.flatnonzero(np.diff(keys, prepend=-1))
                row, codes = np.divmod(keys[new], FEATURES + 1)
                packed = (codes * PASSAGE + np.diff(new, append=len(keys)) - 1).astype(np.int32)
                ends = 4 * np.searchsorted(row, np.arange(passage[-1] + 2)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(
                    pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(packed)])], ["words"])
    return run


def unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes and occurrences of all passages one after the other, and where each begins (one more entry)."""
    data, offsets = A.buffer_of(batch.column("words"))
    packed = data.view(np.int32)
    return packed // PASSAGE, packed % PASSAGE + 1, offsets // 4


def word_counter(words: int):
    """Passages that hold each of the benchmark's words, and squared occurrences, over the partition; code 0: all passages."""
    def run(batches):
        total, squares = np.zeros(words, np.int64), np.zeros(words, np.int64)
        for batch in batches:
            codes, counts, _ = unpacked(batch)
            total += np.bincount(codes, minlength=words)
            total[0] += batch.num_rows
            squares += np.bincount(codes, counts * counts, minlength=words).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"code": pa.array(some.astype(np.int32)), "n": pa.array(total[some]),
                                          "squares": pa.array(squares[some])})
    return run


def idf_weights(matrix: DataFrame, words: int) -> tuple[np.ndarray, float]:
    """Squared inverse document frequency of the benchmark's words by code, and the squared length of all passages.

    The square keeps the space for the items' rare words, not for those of every text. Two numbers a word come to the driver.
    """
    counts, squares = np.zeros(words), np.zeros(words)
    for r in matrix.mapInArrow(word_counter(words), "code int, n long, squares long") \
            .groupBy("code").agg(F.sum("n").alias("n"), F.sum("squares").alias("squares")).collect():
        counts[r["code"]], squares[r["code"]] = r["n"], r["squares"]
    weight = np.concatenate([[0.0], np.maximum(np.log((counts[0] + 1.0) / (counts[1:] + 0.5)), 0.0) ** 2])
    return weight, float(squares @ weight ** 2)


def applied(basis: np.ndarray, weight: np.ndarray):
    """A'A times the basis, summed over the passages of a partition, in parts of PART words."""
    def run(batches):
        total = np.zeros(basis.shape)
        near = basis.astype(np.float32)
        for batch in batches:
            codes, counts, offsets = unpacked(batch)
            x = (counts * weight[codes]).astype(np.float32)
            place = np.repeat(np.arange(batch.num_rows) % ROWS, np.diff(offsets))
            for at in range(0, batch.num_rows, ROWS):
                lo, hi = offsets[at], offsets[min(at + ROWS, batch.num_rows)]
                some, column = np.unique(codes[lo:hi], return_inverse=True)
                rows = np.zeros((ROWS, len(some)), np.float32)  # the passages, over the words that they have
                rows[place[lo:hi], column] = x[lo:hi]
                total[some] += rows.T @ (rows @ near[some])
        firsts = range(0, len(total), PART)
        yield pa.RecordBatch.from_pydict({"first": pa.array(firsts, pa.int32()),
                                          "part": A.binary(total[i:i + PART] for i in firsts)})
    return run


def added(group: pa.Table) -> pa.Table:
    """The sum of the parts for some words, in an order that does not depend on the tasks."""
    total = sum(np.frombuffer(raw, np.float64) for raw in sorted(group.column("part").to_pylist()))
    return pa.table({"first": group.column("first").slice(0, 1), "part": A.binary([total])})


def latent_space(matrix: DataFrame, items: Items, length: float, rank: int = RANK) -> np.ndarray:
    """Orthonormal basis (words of the benchmark by rank) of a randomised SVD of the items and all passages.

    The items are scaled to the squared length of all passages.
    """
    words = len(items.weight)
    own = [items.vector(w) for w in items.words]
    scale = (length or 1.0) / (sum(x @ x for x in own) or 1.0)
    basis = np.random.default_rng(7).standard_normal((words, min(rank + EXTRA, words)))
    for turn in range(ROUNDS + 1):
        # one sum comes to the driver, which is as large as the basis
        parts = matrix.mapInArrow(applied(basis, items.weight), "first int, part binary") \
            .groupBy("first").applyInArrow(added, "first int, part binary").collect()
        product = np.zeros(basis.shape)
        for r in parts:
            product[r["first"]:r["first"] + PART] = np.frombuffer(r["part"], np.float64).reshape(-1, basis.shape[1])
        for x in own:
            some = np.flatnonzero(x)
            product[some] += np.outer(scale * x[some], x[some] @ basis[some])
        if turn < ROUNDS:
            basis, _ = np.linalg.qr(product)
    # rotate to the singular directions of the last product, best first
    small, values, _ = np.linalg.svd(product, full_matrices=False)
    return small[:, :rank]


class Searcher:
    """Latent vectors of the items, their words by rarity, and all that a task needs to search texts.

    A text can only hold an item in order if enough of the item's words are there: of n words, of which
    `need` must be in order, any n - need + k hold k of those. Of each item the rarest such words are
    looked up in the texts, so no match is lost, whatever stands beside it.
    """

    def __init__(self, items: Items, basis: np.ndarray):
        self.items = items
        self.embed = (basis * items.weight[:, None]).astype(np.float32)  # of one occurrence of a word
        vectors = np.array([items.vector(w) @ basis for w in items.words])
        self.vectors = (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        self.span = np.array([2 * items.size(i) for i in range(len(items.ids))], np.int64)
        self.least = np.zeros(len(items.ids), np.int64)  # events that a stretch must have
        pairs = []
        for i, words in enumerate(items.words):
            codes = items.code[(words % np.uint64(FEATURES)).astype(np.int64)]
            need = needed(len(words))
            self.least[i] = k = max(1, need // 2)
            rare = codes[np.argsort(-items.weight[codes], kind="stable")][:len(words) - need + k]
            pairs.append(np.unique(rare).astype(np.int64) * len(items.ids) + i)
        pairs = np.sort(np.concatenate(pairs))
        self.item_of = pairs % len(items.ids)  # by code of a word: the items that look it up
        self.item_first = np.searchsorted(pairs // len(items.ids), np.arange(len(items.weight) + 1))

    def stretches(self, hashes: np.ndarray, first: np.ndarray):
        """(item, text, begin, end) of merged stretches of words that hold enough words of the item.

        Every stretch of the item's span that can hold it lies in one of them.
        """
        gap = int(self.span.max())
        room = 3 * gap  # between texts, so that stretches of two never touch
        codes = self.items.code[(hashes % np.uint64(FEATURES)).astype(np.int64)]
        counts = self.item_first[codes + 1] - self.item_first[codes]
        events = np.concatenate([[0], np.cumsum(counts)])
        at = 0
        while at < len(hashes):  # some events at a time; each part also reads the span before it
            stop = max(at + gap, int(np.searchsorted(events, events[at] + EVENTS, "right")) - 1)
            lo, at = max(0, at - gap), min(stop, len(hashes))
            some = np.flatnonzero(counts[lo:at]) + lo
            each = counts[some]
            item = self.item_of[np.arange(each.sum()) + np.repeat(self.item_first[codes[some]] - (np.cumsum(each) - each), each)]
            text = np.searchsorted(first, some, "right") - 1
            line = len(hashes) + room * len(first) + 1
            keys = np.sort(item * line + np.repeat(some + room * text, each))
            item, place = np.divmod(keys, line)
            later = np.arange(len(keys)) + self.least[item] - 1
            later_in = np.minimum(later, len(keys) - 1)
            good = np.flatnonzero((later < len(keys)) & (item[later_in] == item)
                                  & (place[later_in] - place < self.span[item]))
            if not len(good):
                continue
            item, begin, end = item[good], place[later_in[good]] - self.span[item[good]] + 1, place[good] + self.span[item[good]]
            new = np.concatenate([[True], (item[1:] != item[:-1]) | (begin[1:] > end[:-1])])
            last = np.append(np.flatnonzero(new)[1:] - 1, len(new) - 1)
            text = np.searchsorted(first + room * np.arange(len(first)), place[good[new]], "right") - 1
            lo, hi = first[text], first[text + 1]
            begin, end = begin[new] - room * text, end[last] - room * text
            yield from zip(item[new].tolist(), text.tolist(), (np.maximum(begin, lo) - lo).tolist(), (np.minimum(end, hi) - lo).tolist())

    def cosines(self, item: int, hashes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[float]:
        """For each passage lo … hi - 1 the best cosine of the item and a window, by the item's words alone.

        Windows are as long as the item, half longer, and twice as long: words may have been put in.
        """
        own = self.items.code[(self.items.words[item] % np.uint64(FEATURES)).astype(np.int64)]
        codes = self.items.code[(hashes % np.uint64(FEATURES)).astype(np.int64)]
        codes = np.where(np.isin(codes, own), codes, 0)
        sums = np.cumsum(np.concatenate([np.zeros((1, self.embed.shape[1])), self.embed[codes]]), axis=0)
        words = len(self.items.words[item])
        best = np.full(len(lo), -1.0)
        for width in {min(w, len(hashes)) for w in (words, words * 3 // 2, words * 2)}:
            window = sums[width:] - sums[:-width]
            near = window @ self.vectors[item] / (np.sqrt(np.einsum("ij,ij->i", window, window)) + 1e-6)
            for k, (a, z) in enumerate(zip(lo, hi)):
                best[k] = max(best[k], near[min(a, len(near) - 1):max(a + 1, z - width + 1)].max())
        return best.tolist()


def needed(words: int) -> int:
    """Words in order without which a text of so many words is no paraphrase."""
    return max(1, int(np.ceil(PARAPHRASE * words - 1e-9)))


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bits of one integer."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & where.get(y, 0)
        if hit:
            row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def holds(item: np.ndarray, words: np.ndarray) -> bool:
    """Whether the words hold enough of the item in order for a paraphrase."""
    wanted, words = item.tolist(), words.tolist()
    there, need = set(words), needed(len(wanted))
    return sum(w in there for w in wanted) >= need and common_subsequence(wanted, words) >= need


def verify(item: np.ndarray, answer: np.ndarray, passage: np.ndarray) -> tuple[float, float]:
    """Share of the item, and of its answer, that the passage holds in order."""
    words, wanted = passage.tolist(), item.tolist()
    there = set(words)
    if sum(w in there for w in wanted) < PARAPHRASE * len(wanted):  # the sequence cannot be longer
        return 0.0, 0.0
    share = common_subsequence(wanted, words) / len(wanted)
    return share, 1.0 if share == 1.0 else common_subsequence(answer.tolist(), words) / max(len(answer), 1)


def search_texts(searcher: Searcher, data: np.ndarray, offsets: np.ndarray) -> dict:
    """{(text, item): (cosine, share, answer share)} of accepted matches."""
    found: dict = {}
    for a, z in text_parts(data, offsets):
        here = search_some(searcher, data[offsets[a]:offsets[z]], offsets[a:z + 1] - offsets[a])
        found.update({(int(text + a), item): match for (text, item), match in here.items()})
    return found


def search_some(searcher: Searcher, data: np.ndarray, offsets: np.ndarray) -> dict:
    hashes, first = normal_words(data, offsets)
    found: dict = {}
    if not len(hashes):
        return found
    for item, text, begin, end in searcher.stretches(hashes, first):
        own, size = searcher.items.words[item], searcher.items.size(item)
        words = hashes[first[text]:first[text + 1]]
        # passages of twice the size, at steps that start with the text and grow with long items
        step = max(1, size // SIZES[-1]) * STEP
        starts = np.arange(-(-max(0, begin - step) // step) * step, max(end - size, begin) + step, step)
        some_starts = max(1, PASSAGES * STEP // step)
        for at in range(0, len(starts), some_starts):
            lo = np.maximum(starts[at:at + some_starts] - size // 2, 0)
            hi = np.minimum(starts[at:at + some_starts] + size + size // 2, len(words))
            here = words[lo[0]:hi[-1]]
            # no passage holds more in order than all of them
            if not holds(own, here):
                continue
            lo, hi = lo - lo[0], hi - lo[0]
            there = np.concatenate([[0], np.cumsum(np.isin(here, own))])
            some = np.flatnonzero(there[hi] - there[lo] >= needed(len(own)))
            if not len(some):
                continue
            # the nearest passage first
            for cosine, k in sorted(zip(searcher.cosines(item, here, lo[some], hi[some]), some), key=lambda x: (-x[0], x[1])):
                known = found.get((text, item))
                if known and known[1] >= 1.0:
                    break
                share, answer = verify(own, searcher.items.answers[item], here[lo[k]:hi[k]])
                if share >= COPY or share >= PARAPHRASE and answer >= ANSWER and cosine >= COSINE:
                    if not known or share > known[1]:
                        found[text, item] = (cosine, share, answer)
    return found


def finder(shared):
    def run(batches):
        searcher = shared_thing(shared)
        for batch in batches:
            data, offsets = A.buffer_of(batch.column("data"))
            found = search_texts(searcher, data, offsets)
            keys = sorted(found)
            rows = batch.column("row").take(pa.array([t for t, _ in keys], pa.int64()))
            yield pa.RecordBatch.from_pydict({
                "row": rows, "item_id": pa.array([searcher.items.ids[i] for _, i in keys], pa.int64()),
                "cosine": pa.array([found[k][0] for k in keys], pa.float64()),
                "lcs_share": pa.array([found[k][1] for k in keys], pa.float64()),
                "answer_share": pa.array([found[k][2] for k in keys], pa.float64())})
    return run


def marker(shared):
    def run(batches):
        searcher = shared_thing(shared)
        for batch in batches:
            data, offsets = A.buffer_of(batch.column("data"))
            hit = {t for t, _ in search_texts(searcher, data, offsets)}
            keep = pa.array([i for i in range(batch.num_rows) if i not in hit], pa.int64())
            yield batch.select(["row"]).take(keep)
    return run


def searchers(rows: DataFrame, benchmark: DataFrame, item_id: str, item_text: str) -> list:
    """Broadcast searchers, one for each block of items."""
    spark = rows.sparkSession
    own = benchmark.select(F.col(item_id).cast("long").alias("id"), text_bytes(F.lower(F.col(item_text))).alias("data"))
    count = own.count()
    blocks = max(1, -(-count // ITEM_BLOCK))
    out = []
    for k in range(blocks):
        part = own.filter(F.pmod(F.xxhash64("id", "data"), F.lit(blocks)) == k) if blocks > 1 else own
        some = sorted(((r["id"], bytes(r["data"])) for r in part.distinct().collect()), key=lambda r: (r[0] is None, r))
        items = Items([i for i, _ in some], [t for _, t in some])
        if items.ids:
            matrix = stored(rows.select("data").mapInArrow(passage_words(items.code), "words binary"), "passages")
            items.weight, length = idf_weights(matrix, len(items.weight))
            out.append(share(spark, Searcher(items, latent_space(matrix, items, length))))
    return out


def _rows(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
                       text_bytes(F.lower(F.col(text))).alias("data"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text",
               item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(row with the id, item_id, cosine, lcs_share, answer_share) of every document that holds an item.

    Null and empty texts hold nothing, and such items are in nothing. Rows without an id are reported
    without one; repeated rows are each reported; an item without an id is reported without one.
    Equal items are searched once. An empty table on either side gives no rows. Other columns are not
    read. Very long texts are searched in stretches.
    """
    rows = _rows(docs, [id_col], text)
    kind = rows.schema["row"].dataType.simpleString()
    schema = f"row {kind}, item_id long, cosine double, lcs_share double, answer_share double"
    out = None
    for shared in searchers(rows, benchmark, item_id, item_text):
        part = rows.mapInArrow(finder(shared), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
               item_text: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns."""
    out = docs
    for shared in searchers(docs.select(text_bytes(F.lower(F.col(text))).alias("data")),
                            benchmark, item_id, item_text):
        rows = _rows(out, out.columns, text)
        out = rows.mapInArrow(marker(shared), f"row {rows.schema['row'].dataType.simpleString()}").select("row.*")
    return out


@query("op5_decontaminate")
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and the figures of the match."""
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "item_id", F.lit(True).alias("contaminated"), "cosine",
                        "lcs_share", "answer_share")
