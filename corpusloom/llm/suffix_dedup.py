"""Removal of long repeated strings with run-length compressed suffix indexes.

Task: remove every byte that lies in a string of `width` bytes which also starts somewhere else in
the corpus. An index of the whole corpus fits in no task, so strings are dealt so that equal ones meet:

1. Every window of `width` bytes has an anchor: the smallest hash among its `GRAM`-byte substrings,
   the leftmost of equals. Equal windows have the same anchor at the same place. Neighbouring windows
   with one anchor form a segment; each window of the corpus belongs to exactly one segment.
2. Blocks ask, per (anchor, hash of the segment), how often it occurs. A segment that occurs twice
   repeats as a whole. One that is alone, though its anchor also has other segments, may repeat in
   part; one copy of each segment of such anchors is sent to the bucket of the anchor.
3. A bucket builds a `RunIndex` over its segments, a run-length compressed Burrows-Wheeler transform
   with the text position of every run's ends, and streams matching statistics: the length of the
   longest string that starts here and somewhere else, for every position. Windows whose length
   reaches `width` are marked.
4. An anchor with more than HOT_SEGMENTS different segments (a phrase that very many documents
   share) would crowd one bucket. Its windows are sent as 64-bit hashes, dealt by the window itself.
5. Blocks join the answers and cut the marked bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import arrays as A
from corpusloom.llm.base import query, table
from corpusloom.llm.blocks import count_blocks, in_blocks

WIDTH, GRAM = 200, 24
#: Bytes of segments that are indexed at once; segments of one anchor stay together.
INDEX_BYTES = 1 << 20
#: From this many different segments on, an anchor's windows are dealt one by one.
HOT_SEGMENTS = 256
REPEATS, SHIP, HOT = 1, 2, 4
_SPREAD = 0x5851F42D4C957F2D
_LOCAL = 18  # bits for a place within a piece; the other bits of an anchor's rank are its hash


def pieces(offsets: np.ndarray):
    """Stretches of window starts. A text's stretches do not depend on the texts around it, so a block
    has the same segments in whatever order its texts arrive."""
    at, texts = 0, len(offsets) - 1
    while at < texts:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + A.PIECE, "right")) - 1)
        if stop == at + 1:
            for begin in range(int(offsets[at]), int(offsets[stop]), A.PIECE):
                yield begin, min(begin + A.PIECE, int(offsets[stop]))
        else:
            yield int(offsets[at]), int(offsets[stop])
        at = stop


def segments(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH, gram: int = GRAM):
    """First window, number of windows and anchor hash of every segment, in text order."""
    starts, counts, anchors = [], [], []
    span = width - gram + 1  # substrings in a window
    low = np.maximum(offsets[:-1], offsets[1:] - width + 1)  # from here a text has no whole window
    for at, stop in pieces(offsets):
        stop = min(stop, len(data) - width + 1)
        if stop <= at:
            continue
        piece = data[at:stop + width - 1].astype(np.uint64) + np.uint64(1)
        up, down = A.powers(len(piece))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(piece * up)])
        n = len(piece) - gram + 1
        hashes = A.mix((sums[gram:] - sums[:n]) * down[:n])
        rank = (hashes & ~np.uint64((1 << _LOCAL) - 1)) | np.arange(n, dtype=np.uint64)
        length = 1
        while length * 2 <= span:
            rank = np.minimum(rank[:-length], rank[length:])
            length *= 2
        if length < span:
            rank = np.minimum(rank[:len(rank) - (span - length)], rank[span - length:])
        place = (rank & np.uint64((1 << _LOCAL) - 1)).astype(np.int64)
        # windows that run over the end of their text do not count
        closed = np.zeros(stop - at + 1, np.int32)
        near = slice(np.searchsorted(offsets[1:], at, "left"), np.searchsorted(low, stop, "left"))
        lo, hi = np.clip(low[near], at, stop) - at, np.clip(offsets[1:][near], at, stop) - at
        np.add.at(closed, lo, 1)
        np.add.at(closed, hi, -1)
        open_ = np.flatnonzero(np.cumsum(closed[:-1]) == 0)
        if not len(open_):
            continue
        here = place[open_]
        new = np.ones(len(open_), bool)
        new[1:] = (here[1:] != here[:-1]) | (open_[1:] != open_[:-1] + 1)
        first = np.flatnonzero(new)
        starts.append(open_[first] + at)
        counts.append(np.diff(np.append(first, len(open_))))
        # minima are small; mixed again they spread evenly over the buckets
        anchors.append(A.mix(hashes[here[first]] ^ np.uint64(_SPREAD)))
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(counts), np.concatenate(anchors)


class RunIndex:
    """Run-length compressed Burrows-Wheeler transform of a collection of strings.

    `heads` and `lengths` are the runs; `first` and `last` sample the text position of each run's two
    ends. Ends of strings are separators of their own, smaller than any byte, in the strings' order.
    """

    def __init__(self, data: np.ndarray, lengths: np.ndarray):
        self.data = data
        self.begin = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        self.end = np.repeat(self.begin + lengths, lengths)  # of the string that holds each position
        self.string = np.repeat(np.arange(len(lengths)), lengths)
        self.packed = self._pack()
        suffixes = self._suffixes(int(lengths.max(initial=0)))
        # the symbol before each suffix; strings' first positions have separators, all different
        before = np.empty(len(data), np.int64)
        if len(data):
            before[1:] = data[:-1]
            before[self.begin[lengths > 0]] = -1 - np.arange(int((lengths > 0).sum()))
        bwt = before[suffixes]
        new = np.ones(len(bwt), bool)
        new[1:] = bwt[1:] != bwt[:-1]
        at = np.flatnonzero(new)
        stop = np.append(at[1:], len(bwt)) - 1 if len(at) else at
        self.heads, self.lengths = bwt[at], stop - at + 1
        self.first, self.last = suffixes[at], suffixes[stop]

    def _pack(self) -> np.ndarray:
        """The next seven symbols of each position in one integer; 0 beyond the string's end."""
        n = len(self.data)
        symbols = np.zeros(n + 7, np.int64)
        symbols[:n] = self.data
        symbols[:n] += 1
        place = np.arange(n)
        packed = np.zeros(n, np.int64)
        for k in range(7):
            packed = (packed << 9) | np.where(place + k < self.end, symbols[k:n + k], 0)
        return packed

    def _suffixes(self, longest: int) -> np.ndarray:
        """Suffix array by prefix doubling."""
        n = len(self.data)
        strings = int(self.string[-1]) + 1 if n else 0
        order, starts, rank = A.groups_of(self.packed)
        known = 7
        while len(starts) < n and known < 2 * longest + 7:
            ahead = np.arange(n) + known
            inside = ahead < self.end
            # beyond the end: the string's own separator
            second = np.where(inside, strings + rank[np.minimum(ahead, n - 1)], self.string)
            order, starts, rank = A.groups_of(rank * np.int64(n + strings + 1) + second)
            known *= 2
        return order

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common string at positions a and b."""
        n = len(self.data)
        room = np.minimum(self.end[a] - a, self.end[b] - b)
        length = np.zeros(len(a), np.int64)
        live = np.flatnonzero(room > 0)
        while len(live):
            x = self.packed[np.minimum(a[live] + length[live], n - 1)]
            y = self.packed[np.minimum(b[live] + length[live], n - 1)]
            same = x == y
            stay = live[~same]
            if len(stay):  # the first of seven symbols that differs
                diff = (x ^ y)[~same]
                length[stay] += sum((diff >> (9 * k) == 0).astype(np.int64) for k in range(1, 7))
            live = live[same]
            length[live] += 7
            live = live[length[live] < room[live]]
        return np.minimum(length, room)

    def matching_statistics(self) -> np.ndarray:
        """For each position the length of the longest string that starts here and elsewhere.

        In suffix order a position's neighbour shares the most with it. Along the text a match with a
        neighbour shrinks by one per step until a run of the transform begins (or ends): only there is
        it compared anew. So the samples are enough, and the stream carries the reach of the match.
        """
        n = len(self.data)
        reach = np.zeros(n, np.int64)
        place = np.arange(n)
        for samples, skip, neighbours in ((self.first, 0, self.last), (self.last, -1, self.first)):
            # the first suffix has no neighbour before it, the last none after it
            ends = samples[1:] if skip == 0 else samples[:-1]
            others = neighbours[:-1] if skip == 0 else neighbours[1:]
            sampled = np.zeros(n, bool)
            sampled[samples] = True
            carried = np.zeros(n, np.int64)
            carried[ends] = ends + self._common(ends, others)
            latest = np.maximum.accumulate(np.where(sampled, place, 0))
            reach = np.maximum(reach, carried[latest])
        return np.maximum(reach - place, 0)


class Block:
    """Texts of a block with their distinct (anchor, segment) pairs in the order of the question."""

    def __init__(self, docs: pa.Table, buckets: int, width: int):
        self.width = width
        self.data, self.offsets = A.buffer_of(docs.column("data"))
        self.start, self.windows, anchor = segments(self.data, self.offsets, width)
        raw = memoryview(np.ascontiguousarray(self.data))
        stops = self.start + self.windows + width - 1
        hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, (raw[a:b] for a, b in zip(self.start.tolist(), stops.tolist()))),
                             np.uint64, len(self.start))
        order, starts, self.pair = A.groups_of(anchor, hashed)
        pick = order[starts]  # one segment stands for each pair
        self.pick, self.anchor, self.hashed = pick, anchor[pick], hashed[pick]
        self.counts = np.bincount(self.pair, minlength=len(pick)).astype(np.int64)
        self.cuts = A.range_cuts(self.anchor, buckets)

    def shipped(self, status: np.ndarray, hot: bool) -> np.ndarray:
        """Pairs that are sent on: as text, or as window hashes."""
        return np.flatnonzero((status & SHIP > 0) & ((status & HOT > 0) == hot))

    def text_of(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs' segments one after the other, and their lengths."""
        begin = self.start[self.pick[pairs]]
        lengths = self.windows[self.pick[pairs]] + self.width - 1
        return self.data[ranges(begin, lengths)], lengths

    def window_hashes(self, pairs: np.ndarray) -> np.ndarray:
        """Hash of each window of the pairs."""
        raw = memoryview(np.ascontiguousarray(self.data))
        at = ranges(self.start[self.pick[pairs]], self.windows[self.pick[pairs]]).tolist()
        return np.fromiter((xxhash.xxh3_64_intdigest(raw[a:a + self.width]) for a in at), np.uint64, len(at))


def ranges(begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges begin … begin + length - 1, one after the other."""
    stops = np.cumsum(lengths)
    return np.arange(stops[-1] if len(stops) else 0) + np.repeat(begin - (stops - lengths), lengths)


def ask(buckets: int, width: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table) -> pa.Table:
        b = Block(docs, buckets, width)
        parts = [slice(b.cuts[i], b.cuts[i + 1]) for i in range(buckets)]
        return pa.table({"bucket": pa.array(range(buckets), pa.int32()),
                         "block": pa.array([key[0].as_py()] * buckets, pa.int32()),
                         "anchors": A.binary(b.anchor[p] for p in parts),
                         "hashes": A.binary(b.hashed[p] for p in parts),
                         "counts": A.binary(b.counts[p] for p in parts)})
    return run


ASKED = "bucket int, block int, anchors binary, hashes binary, counts binary"


def gathered(column: pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Packed values of all rows, and where each row begins."""
    parts = [np.frombuffer(x, dtype) for x in column.to_pylist()]
    return np.concatenate(parts), np.cumsum([0] + [len(p) for p in parts])


def answer(hot_segments: int):
    def run(asked: pa.Table) -> pa.Table:
        """REPEATS, SHIP and HOT of every pair; SHIP goes to the first block that has the pair."""
        anchors, cuts = gathered(asked.column("anchors"), np.uint64)
        hashes, _ = gathered(asked.column("hashes"), np.uint64)
        counts, _ = gathered(asked.column("counts"), np.int64)
        block = np.repeat(asked.column("block").to_numpy(), np.diff(cuts))
        status = np.zeros(len(anchors), np.uint8)
        if len(anchors):
            order, starts, pair = A.groups_of(anchors, hashes)
            total = np.add.reduceat(counts[order], starts)
            by_anchor, first, anchor = A.groups_of(anchors[order[starts]])
            different = np.diff(np.append(first, len(starts)))[anchor]
            holder = np.lexsort((block, pair))
            chosen = np.zeros(len(anchors), bool)
            chosen[holder[starts]] = True
            status |= np.where(total[pair] > 1, REPEATS, 0).astype(np.uint8)
            status |= np.where(chosen & (different[pair] > 1), SHIP, 0).astype(np.uint8)
            status |= np.where(different[pair] > hot_segments, HOT, 0).astype(np.uint8)
        n = asked.num_rows
        return pa.table({"block": asked.column("block").cast(pa.int32()), "bucket": asked.column("bucket").cast(pa.int32()),
                         "kind": pa.array([0] * n, pa.int32()),
                         "payload": A.binary(status[cuts[i]:cuts[i + 1]] for i in range(n)), "more": pa.array([b""] * n, pa.binary())})
    return run


ANSWERED = "block int, bucket int, kind int, payload binary, more binary"


def replies(answers: pa.Table, kind: int, buckets: int, name: str = "payload") -> list[bytes]:
    """Payload of each bucket, in order."""
    out = [b""] * buckets
    for bucket, k, payload in zip(*(answers.column(c).to_pylist() for c in ("bucket", "kind", name))):
        if k == kind:
            out[bucket] = payload
    return out


def ship(buckets: int, width: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        """Segments by their anchor's bucket, and hashes of hot windows by their own."""
        b = Block(docs, buckets, width)
        status = np.frombuffer(b"".join(replies(answers, 0, buckets)), np.uint8)
        plain, hot = b.shipped(status, False), b.shipped(status, True)
        cuts = np.searchsorted(plain, b.cuts)
        keys = np.sort(b.window_hashes(hot))
        key_cuts = A.range_cuts(keys, buckets)
        out: dict[str, list] = {"bucket": [], "anchors": [], "lengths": [], "data": [], "keys": []}
        for i in range(buckets):
            pairs = plain[cuts[i]:cuts[i + 1]]
            own = keys[key_cuts[i]:key_cuts[i + 1]]
            if not len(pairs) and not len(own):
                continue
            data, lengths = b.text_of(pairs)
            for name, value in (("bucket", i), ("anchors", b.anchor[pairs]), ("lengths", lengths), ("data", data),
                                ("keys", own)):
                out[name].append(value)
        block = answers.column("block")[0].as_py() if answers.num_rows else -1
        return pa.table({"bucket": pa.array(out["bucket"], pa.int32()),
                         "block": pa.array([block] * len(out["bucket"]), pa.int32()),
                         **{n: A.binary(out[n]) for n in ("anchors", "lengths", "data", "keys")}})
    return run


SHIPPED = "bucket int, block int, anchors binary, lengths binary, data binary, keys binary"


def collections(anchors: np.ndarray, lengths: np.ndarray):
    """Segments in sets of about INDEX_BYTES; segments of one anchor are in one set."""
    order = np.argsort(anchors, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = anchors[order][1:] != anchors[order][:-1]
    size = np.cumsum(lengths[order])
    # the set of an anchor follows from the bytes before its first segment
    before = (size - lengths[order])[np.flatnonzero(new)] // INDEX_BYTES
    number = before[np.cumsum(new) - 1] if len(order) else size
    for a, z in zip(np.flatnonzero(np.diff(number, prepend=-1)), np.append(np.flatnonzero(np.diff(number)) + 1, len(order))):
        yield order[a:z]


def match(width: int):
    def run(shipped: pa.Table) -> pa.Table:
        """Marks of all windows of the shipped segments, and of the shipped hot windows."""
        lengths, cuts = gathered(shipped.column("lengths"), np.int64)
        data, _ = gathered(shipped.column("data"), np.uint8)
        anchors, _ = gathered(shipped.column("anchors"), np.uint64)
        begin = np.cumsum(lengths) - lengths
        windows = np.concatenate([[0], np.cumsum(lengths - width + 1)])
        marked = np.zeros(windows[-1], bool)
        for some in collections(anchors, lengths):
            own = lengths[some]
            reach = RunIndex(data[ranges(begin[some], own)], own).matching_statistics()
            local = np.cumsum(own) - own
            marked[ranges(windows[:-1][some], own - width + 1)] = reach[ranges(local, own - width + 1)] >= width
        keys, key_cuts = gathered(shipped.column("keys"), np.uint64)
        _, starts, group = A.groups_of(keys)
        twice = np.bincount(group, minlength=len(starts))[group] > 1 if len(keys) else np.zeros(0, bool)
        n = shipped.num_rows
        return pa.table({
            "block": shipped.column("block").cast(pa.int32()), "bucket": shipped.column("bucket").cast(pa.int32()),
            "kind": pa.array([1] * n, pa.int32()),
            "payload": A.binary(np.packbits(marked[windows[cuts[i]]:windows[cuts[i + 1]]]) for i in range(n)),
            "more": A.binary(np.packbits(twice[key_cuts[i]:key_cuts[i + 1]]) for i in range(n))})
    return run


def repeated_starts(b: Block, answers: pa.Table, buckets: int) -> np.ndarray:
    """Start of every window of the block that also occurs elsewhere, ascending."""
    status = np.frombuffer(b"".join(replies(answers, 0, buckets)), np.uint8)
    whole = (status & REPEATS > 0)[b.pair] if len(status) else np.zeros(0, bool)
    found = [ranges(b.start[whole], b.windows[whole])]
    plain, hot = b.shipped(status, False), b.shipped(status, True)
    cuts = np.searchsorted(plain, b.cuts)
    marks, more = replies(answers, 1, buckets), replies(answers, 1, buckets, "more")
    for i in range(buckets):
        pairs = plain[cuts[i]:cuts[i + 1]]
        if len(pairs):
            at = ranges(b.start[b.pick[pairs]], b.windows[b.pick[pairs]])
            bits = np.unpackbits(np.frombuffer(marks[i], np.uint8), count=len(at)).astype(bool)
            found.append(at[bits])
    if len(hot):
        at = ranges(b.start[b.pick[hot]], b.windows[b.pick[hot]])
        keys = b.window_hashes(hot)
        order = np.argsort(keys, kind="stable")
        key_cuts = A.range_cuts(keys[order], buckets)
        for i in range(buckets):
            own = order[key_cuts[i]:key_cuts[i + 1]]
            if len(own):
                found.append(at[own[np.unpackbits(np.frombuffer(more[i], np.uint8), count=len(own)).astype(bool)]])
    return np.sort(np.concatenate(found))


def cut(buckets: int, width: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        b = Block(docs, buckets, width)
        at = repeated_starts(b, answers, buckets)
        doc = np.searchsorted(b.offsets, at, "right") - 1
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] > at[:-1] + width) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        begin, text = at[first], doc[first]
        end = at[np.append(first[1:], len(at)) - 1] + width if len(at) else begin
        texts = docs.num_rows
        spans = np.bincount(text, minlength=texts)
        removed = np.bincount(text, weights=end - begin, minlength=texts).astype(np.int64)
        own = np.searchsorted(text, np.arange(texts + 1))
        digest, kept = [], []
        for i in range(texts):
            body = b.data[b.offsets[i]:b.offsets[i + 1]]
            cuts = [(x - b.offsets[i], y - b.offsets[i]) for x, y in zip(begin[own[i]:own[i + 1]], end[own[i]:own[i + 1]])]
            digest.append(hashlib.sha256(without(body, cuts)).hexdigest())
            kept.append(without(body, [whole_characters(body, x, y) for x, y in cuts]))
        return pa.table({
            "row": A.nullable(docs.column("row")), "n_bytes": pa.array(np.diff(b.offsets)),
            "n_removed": pa.array(removed), "n_spans": pa.array(spans.astype(np.int64)),
            "kept_sha256": pa.array(digest, pa.string()), "kept": pa.array(kept, pa.binary())})
    return run


def without(body: np.ndarray, cuts: list) -> bytes:
    """Bytes outside the cuts, which ascend."""
    parts, at = [], 0
    for x, y in cuts:
        parts.append(body[at:x].tobytes())
        at = max(at, y)
    return b"".join(parts) + body[at:].tobytes()


def whole_characters(body: np.ndarray, x: int, y: int) -> tuple[int, int]:
    """The part of a cut that takes whole characters only."""
    while x < y and body[x] & 0xC0 == 0x80:
        x += 1
    while y > x and y < len(body) and body[y] & 0xC0 == 0x80:
        y -= 1
    return x, y


def remove_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text: str = "text",
                   block_bytes: int | None = None, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """Cut every string of `width` bytes that starts twice or more in the corpus, all copies of it.

    Returns row (all columns but the text), n_bytes, n_removed, n_spans, kept_sha256 (of the bytes
    left) and kept: the text left, in which a character stays unless all of its bytes go. Null texts
    are empty; texts shorter than `width` are never cut; repeated rows are copies of each other, also
    with equal ids or none. An empty table gives no rows. Extra columns of any name travel inside
    `row`. A very long text is a block on its own and is read in pieces.
    """
    blocks = count_blocks(docs, text, block_bytes)
    dealt = in_blocks(docs, blocks, id_col, text)
    row = dealt.schema["row"].dataType.simpleString()
    asked = dealt.groupBy("block").applyInArrow(ask(blocks, width), ASKED)
    counted = asked.groupBy("bucket").applyInArrow(answer(hot_segments), ANSWERED)
    shipped = dealt.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(ship(blocks, width), SHIPPED)
    matched = shipped.groupBy("bucket").applyInArrow(match(width), ANSWERED)
    return dealt.groupBy("block").cogroup(counted.unionByName(matched).groupBy("block")).applyInArrow(
        cut(blocks, width),
        f"row {row}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document after all strings of 200 bytes that repeat are cut."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select(F.col("row.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
