"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A text is cut by the tokenizer's pattern; each piece is merged on its own. The tree's leaves are the
piece's byte positions and hold the rank of the pair that starts there (a live token and its live
right neighbour); a node holds the smallest rank below it, the leftmost of equals. A merge takes the
root, joins two neighbours in a linked list and updates at most three leaves, so a piece of n bytes
takes O(n log n) however long it is. A word of a few bytes needs no tree: its pairs are a short list.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.base import query, table
from corpusloom.llm.blocks import share, shared_thing, text_bytes

#: Pieces of up to so many bytes are merged in a list; of more bytes than the second, in packed arrays.
SHORT_PIECE, LONG_PIECE = 64, 1 << 14
#: Pieces of up to so many bytes are remembered, twice so many at most at a time.
REMEMBERED_BYTES, REMEMBERED = 64, 200_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece."""
    get = ranks.get
    whole = get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n <= SHORT_PIECE:
        return merge_short_piece(piece, ranks)
    if n > LONG_PIECE:
        return merge_long_piece(piece, ranks)
    none = len(ranks) << 32
    size = 1 << (n - 1).bit_length()
    following = list(range(1, n + 1))  # start of the next live token; n is the end
    previous = list(range(-1, n - 1))
    # a leaf is rank and position in one number, so that the smallest is the leftmost of the best
    tree = [none] * (2 * size)
    for i in range(n - 1):
        rank = get(piece[i:i + 2])
        if rank is not None:
            tree[size + i] = rank << 32 | i
    for node in range(size - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left <= right else right
    best = tree[1]
    while best < none:
        i = best & 0xFFFFFFFF
        j = following[i]
        k = following[j]
        following[i] = k
        # the right token is gone; the merged one and the one before it have new pairs
        updates = [(j, none)]
        if k < n:
            previous[k] = i
            rank = get(piece[i:following[k]])
            updates.append((i, none if rank is None else rank << 32 | i))
        else:
            updates.append((i, none))
        h = previous[i]
        if h >= 0:
            rank = get(piece[h:k])
            updates.append((h, none if rank is None else rank << 32 | h))
        for leaf, value in updates:
            node = size + leaf
            tree[node] = value
            while node > 1:
                other = tree[node ^ 1]
                if other < value:
                    value = other
                node >>= 1
                if tree[node] == value:
                    break
                tree[node] = value
        best = tree[1]
    out, i = [], 0
    while i < n:
        k = following[i]
        out.append(ranks[piece[i:k]])
        i = k
    return out


def merge_short_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for a piece of few bytes that is no token: the ranks of its pairs are one short list, whose
    smallest, the leftmost of equals, is found sooner than a tree is built."""
    get, none = ranks.get, 1 << 32
    parts = [piece[i:i + 1] for i in range(len(piece))]
    pairs = [get(piece[i:i + 2], none) for i in range(len(piece) - 1)]
    while (best := min(pairs, default=none)) < none:
        i = pairs.index(best)
        token = parts[i] + parts.pop(i + 1)
        parts[i] = token
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(token + parts[i + 1], none)
        if i:
            pairs[i - 1] = get(parts[i - 1] + token, none)
    return [ranks[part] for part in parts]


def merge_long_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for a piece of many bytes, in about 20 bytes of memory for each: the tree holds ranks
    only, and the leftmost best leaf is found on the way down from the root."""
    get, n = ranks.get, len(piece)
    none = max(ranks.values()) + 1
    size = 1 << (n - 1).bit_length()
    data = np.frombuffer(piece, np.uint8)
    pairs = np.full((256, 256), none, np.int32)
    for token, rank in ranks.items():
        if len(token) == 2:
            pairs[token[0], token[1]] = rank
    # nodes, then the leaves of the positions that there are; all other leaves would never be the best
    nodes = np.full(size + n + 1, none, np.int32)
    nodes[size:size + n - 1] = pairs[data[:-1], data[1:]]
    level, width = size, n + 1
    while level > 1:
        width = (width + 1) // 2
        low = nodes[level:min(2 * level, len(nodes))][:2 * width]
        low = np.append(low, np.full(2 * width - len(low), none, np.int32))
        level //= 2
        nodes[level:level + min(width, level)] = low.reshape(-1, 2).min(1)[:level]
    tree = array("i", nodes.tobytes())
    last = len(tree) - 1
    del nodes
    following, previous = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
    while (best := tree[1]) < none:
        node = 1
        while node < size:
            node *= 2
            node += tree[node] != best
        i = node - size
        j = following[i]
        k = following[j]
        following[i] = k
        if k < n:
            previous[k] = i
        h = previous[i]
        for leaf, value in ((j, none), (i, get(piece[i:following[k]], none) if k < n else none),
                            (h, get(piece[h:k], none) if h >= 0 else none)):
            if leaf < 0:
                continue
            node = size + leaf
            tree[node] = value
            while node > 1:
                other = tree[node ^ 1] if node ^ 1 <= last else none
                if other < value:
                    value = other
                node >>= 1
                if tree[node] == value:
                    break
                tree[node] = value
    out, i = [], 0
    while i < n:
        k = following[i]
        out.append(ranks[piece[i:k]])
        i = k
    return out


class _Pieces(dict):
    """Packed ids of pieces that were seen. Full memories become the older half, which is asked before
    a piece is merged again, and the half before that is forgotten."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.older = ranks, {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            data = piece.encode()
            ids = merge_piece(data, self.ranks)
            packed = struct.pack(f"<{len(ids)}I", *ids)
            if len(data) > REMEMBERED_BYTES:
                return packed
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[piece] = packed
        return packed


class Codec:
    """Encoder and decoder for one set of ranks and one pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pieces = _Pieces(ranks)
        self.pattern = regex.compile(pattern)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. Long texts are cut in bounded steps."""
        if len(text) <= 1 << 20:
            return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))
        parts, some = [], []
        for match in self.pattern.finditer(text):
            some.append(match.group())
            if len(some) == 1 << 16:
                parts.append(b"".join(map(self.pieces.__getitem__, some)))
                some.clear()
        return b"".join(parts) + b"".join(map(self.pieces.__getitem__, some))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def encoder(shared, keep_ids: bool) -> Callable:
    """`shared` is a Codec; a worker keeps it, and what it remembers, for later tasks."""
    def run(batches):
        codec = shared_thing(shared)
        for batch in batches:
            counts, ids, decoded, packed_ids = [], [], [], []
            for text in batch.column("data").to_pylist():
                # bytes that are no UTF-8 become U+FFFD, as in a reader of strings
                packed = codec.encode(text.decode("utf-8", "replace"))
                counts.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(packed)).hexdigest())
                if keep_ids:
                    packed_ids.append(np.frombuffer(packed, "<u4").astype(np.int32))
            columns = {"row": batch.column("row"), "n_tokens": pa.array(counts, pa.int64()),
                       "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
            if keep_ids:
                columns["ids"] = pa.array(packed_ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)
    return run


def encode_texts(docs: DataFrame, path: str, pattern: str, keep_ids: bool = True, text: str = "text") -> DataFrame:
    """Encode every whole text by the rank file at `path`, then decode the ids again.

    Returns row (all columns but the text), n_tokens, ids_sha256, decoded_sha256 and, on request, ids.
    Null and empty texts have no tokens. Repeated rows are encoded like any other; an empty table gives
    no rows; extra columns of any name travel inside `row`. The ranks, whose size is that of the
    vocabulary, are read on the driver and broadcast.
    """
    spark = docs.sparkSession
    shared = share(spark, Codec(load_ranks(path), pattern))
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    rows = docs.select(F.struct(*rest).alias("row"), text_bytes(F.col(text)).alias("data"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(encoder(shared, keep_ids), schema + (", ids array<int>" if keep_ids else ""))


def decode_ids(encoded: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """Texts of the column `ids`; null ids give a null text, unknown ids are an error."""
    tokens = encoded.sparkSession.sparkContext.broadcast({r: t for t, r in load_ranks(path).items()})
    schema = encoded.drop(ids).withColumn(out, F.lit("").cast("string")).schema

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            texts = [None if x is None else b"".join(tokens.value[i] for i in x).decode("utf-8", "replace")
                     for x in batch.column(at).to_pylist()]
            yield batch.remove_column(at).append_column(out, pa.array(texts, pa.string()))
    return encoded.mapInArrow(run, schema)


def public_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """Path and pattern of an installed public tokenizer."""
    import public_tokenizers
    return public_tokenizers.path(name), public_tokenizers.PATTERN


@query("op4_byte_bpe")
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded bytes for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_texts(docs, *public_vocabulary(), keep_ids=False).select(
        F.col("row.doc_id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")
