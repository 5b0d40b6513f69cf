"""Array helpers for tasks that read whole texts as bytes: words, rolling hashes, packed columns."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes between words: space and the controls 9 to 13. All other bytes belong to words.
SPACES = b" \t\n\x0b\x0c\r"
WORD = np.ones(256, bool)
WORD[list(SPACES)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPACE = re.compile(rb"[\x20\x09-\x0D]")

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Rolling hashes are taken over pieces of this many bytes, so that temporaries stay small.
PIECE = 1 << 17
#: Bytes of the spans that are hashed by array steps, and masks of the first 0 … 8 bytes of a number.
SHORT = 64
_FIRST = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2^64."""
    size = max(PIECE + 4096, 1 << max(n - 1, 1).bit_length())
    if size not in _powers:
        _powers.clear()
        both = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps))
        _powers[size] = tuple(both)
    up, down = _powers[size]
    return up[:n], down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the ordered pair of two hashes."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + b + np.uint64(0x632BE59BD9B4E019))


def pieces(text: bytes, size: int = 1 << 20):
    """The text cut at white space after every `size` bytes or more, so that lists of words stay small."""
    at = 0
    while len(text) - at > size:
        found = _SPACE.search(text, at + size)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def buffer_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values one after the other, and where each begins (one more entry than values)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):  # combine_chunks() of an empty column in some versions
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1] \
        if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the first word of each text (one more entry than texts).

    A word is a run of bytes that are not in SPACES; texts that touch do not share a word.
    """
    inside = WORD[data]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[cuts - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for spans in ascending order; equal bytes give equal hashes.

    Short spans take eight bytes a step, each mixed into all that came before; longer ones are XXH3 of their bytes.
    """
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        first = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, first + PIECE, "right")))
        piece = np.concatenate([data[first:ends[stop - 1]], np.zeros(8, np.uint8)])
        eights = np.ndarray(len(piece) - 7, "<u8", piece, strides=(1,))  # the eight bytes from each place on
        place, left = starts[at:stop] - first, ends[at:stop] - starts[at:stop]
        found = mix(left.astype(np.uint64) + np.uint64(_BASE))
        long = np.flatnonzero(left > SHORT)
        for i in long:
            found[i] = xxhash.xxh3_64_intdigest(piece[place[i]:place[i] + left[i]])
        rest = np.flatnonzero((left > 0) & (left <= SHORT))
        for step in range(0, SHORT, 8):
            taken = np.minimum(left[rest] - step, 8)
            found[rest] = mix(found[rest] ^ (eights[place[rest] + step] & _FIRST[taken]))
            rest = rest[taken == 8]
            rest = rest[left[rest] > step + 8]
            if not len(rest):
                break
        out[at:stop] = found
        at = stop
    return out


def groups_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort order by keys (the first counts most), start of each group in it, group of each row."""
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        ranked = key[order]
        new[1:] |= ranked[1:] != ranked[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), group


def binary(parts) -> pa.Array:
    """Binary column of arrays' bytes."""
    return pa.array([np.ascontiguousarray(p).tobytes() for p in parts], pa.binary())


def pack_sorted(keys: np.ndarray) -> np.ndarray:
    """Bytes of ascending 64-bit hashes by place: the high ones hardly change, so they compress."""
    return np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8).T)


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).reshape(-1)


def pack_counts(counts: np.ndarray) -> np.ndarray:
    """Whole numbers in the fewest bytes that hold all of them; the first byte tells how many."""
    top = int(counts.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w))
    return np.concatenate([np.array([width], np.uint8), counts.astype(f"<u{width}").view(np.uint8)])


def unpack_counts(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def nullable(column):
    """The column with a type whose nested fields may all be null, as declared schemas have them."""
    def loose(kind):
        if pa.types.is_struct(kind):
            return pa.struct([pa.field(f.name, loose(f.type)) for f in kind])
        if pa.types.is_map(kind):
            return pa.map_(loose(kind.key_type), loose(kind.item_type))
        if pa.types.is_list(kind):
            return pa.list_(loose(kind.value_type))
        return kind
    return column.cast(loose(column.type))


def range_cuts(ordered: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of `buckets` equal ranges of 64-bit hashes begins in ascending hashes (one more entry)."""
    bounds = np.array([(i << 64) // buckets for i in range(buckets)], np.uint64)
    return np.append(np.searchsorted(ordered, bounds), len(ordered))
