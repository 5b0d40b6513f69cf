"""Suffix and SimHash duplicates against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from odd import no_docs, odd_docs, rows, texts
from pyspark.sql import functions as F

from corpusloom.llm import simhash_dedup, suffix_dedup


def repeats(parts: list[bytes], width: int) -> list[tuple]:
    """(n_bytes, n_removed, n_spans, sha256 of the rest) by counting all strings of the width."""
    seen = Counter(t[i:i + width] for t in parts for i in range(len(t) - width + 1))
    out = []
    for t in parts:
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if seen[t[i:i + width]] > 1:
                gone[i:i + width] = b"\x01" * width
        rest = bytes(x for x, g in zip(t, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [256, 0])
@pytest.mark.parametrize("block_bytes", [None, 2000])
def test_repeats_of_odd_documents(spark, hot, block_bytes):
    found = suffix_dedup.remove_repeats(odd_docs(spark), hot_segments=hot, block_bytes=block_bytes).collect()
    expected = Counter(zip([r[0] for r in rows()], repeats(texts(), 200)))
    assert Counter((r.row.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in found) == expected
    assert all(r.row.kept == "own kept" and r.kept.decode() is not None for r in found)


def test_repeats_of_nothing(spark):
    assert suffix_dedup.remove_repeats(no_docs(spark)).count() == 0


def test_narrow_windows_and_small_collections(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "INDEX_BYTES", 500)
    draw = random.Random(3)
    base = [bytes(draw.choice(b"ab") for _ in range(400)) for _ in range(6)]
    parts = [b"".join(draw.choice(base)[a:a + draw.randrange(20, 200)] for a in draw.sample(range(200), 4)) for _ in range(40)]
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(parts)], "doc_id bigint, text string")
    found = {r.row.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
             for r in suffix_dedup.remove_repeats(docs, width=60).collect()}
    assert found == dict(enumerate(repeats(parts, 60)))


def test_segments_do_not_depend_on_the_order_of_texts(monkeypatch):
    monkeypatch.setattr(suffix_dedup.A, "PIECE", 1000)
    draw = random.Random(8)
    parts = [bytes(draw.choice(b"abcd") for _ in range(draw.choice([0, 90, 300, 5000]))) for _ in range(30)]

    def cut(order):
        data = np.frombuffer(b"".join(parts[i] for i in order), np.uint8)
        offsets = np.cumsum([0] + [len(parts[i]) for i in order])
        starts, counts, anchors = suffix_dedup.segments(data, offsets, 60, 16)
        assert counts.sum() == sum(max(0, len(p) - 59) for p in parts)
        return Counter((data[s:s + n + 59].tobytes(), int(a)) for s, n, a in zip(starts, counts, anchors))
    first = cut(range(30))
    for _ in range(5):
        assert cut(draw.sample(range(30), 30)) == first


def test_index_statistics_equal_brute_force():
    draw = random.Random(1)
    for trial in range(60):
        alphabet = b"ab\x00\xff" if trial % 2 else b"a"
        parts = [bytes(draw.choice(alphabet) for _ in range(draw.randint(1, 40))) for _ in range(draw.randint(1, 6))]
        data = np.frombuffer(b"".join(parts), np.uint8)
        index = suffix_dedup.RunIndex(data, np.array([len(p) for p in parts]))
        assert index.lengths.sum() == len(data) and (np.diff(index.heads) != 0).all()
        places = [(s, p) for s, part in enumerate(parts) for p in range(len(part))]

        def common(a, b):
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            return n
        for (s, p), value in zip(places, index.matching_statistics()):
            assert value == max([0, *(common(parts[s][p:], parts[t][q:]) for t, q in places if (s, p) != (t, q))])


def simhash(text: bytes) -> int:
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in text).split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints: list[int], ids: list) -> list:
    """Smallest id reachable by links of at most three bits."""
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    least: dict = {}
    for i, value in enumerate(ids):
        if value is not None:
            least[root(i)] = min(value, least.get(root(i), value))
    return [least.get(root(i)) for i in range(len(ids))]


@pytest.mark.parametrize("limit", [2048, 2])
def test_near_copies_of_odd_documents(spark, limit):
    found = simhash_dedup.near_duplicates(odd_docs(spark), limit=limit).collect()
    prints, ids = [simhash(t) for t in texts()], [r[0] for r in rows()]
    expected = Counter(zip(ids, (f"{p:016x}" for p in prints), groups(prints, ids)))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in found) == expected
    assert simhash_dedup.near_duplicates(no_docs(spark)).count() == 0


def test_links_connect_chains_and_dense_groups(spark):
    draw = random.Random(5)
    prints, base = [], draw.getrandbits(64)
    for _ in range(40):  # a chain of steps of three bits
        prints.append(base)
        for bit in draw.sample(range(64), 3):
            base ^= 1 << bit
    centre = draw.getrandbits(64)
    prints += [centre ^ (1 << a) for a in range(64)] + [draw.getrandbits(64) for _ in range(50)]
    nodes = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp bigint").distinct()
    roots = {r.fp % (1 << 64): r.root for r in simhash_dedup.components(simhash_dedup.near_links(nodes, 8)).collect()}
    expected = groups(prints, list(range(len(prints))))
    found = [roots.get(p, p - (1 << 64) if p >> 63 else p) for p in prints]
    assert len(set(found)) == len(set(expected)) == len(set(zip(found, expected)))


def test_one_document_of_each_group_stays(spark):
    kept = simhash_dedup.keep_first(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[1] == 1 and ids[2] == 0 and ids[14] == 1 and ids[4] == 1 and ids[5] == ids[6] == 0 and ids[None] == 3
    assert simhash_dedup.keep_first(no_docs(spark)).count() == 0
    assert kept.filter(F.col("component_id") == "own component_id").count() == kept.count()
