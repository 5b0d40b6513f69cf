"""Encoding, language model, quality rules and grades against brute force."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from odd import no_docs, odd_docs, prose, rows, texts
from pyspark.sql import functions as F

from corpusloom.llm import byte_bpe, grade_model, lm_score, quality_rules

PATH, PATTERN = byte_bpe.public_vocabulary()


def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(PATH), special_tokens={})


def test_ids_equal_the_library_and_decode(spark):
    found = byte_bpe.encode_texts(odd_docs(spark), PATH, PATTERN)
    encoding = library()
    expected = Counter()
    for r, text in zip(rows(), texts()):
        ids = encoding.encode_ordinary(text.decode())
        expected[r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text).hexdigest()] += 1
    assert Counter((r.row.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found.collect()) == expected
    back = byte_bpe.decode_ids(found.select("row.doc_id", "ids"), PATH)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r[0], r[1] or "") for r in rows())
    assert byte_bpe.encode_texts(no_docs(spark), PATH, PATTERN).count() == 0


def test_random_and_long_pieces():
    codec, encoding, draw = byte_bpe.Codec(byte_bpe.load_ranks(PATH), PATTERN), library(), random.Random(0)
    alphabet = "abcdefghijklmnopqrstuvwxyz  \n\t'sÉñßéü中\U0001F600\x1c\x85 1234%$|."
    samples = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 200))) for _ in range(500)]
    for text in [*samples, "a" * 5000, "ab" * 3000, " " * 3000, "\n" * 1000 + "x", "ñ" * 2000, (prose(9, 3000) + " ") * 70]:
        packed = codec.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == encoding.encode_ordinary(text)
        assert codec.decode(packed) == text.encode()


def automaton(history: list, counts: list[Counter], texts_: int, n: int, v: int, strength: float, token) -> float:
    """log10 p(token | history) by walking states and failure arcs."""
    order = len(counts)
    back, state = 0.0, history[-(order - 1):] if order > 1 else []
    while state:
        total = texts_ if state == ["<s>"] else counts[len(state) - 1][tuple(state)]
        if total:
            gram = (*state, token)
            if counts[len(state)][gram]:
                lower = 10 ** automaton(state[1:], counts[:len(state)], texts_, n, v, strength, token)
                return back + math.log10((counts[len(state)][gram] + strength * lower) / (total + strength))
            back += math.log10(strength / (total + strength))
        state = state[1:]
    return back + math.log10((counts[0][(token,)] + 1) / (n + v + 1))


def test_long_pieces_in_packed_arrays(monkeypatch):
    ranks, draw = byte_bpe.load_ranks(PATH), random.Random(8)
    pieces = ["".join(draw.choice(letters) for _ in range(n)).encode() for letters in ("ab", "the and ing", "aé\u4e2d\U0001f600x")
              for n in (2, 3, 7, 8, 15, 16, 17, 31, 64, 65, 500, 2000)] + [b"a" * 4096, b"ab" * 1024]
    for piece in pieces:
        if piece not in ranks:
            assert byte_bpe.merge_long_piece(piece, ranks) == byte_bpe.merge_piece(piece, ranks)
    few = {bytes([i]): i for i in range(256)}
    assert byte_bpe.merge_long_piece(bytes(range(256)) * 3, few) == list(range(256)) * 3
    word = "".join(draw.choice("etaoinshr") for _ in range(60_000))
    assert byte_bpe.merge_piece(word.encode(), ranks) == library().encode_ordinary(word)
    tracemalloc.start()
    byte_bpe.merge_long_piece(word.encode(), ranks)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * 60_000  # with the ids, which are a list


def test_bpe_short_pieces():
    ranks, draw = byte_bpe.load_ranks(PATH), random.Random(9)
    letters, encoding = " etaoinshrdlu,é漢", library()
    for size in [*range(1, 20), 63, 64, 65] * 20:
        piece = "".join(draw.choice(letters) for _ in range(size)).encode()
        found = byte_bpe.merge_short_piece(piece, ranks)
        assert found == byte_bpe.merge_long_piece(piece, ranks) and byte_bpe.merge_piece(piece, ranks) == (
            [ranks[piece]] if piece in ranks else found)
        assert byte_bpe.merge_piece(piece, ranks) == encoding._encode_single_piece(piece)


def test_scores_equal_a_walk_through_the_automaton(spark):
    held = {i for i in range(20) if zlib.crc32(str(i).encode()) % 7 == 2}
    for order, block_bytes in ((2, None), (3, 3000)):
        docs = odd_docs(spark).filter("doc_id IS NULL OR doc_id <> 11")
        found = lm_score.score_texts(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2, order=order, strength=2.0,
                                     block_bytes=block_bytes).collect()
        streams = [(r[0], [*[w.lower() for w in t.split()], None]) for r, t in zip(rows(), texts()) if r[0] != 11]
        counts = [Counter() for _ in range(order)]
        for i, tokens in streams:
            if i not in held:
                line = ["<s>", *tokens]
                for k in range(1, order + 1):
                    counts[k - 1].update(tuple(line[j:j + k]) for j in range(0 if k > 1 else 1, len(line) - k + 1))
        n, v = sum(counts[0].values()), len(counts[0])
        trained = sum(i not in held for i, _ in streams)
        expected = []
        for i, tokens in streams:
            line = ["<s>", *tokens]
            score = sum(automaton(line[:j], counts, trained, n, v, 2.0, line[j]) for j in range(1, len(line)))
            base = sum(math.log10((counts[0][(t,)] + 1) / (n + v + 1)) for t in tokens)
            expected.append((i or -1, i in held, len(tokens), sum(counts[0][(t,)] > 0 for t in tokens), n, round(base, 6), round(score, 6)))
        got = [(r.row.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6))
               for r in found]
        assert sorted(got) == sorted(expected)
    assert lm_score.score_texts(no_docs(spark)).count() == 0


def test_model_probabilities_sum_to_one():
    counts = [Counter({("a",): 3, ("b",): 2, (None,): 2}), Counter({("<s>", "a"): 2, ("a", "b"): 2, ("a", None): 1, ("b", None): 1, ("b", "a"): 1})]
    for history in (["<s>"], ["<s>", "a"], ["<s>", "b"], ["<s>", "zzz"]):
        assert abs(sum(10 ** automaton(history, counts, 2, 7, 3, 2.0, t) for t in ("a", "b", None, "unknown")) - 1) < 1e-9


def counts_of(text: str) -> tuple:
    words = re.findall("[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = Counter(line for line in text.split("\n") if re.search("[^\x20\x09-\x0D]", line))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(lines.values()) - len(lines), len(inside))


def test_counts_and_verdicts(spark, monkeypatch):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 1, None), (3, None, 1), (15, 0, 0)], "doc_id bigint, quality int, toxic int")
    expected = [counts_of(r[1] or "") for r in rows()]
    for many in (200_000, 10):  # sets of tuples, and arrays
        monkeypatch.setattr(quality_rules, "MANY_WORDS", many)
        assert [quality_rules.text_counts(t) for t in texts()] == expected
    counted = quality_rules.count_texts(odd_docs(spark), ["doc_id", "lang"])
    judged = quality_rules.judge(counted, quality_rules.fit_cutoffs(counted, labels, "doc_id", "lang"))
    fails = [c[0] < 10 or 100 * c[4] > 20 * c[0] for c in expected]
    assert Counter((r.row.doc_id, tuple(r[c] for c in quality_rules.COUNTS), r.base_failed) for r in judged.collect()) == \
        Counter(zip([r[0] for r in rows()], expected, fails))
    # five labels prove nothing, so only the base rules work
    kept = quality_rules.keep_good(odd_docs(spark), labels)
    assert kept.count() == fails.count(False) and kept.columns == odd_docs(spark).columns
    assert quality_rules.keep_good(no_docs(spark), labels).count() == 0
    assert quality_rules.keep_good(odd_docs(spark), labels.limit(0)).count() == fails.count(False)


def test_cutoffs_are_safe_and_exact():
    for n, k, p in ((10, 0, 0.1), (50, 3, 0.2), (400, 12, 0.05)):
        exact = sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))
        assert abs(quality_rules.at_most(k, n, p) - exact) < 1e-12
    rules = {"r": ("x", (3.0, 2.0, 1.0))}
    # 0 of 300 is proof of at most 3 in 100 at level 0.05 / 2; 9 of 300 is not; a failure ends the sequence
    chosen = quality_rules.safe_cutoffs({"a": (300, {"r": [0, 0, 9]}), "b": (300, {"r": [9, 0, 0]})}, 0.03, 0.05, rules, ("a", "b"))
    assert chosen == {("a", "r"): 2.0}
    # by simulation: how often does a cutoff whose true rate is over the limit pass?
    draw, wrong = np.random.default_rng(1), 0
    for _ in range(2000):
        k = [int(draw.binomial(500, 0.031))]
        wrong += bool(quality_rules.safe_cutoffs({"a": (500, {"r": k})}, 0.03, 0.05, {"r": ("x", (1.0,))}, ("a",)))
    assert wrong <= 0.05 * 2000


def test_no_stratum_loses_more_than_allowed():
    """The whole procedure: true loss of all chosen cutoffs together, over many drawn holdouts."""
    rules, strata = {"r": ("x", (3, 2, 1)), "s": ("y", (3, 2, 1))}, ("a", "b", "c")
    # chance of a good text to be rejected by the cutoffs up to each step, a little below and above the limit
    true = {"a": [0.0, 0.002, 0.011, 0.012, 0.02, 0.05], "b": [0.0101] * 6, "c": [0.0, 0.0, 0.001, 0.0105, 0.0105, 0.011]}
    draw, broken, used = np.random.default_rng(3), 0, 0
    for _ in range(1500):
        counts = {}
        for group, rates in true.items():
            ks = (draw.random(2500)[:, None] < np.array(rates)).sum(axis=0).tolist()  # nested, as the steps are
            counts[group] = (2500, {"r": ks[:3], "s": ks[3:]})
        chosen = quality_rules.safe_cutoffs(counts, 0.01, 0.05, rules, strata)
        used += ("a", "r") in chosen
        broken += any(rate_reached(chosen, g, rules, true[g]) > 0.01 for g in strata)
    assert used == 1500 and broken <= 0.05 * 1500


def test_cutoffs_that_catch_nothing_are_not_used():
    rules = {"r": ("x", (3.0, 2.0, 1.0)), "s": ("y", (1.0,))}
    good = {g: (2000, {"r": [0, 0, 4], "s": [6]}) for g in "abcd"}
    bad = {"a": (100, {"r": [0, 90, 90], "s": [90]}), "b": (100, {"r": [0, 0, 0], "s": [50]}), "c": (100, {"r": [0, 0, 0], "s": [0]})}
    assert quality_rules.safe_cutoffs(good, 0.01, 0.05, rules, tuple("abcd"), bad) == {
        ("a", "r"): 2.0, ("b", "r"): 1.0, ("b", "s"): 1.0}


def rate_reached(chosen, group, rules, rates):
    done = -1
    for k, (rule, cutoff) in enumerate([(r, c) for r, (_, cutoffs) in rules.items() for c in cutoffs]):
        if (group, rule) in chosen and chosen[group, rule] <= cutoff:
            done = k
    return rates[done] if done >= 0 else 0.0


def test_verdicts_where_cutoffs_exist(spark):
    """700 good texts of one language and 300 of another: only the first has proof, and its verdicts follow."""
    made, marks = [], []
    for i in range(1100):
        words = prose(5000 + i, 40).split()
        lang = "en" if i < 800 else "de"
        bad = i % 8 == 7
        if bad:
            words[::2] = [w + "#" for w in words[::2]]
        elif i % 100 == 3:
            words[5:10] = words[15:20] = words[25:26] * 5
        made.append((i, " ".join(words), lang))
        marks.append((i, int(not bad)))
    made += [(2000 + k, made[0][1], "en") for k in range(900)]  # copies prove nothing
    marks += [(2000 + k, 1) for k in range(900)]
    docs = spark.createDataFrame(made, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int")
    texts_of = {g: {t for (i, t, lang), (_, q) in zip(made, marks) if q and lang == g} for g in ("en", "de")}
    assert len(texts_of["en"]) == 700

    def ratios(text):
        n, _, symbols, lines, repeats = counts_of(text)
        return {"symbols": symbols / n, "repeats": repeats / n, "lines": lines / n}, n < 10 or 100 * repeats > 20 * n

    bads = {g: {t for (i, t, lang), (_, q) in zip(made, marks) if not q and lang == g} for g in ("en", "de")}
    own = {}
    for group, found in texts_of.items():
        caught = [r for r, fails in map(ratios, bads[group]) if not fails]
        trials = [r for r, fails in map(ratios, found) if not fails]
        cuts, states = {}, [(0.0, {})]
        for rule, (_, cutoffs) in quality_rules.RULES.items():
            for cutoff in cutoffs:
                k = sum(any(r[x] > c for x, c in {**cuts, rule: cutoff}.items()) for r in trials)
                p = sum(math.comb(len(trials), i) * 0.01 ** i * 0.99 ** (len(trials) - i) for i in range(k + 1))
                if p > 0.05 / 5:
                    break
                cuts = {**cuts, rule: cutoff}
                lost = [sum(any(r[x] > c for x, c in cuts.items()) for r in some) / len(some) for some in (caught, trials)]
                states.append((lost[0] - lost[1], cuts))
            else:
                continue
            break
        own[group] = max(states, key=lambda s: s[0])[1]  # the first of the best
    assert "symbols" in own["en"] and not own["de"]
    counted = quality_rules.count_texts(docs, ["doc_id", "lang"])
    chosen = quality_rules.fit_cutoffs(counted, labels, "doc_id", "lang")
    assert chosen == {("en", rule): cutoff for rule, cutoff in own["en"].items()}
    kept = {r.row.doc_id: r.kept for r in quality_rules.judge(counted, chosen).collect()}
    for i, text, lang in made:
        found, fails = ratios(text)
        assert kept[i] == (not fails and not any(found[r] > c for r, c in own[lang].items()))
    assert not any(kept[i] for i in range(800) if i % 8 == 7)


def test_grades_learn_and_are_ordered(spark):
    draw = random.Random(2)
    made = []
    for i in range(900):
        words = prose(100 + i, draw.randint(20, 60)).split()
        grade = i % 3
        if grade < 2:
            words[3::9] = ["horrid"] * len(words[3::9])
        if grade == 0:
            words = [w + "%%%" for w in words]
        made.append((i, " ".join(words), grade))
    docs = spark.createDataFrame(made, "doc_id bigint, text string, grade int")
    model = grade_model.train(docs.filter("doc_id < 700").drop("grade"), docs.filter("doc_id < 700").select("doc_id", "grade"))
    assert (np.diff(model.thresholds) > 0).all()
    found = grade_model.grade_texts(docs.filter("doc_id >= 700"), model).collect()
    assert np.mean([round(r.expected_grade) == r.row.grade for r in found]) > 0.9
    assert all(r.kept == (r.tail_probability >= 0.5) and r.tail_probability <= r.expected_grade <= 2 for r in found)


def test_grades_of_odd_documents(spark):
    ratings = spark.createDataFrame([(1, 2), (1, 0), (None, 1), (3, None), (15, 0), (8, 7)], "doc_id bigint, grade int")
    model = grade_model.train(odd_docs(spark), ratings)
    found = grade_model.grade_texts(odd_docs(spark), model).collect()
    assert Counter(r.row.doc_id for r in found) == Counter(r[0] for r in rows())
    assert all(0 <= r.expected_grade <= 2 and r.row.kept == "own kept" for r in found)
    assert len({r.expected_grade for r in found if r.row.doc_id in (4, 5, 6)}) == 1
    empty = grade_model.train(no_docs(spark), ratings)
    assert not empty.weights.any() and grade_model.grade_texts(no_docs(spark), empty).count() == 0


def test_features_are_counted_once():
    column = pa.array([b"a b a", b"", b"b"], pa.binary())
    from corpusloom.llm import arrays
    doc, feature = grade_model.features(*arrays.buffer_of(column))
    assert len(set(zip(doc.tolist(), feature.tolist()))) == len(doc) and set(doc.tolist()) == {0, 1, 2}
