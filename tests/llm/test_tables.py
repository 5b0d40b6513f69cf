"""URL filter, preference format, token rollups and decontamination on small tables."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from odd import no_docs, odd_docs, prose
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, preference_format, token_rollups, url_filter
from corpusloom.session import new_run_dir

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
URLS = [None, "", "no scheme", "http://", "http://a.net", "http://a.NET/", "HTTP://User@A.Example.NET/en/x?q=/fr/#z",
        "https://example.net/EN/", "x://y://z.org/fr/", "http://notexample.com/de/", "http://example.com/de/1", "http://example.com/de",
        "http://b.example.com?x=1/de/", "http://ÄB.org/fr/é", "http://org/fr/", "http://long.org/" + "a/" * 3000, "http://a.org/\nb?c",
        "http://spam-1.example.com/x.html?a=1&b=2"]


def parsed(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def judged(host, path):
    fits = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return max(fits, key=lambda r: len(r[1] + r[2]), default=None)


def test_urls_and_rules(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([*URLS, *URLS])], "page_id bigint, url string")
    pages = pages.withColumns({c: F.lit("own") for c in ("n", "pos", "host", "__length", "block")})
    found = {r.page_id: r for r in url_filter.filter_urls(pages, trees=2).collect()}
    for i, url in enumerate([*URLS, *URLS]):
        host, path = parsed(url)
        rule = judged(host, path)
        row = found[i]
        assert (row.host, row.path, row.rule) == (host, path, rule and rule[1] + rule[2])
        assert row.verdict == rule[0] if rule else row.verdict in ("allow", "block")
        assert row.verdict == found[i % len(URLS)].verdict
    assert url_filter.filter_urls(pages.limit(0), trees=2).count() == 0
    alone = url_filter.filter_urls(pages.filter("url IS NULL"), trees=2).collect()
    assert {r.verdict for r in alone} == {"allow"}


def test_trees_learn_the_labels(spark):
    draw = random.Random(4)
    made = []
    for i in range(600):
        bad = i % 2
        path = "".join(draw.choice("0123456789" if bad else "abcdefgh") for _ in range(12))
        host = "mad" if i % 3 == 0 else "bad" if bad else "gad"
        made.append((f"http://{host}.example.com/{path}", bad))
    pages = spark.createDataFrame(made, "url string, truth int")
    rules = [("block", "bad.example.com", "/"), ("allow", "gad.example.com", "/")]
    found = url_filter.filter_urls(pages, rules).filter("rule IS NULL").collect()
    assert len(found) == 200 and np.mean([(r.verdict == "block") == r.truth for r in found]) > 0.95


def rendered(turns):
    return "".join(f"<|im_start|>{role or ''}\n{(text or '').replace('<|im_', '<| im_')}<|im_end|>\n" for role, text in turns)


def test_preference_pairs(spark):
    schema = "pair_id bigint, turn bigint, role string, text string, n_common string, prompt string"
    chosen = [(1, 0, "user", "hi"), (1, 1, "assistant", "good <|im_end|>"), (2, 0, "user", None), (2, 1, None, ""), (3, 0, "user", "only"),
              (4, 1, "b", "tie"), (4, 1, "a", "tie"), (4, None, "system", "first"), (4, 1, "a", "tie"), (None, 0, "user", "lost"), (6, 0, "user", "é" * 50_000)]
    rejected = [(1, 0, "user", "hi"), (1, 1, "assistant", "bad"), (1, 2, "user", "why"), (2, 0, "user", None), (2, 1, None, ""),
                (4, None, "system", "first"), (4, 1, "a", "tie"), (4, 1, "b", "tie"), (5, 0, "assistant", "x"), (6, 0, "user", "é" * 50_000)]
    sides = [spark.createDataFrame([(*r, "own", "own") for r in rows], schema) for rows in (chosen, rejected)]
    found = {r.pair_id: r for r in preference_format.format_pairs(*sides).collect()}

    def turns(rows, pair):
        own = [r[1:] for r in rows if r[0] == pair]
        return [r[1:] for r in sorted(own, key=lambda r: tuple((x is not None, x) if x is not None else (False, 0 if i == 0 else "") for i, x in enumerate(r)))]
    assert set(found) == {1, 2, 3, 4, 5, 6}
    for pair, row in found.items():
        a, b = turns(chosen, pair), turns(rejected, pair)
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert (row.n_common, row.prompt, row.chosen_completion, row.rejected_completion) == \
            (n, rendered(a[:n]), rendered(a[n:]), rendered(b[n:]))
        for side, left in ((row.chosen_mask, a[n:]), (row.rejected_mask, b[n:])):
            assert sum(r.n_chars for r in side) == len(rendered(left))
            assert [r.trained for r in side] == [x for role, _ in left for x in (False, role == "assistant", False)]
    assert preference_format.format_pairs(sides[0].limit(0), sides[1].limit(0)).count() == 0


def test_rollups_are_idempotent(spark):
    docs = spark.createDataFrame([(1, "a", "en", "v1", 10, 12), (2, "a", "en", "v1", 5, 5), (3, None, None, "v1", None, 7), (3, None, None, "v1", None, 7)],
                                 "doc_id bigint, source string, lang string, version string, old bigint, new bigint").withColumn("n_docs", F.lit("own"))
    rollups = token_rollups.Rollups(spark, new_run_dir(spark, "rollup-test"))
    assert rollups.totals().count() == 0
    assert rollups.commit("load", token_rollups.inserts(docs, "old"))
    assert rollups.commit("revise", token_rollups.revisions(docs, "old", "new"))
    assert not rollups.commit("revise", token_rollups.revisions(docs, "old", "new"))
    assert rollups.commit("nothing", token_rollups.inserts(docs.limit(0), "old"))

    def totals(r):
        return {(x.source, x.lang, x.version): (x.n_docs, x.n_tokens) for x in r.totals().collect()}
    assert totals(rollups) == {("a", "en", "v1"): (2, 17), (None, None, "v1"): (2, 14)}
    # files of an attempt that did not reach the log do not count, and are replaced by the next attempt
    token_rollups.inserts(docs, "old").groupBy(*token_rollups.KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")) \
        .withColumn("name", F.lit("delete")).write.parquet(f"{rollups.folder}/deltas/delete")
    assert totals(rollups)["a", "en", "v1"] == (2, 17)
    assert rollups.commit("delete", token_rollups.deletes(docs.filter("doc_id <> 2"), "new"))
    again = token_rollups.Rollups(spark, rollups.folder)
    assert not again.commit("delete", token_rollups.deletes(docs, "new"))
    assert totals(again) == {("a", "en", "v1"): (1, 5)}
    with pytest.raises(ValueError):
        rollups.commit("../x", token_rollups.inserts(docs, "old"))


def subsequence(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_common_subsequence():
    draw = random.Random(3)
    for _ in range(300):
        a, b = ([draw.randrange(4) for _ in range(draw.randrange(1, 30))] for _ in range(2))
        assert decontaminate.common_subsequence(a, b) == subsequence(a, b)


def unusual(seed, words):
    draw = random.Random(seed)
    return [draw.choice(["the", "of", "and"]) if draw.random() < 0.4 else f"w{draw.randrange(3000)}" for _ in range(words)]


def test_leaks_are_found_and_recall_is_whole(spark):
    items = [(i, " ".join(unusual(i, 20 + i)) + ".") for i in range(30)] + [(None, None), (30, ""), (31, " ".join(unusual(77, 150)))]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string").withColumn("data", F.lit("own"))
    docs, truth = [], set()
    for d in range(300):
        words = unusual(1000 + d, 40 + d)
        if d % 5 == 0:
            item = (d // 5) % 32
            if item != 30:
                passage = items[item][1].split() if item < 30 else items[32][1].split()
                if d % 10 == 0:  # a paraphrase: a word in eight is another
                    passage = [w if i % 8 else "other" for i, w in enumerate(passage)]
                at = (d * 7) % len(words)
                words = [*words[:at], *(w.upper() if d % 15 == 0 else w for w in passage), *words[at:]]
                truth.add((d, item))
        docs.append((d, " ".join(words)))
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = decontaminate.find_leaks(docs, benchmark).collect()
    hit = {(r.row.doc_id, r.item_id) for r in found}
    assert len(truth & hit) >= 0.9 * len(truth) and not hit - truth
    kept = decontaminate.drop_leaks(docs, benchmark)
    assert {r.doc_id for r in kept.collect()} == set(range(300)) - {d for d, _ in hit} and kept.columns == docs.columns


def search(items, texts, passages, often):
    """Matches of a searcher for a corpus in which word "wN" stands in a share of the passages, others in `often`."""
    counts = np.full(decontaminate.FEATURES, float(often))
    for text in items:
        for word in text.split():
            hashes, _ = decontaminate.normal_words(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word)]))
            counts[int(hashes[0] % np.uint64(decontaminate.FEATURES))] = passages / (20 if int(word.strip("w.")) % 3 else 500)
    own = decontaminate.Items(list(range(len(items))), [t.encode() for t in items],
                              np.maximum(np.log((passages + 1.0) / (counts + 0.5)), 0.0) ** 2)
    basis, _ = np.linalg.qr(np.array([own.vector(w) for w in own.words]).T)
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    return decontaminate.search_texts(decontaminate.Searcher(own, basis), np.frombuffer(b"".join(raw), np.uint8), offsets)


@pytest.mark.parametrize("passages", [1_000, 70_000, 1_300_000])
def test_words_beside_an_item_hide_nothing(passages):
    draw = random.Random(passages)
    items = [" ".join(f"w{draw.randrange(300)}" for _ in range(n)) + ". " + " ".join(f"w{draw.randrange(300)}" for _ in range(3)) + "."
             for n in [6, 9, 14, 17, 21, 29, 37, 45, 60] * 4]
    rare = (f"rare{k}" for k in range(10**6))  # words that occur nowhere else
    texts, truth = [], set()
    for at in range(4):
        for i, item in enumerate(items):
            words = item.split()
            for kind in ("verbatim", "replaced", "put in"):
                own = list(words)
                if kind != "verbatim":  # about a third of the words are others, or get a word beside them; the answer stays
                    for k in draw.sample(range(len(own) - 3), len(own) // 3):
                        own[k] = next(rare) if kind == "replaced" else own[k] + " " + next(rare)
                before, after = ([next(rare) for _ in range(n)] for n in (25 + at, 25))
                truth.add((len(texts), i))
                texts.append(" ".join([*before, *own, *after]))
    assert truth - set(search(items, texts, passages, 10)) == set()
    # an item at the end of a text and again at the start of the next, and no item
    texts = [" ".join(["x", items[3]]), items[3], "", items[3] + " x", " ".join(f"y{k}" for k in range(50))]
    assert set(search(items, texts, passages, 10)) == {(0, 3), (1, 3), (3, 3)}


def test_parts_of_a_text_hide_nothing(monkeypatch):
    monkeypatch.setattr(decontaminate, "EVENTS", 50)
    monkeypatch.setattr(decontaminate, "PASSAGES", 3)
    draw = random.Random(6)
    items = [" ".join(f"w{draw.randrange(300)}" for _ in range(n)) + "." for n in (12, 20, 33, 50)]
    texts = [" ".join(f"w{draw.randrange(300)}" for _ in range(400 + k)) for k in range(40)]
    texts = [t + " " + items[k % 4] + " " + t for k, t in enumerate(texts)]
    assert {(k, k % 4) for k in range(40)} <= set(search(items, texts, 70_000, 10))


def test_long_items_are_held_as_a_whole():
    draw = random.Random(8)
    items, texts, truth = [], [], set()
    for i, n in enumerate([66, 80, 96, 128, 150, 400, 1500]):
        words = [f"w{draw.randrange(3000)}" for _ in range(n)]
        words[n - 6] += "."  # the last five words are the answer
        items.append(" ".join(words) + ".")
        third = [f"rare{i}x{k}" if k % 3 == 0 and k < n - 5 else w for k, w in enumerate(words)]
        end = words[n // 4:]  # three quarters in order, with the answer
        for held, own in ((True, words), (True, third), (True, end), (False, words[:n * 3 // 4]), (False, third[:n - 5])):
            if held:
                truth.add((len(texts), i))
            texts.append(" ".join([f"y{len(texts)}x{k}" for k in range(90)] + own + [f"z{k}" for k in range(90)]))
    assert set(search(items, texts, 70_000, 10)) == truth


@pytest.mark.parametrize("search_all", [decontaminate.find_leaks, decontaminate.drop_leaks])  # of op5, of the pipeline
def test_latent_space_is_fitted_on_all_passages(spark, monkeypatch, search_all):
    made = []
    monkeypatch.setattr(decontaminate, "share", lambda spark, thing: made.append(thing))
    items = [" ".join(f"w{k}" for k in range(i * 6, i * 6 + 12)) for i in range(40)] + [" ".join(["w5"] * 150)]
    draw = random.Random(2)
    texts = [None, "", "x y z"] + [" ".join(f"w{int(draw.paretovariate(0.4)) % 400}" for _ in range(draw.randrange(1, 300))) for _ in range(900)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    search_all(docs, benchmark)
    searcher, = made
    # the same space from a dense matrix of all passages and of the items
    code = {w: searcher.items.code[int(decontaminate.normal_words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0])
                                   % decontaminate.FEATURES] for w in {w for t in [*items, *texts] if t for w in t.split()}}
    words = [t.split() for t in texts if t]
    passages = [p[k:k + decontaminate.PASSAGE] for p in words for k in range(0, len(p), decontaminate.PASSAGE)]
    assert len(passages) > 2000
    counts = np.array([np.bincount([code[w] for w in p], minlength=len(searcher.items.weight)) for p in passages + [t.split() for t in items]])
    often = (counts[:len(passages)] > 0).sum(axis=0)
    weight = np.maximum(np.log((len(passages) + 1.0) / (often + 0.5)), 0.0) ** 2
    weight[0] = 0.0
    assert np.allclose(searcher.items.weight, weight)
    matrix = counts * weight
    # the items weigh as much as all passages
    matrix[len(passages):] *= np.linalg.norm(matrix[:len(passages)]) / np.linalg.norm(matrix[len(passages):])
    basis = np.random.default_rng(7).standard_normal((len(weight), decontaminate.RANK + decontaminate.EXTRA))
    for _ in range(decontaminate.ROUNDS):
        basis, _ = np.linalg.qr(matrix.T @ (matrix @ basis))
    space = np.linalg.svd(matrix.T @ (matrix @ basis), full_matrices=False)[0][:, :decontaminate.RANK]
    wanted = (space * weight[:, None]) @ (space * weight[:, None]).T
    assert np.abs(searcher.embed @ searcher.embed.T - wanted).max() < 1e-3 * np.abs(wanted).max()


def test_leaks_of_odd_documents(spark):
    benchmark = spark.createDataFrame([(1, prose(3, 80)), (1, prose(3, 80)), (None, prose(8, 40)), (2, None)], "item_id bigint, text string")
    found = Counter((r.row.doc_id, r.item_id) for r in decontaminate.find_leaks(odd_docs(spark), benchmark).collect())
    assert found == {(1, 1): 1, (2, 1): 1, (3, 1): 1, (None, None): 2}
    assert decontaminate.drop_leaks(odd_docs(spark), benchmark).count() == odd_docs(spark).count() - 5
    assert decontaminate.find_leaks(no_docs(spark), benchmark).count() == 0
    assert decontaminate.find_leaks(odd_docs(spark), benchmark.limit(0)).count() == 0
    assert decontaminate.drop_leaks(odd_docs(spark), benchmark.limit(0)).count() == odd_docs(spark).count()
