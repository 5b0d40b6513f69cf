"""The registered queries on the small tables, and the pipeline against the operators' own results."""

import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from compare import compare_query, duck
from conftest import SF
from odd import no_docs, odd_docs
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate
from corpusloom.llm.queries import ORACLE, QUERIES


def test_each_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    verdict = compare_query(spark, duck(SF), SF, QUERIES[name], ORACLE.get(name))
    assert verdict.startswith("ok"), verdict


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).checkpoint()
        rows[name] = out.collect()
        kept = [r.doc_id for r in rows[name]]
        assert len(kept) == len(set(kept)) and set(kept) <= ids
        if name != "byte_bpe":
            assert out.columns == columns
            docs, ids = out, set(kept)
    texts = {r.doc_id: r.text for r in rows["simhash_dedup"]}
    assert len(set(texts.values())) == len(texts)
    for r in rows["suffix_dedup"]:
        assert r.n_chars == len(r.text) and len(r.text) <= len(texts[r.doc_id])
    # nothing of 200 bytes repeats any more, except across the place of a cut
    strings = Counter()
    for t in [r.text.encode() for r in rows["suffix_dedup"] if r.text == texts[r.doc_id]]:
        strings.update({t[i:i + 200] for i in range(len(t) - 199)})
    assert max(strings.values()) == 1
    benchmark = [" ".join(re.findall(r"\w+", r.text.lower())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {r.doc_id for r in rows["decontaminate"]}
    leaks = {r.doc_id for r in rows["suffix_dedup"] if any(b in " ".join(re.findall(r"\w+", r.text.lower())) for b in benchmark)}
    assert not leaks & left and len(left) >= len(texts) - len(leaks) - 2
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == Counter(left)


def test_stages_on_odd_tables(spark):
    docs = odd_docs(spark).withColumns({c: F.lit("own") for c in ("IDS", "n_tokens", "ids_sha256", "decoded_sha256", "quality", "item_id", "__first")})
    new = ["n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.limit(0), docs.filter("text IS NULL")):
            out = stage(spark, table, SF).checkpoint()
            if name == "byte_bpe":
                assert out.columns == [c for c in docs.columns if c not in ("text", "IDS", *new)] + new
                assert out.count() == table.count()
            else:
                assert out.columns == docs.columns and out.count() <= table.count()
                assert out.filter("block <> 'own block' OR __first <> 'own'").count() == 0
    assert corpus_pipeline.STAGES[0][1](spark, no_docs(spark), SF).count() == 0


def test_pipeline_fits_its_latent_space_on_all_passages(spark, monkeypatch):
    more = SF.replace("sf0.001", "sf0.01")  # some 1,100 passages of sf0.001 reach the stage
    made, share = [], decontaminate.share
    monkeypatch.setattr(decontaminate, "share", lambda spark, thing: made.append(thing) or share(spark, thing))
    corpus_pipeline.run(spark, more)
    searcher, = made
    # the same space from a dense matrix of all passages that the three stages before leave
    docs = spark.read.parquet(f"{more}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, more)
    codes = []
    for r in docs.select("text").collect():
        data = np.frombuffer(r.text.lower().encode(), np.uint8)
        words, _ = decontaminate.normal_words(data, np.array([0, len(data)]))
        words = searcher.items.code[(words % np.uint64(decontaminate.FEATURES)).astype(np.int64)]
        codes += [words[k:k + decontaminate.PASSAGE] for k in range(0, len(words), decontaminate.PASSAGE)]
    assert len(codes) > 3000
    matrix = np.array([np.bincount(c, minlength=len(searcher.items.weight)) for c in codes], np.float32)
    weight = np.maximum(np.log((len(codes) + 1.0) / ((matrix > 0).sum(axis=0) + 0.5)), 0.0) ** 2
    weight[0] = 0.0
    assert np.allclose(searcher.items.weight, weight)
    matrix *= weight
    own = np.array([searcher.items.vector(w) for w in searcher.items.words])
    own *= np.linalg.norm(matrix) / np.linalg.norm(own)  # the items weigh as much as all passages
    basis = np.random.default_rng(7).standard_normal((len(weight), decontaminate.RANK + decontaminate.EXTRA))
    for _ in range(decontaminate.ROUNDS):
        basis, _ = np.linalg.qr(matrix.T @ (matrix @ basis) + own.T @ (own @ basis))
    space = np.linalg.svd(matrix.T @ (matrix @ basis) + own.T @ (own @ basis), full_matrices=False)[0][:, :decontaminate.RANK]
    wanted = (space * weight[:, None]) @ (space * weight[:, None]).T
    assert np.abs(searcher.embed @ searcher.embed.T - wanted).max() < 1e-3 * np.abs(wanted).max()
