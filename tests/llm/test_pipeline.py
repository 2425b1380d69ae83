"""The pipeline's stages on the smallest tables."""

import random

import corpus_pipeline
from larkspur.llm import jaccard
from larkspur.llm.common import stash, table


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stash(stage(spark, docs, sf), "stage")
        if name == "n-gram Jaccard join":
            found = jaccard.jaccard_components(before, 5, 80)
            assert docs.count() == found.select("component_id").distinct().count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name in ("secret scans", "BPE encoding and decoding"):
            assert docs.count() == before.count()
    text = {r.doc_id: r.text for r in before.collect()}
    assert all(r.decoded == text[r.doc_id] for r in docs.collect())


def test_family_below_the_threshold(spark, sf, monkeypatch):
    # 80 copies of one text, each with fourteen words of its own: all stay, next to
    # nothing is compared; only the copy that differs by one word goes
    rng, texts = random.Random(4), []
    for i in range(80):
        copy = [f"w{j}" for j in range(240)]
        for at in rng.sample(range(0, 240, 5), 14):
            copy[at] = f"z{i}-{at}"
        texts.append(" ".join(copy))
    texts.append(texts[9] + " end")
    compared, verify = [], jaccard.verify
    monkeypatch.setattr(jaccard, "verify", lambda pairs, *more: (
        compared.append(pairs.count()), verify(pairs, *more))[1])
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_chars int")
    kept = corpus_pipeline.one_of_each(spark, docs, sf)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(80))
    assert sum(compared) <= len(texts)


def test_empty(spark, sf):
    docs = table(spark, sf, "documents").where("doc_id < -1")
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0
