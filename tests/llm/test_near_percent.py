"""Near copies at thresholds other than that of op6_near_dedup."""

import random
from math import comb

import pytest

import corpus_pipeline
from repairlens.llm import near_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def edited(words, places):
    return [f"new{i}" if i in places else w for i, w in enumerate(words)]


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(a & b) / len(a | b)


def test_stage_drops_near_copies_from_080(spark):
    random.seed(11)
    texts, gone, between = {}, set(), set()
    for k in range(60):
        base = [f"w{random.randint(0, 10**9)}" for _ in range(100 + k)]
        copy = edited(base, {20, 50} if k % 2 else {20, 50, 80})
        texts[2 * k], texts[2 * k + 1] = base, copy
        near = jaccard(base, copy)
        gone |= {2 * k + 1} if near >= 0.8 else set()
        between |= {2 * k + 1} if 0.8 <= near < 0.85 else set()
    assert len(between) > 20 and len(gone) < 60
    docs = spark.createDataFrame([(i, " ".join(w), "en", "src0", 0) for i, w in texts.items()], DOCS)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == set(texts) - gone
    strict = {r.doc_id for r in near_dedup.near_duplicates(docs, percent=85).where("NOT kept").collect()}
    assert strict == gone - between


def test_agreements_follow_the_threshold():
    assert near_dedup.agreements(85) == 38 and near_dedup.agreements(80) == 34 and near_dedup.agreements(100) == 64
    for percent in (50, 70, 80, 85, 95):
        least = near_dedup.agreements(percent)
        assert sum(comb(64, k) * (percent / 100) ** k * (1 - percent / 100) ** (64 - k) for k in range(least)) < 1e-6
    with pytest.raises(ValueError):
        near_dedup.agreements(10)
