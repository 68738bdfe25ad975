"""Near-duplicates by exact Jaccard similarity against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from vocabspark.llm import shingles


def _set(text):
    found = (text or "").lower().split()
    return frozenset([" ".join(found)] if found and len(found) < 5 else zip(*(found[i:] for i in range(5))))


def slow_classes(texts):
    sets, label = [_set(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def _texts(rng):
    out = [None, "", "  ", "one two", "One two"]
    for group in range(25):
        base = [f"w{rng.getrandbits(30)}" for _ in range(200)]
        for _ in range(4):  # from nearly equal to under the threshold
            words = base.copy()
            for at in rng.sample(range(0, 200, 6), rng.randint(1, 7)):
                words[at] = f"n{rng.getrandbits(30)}"
            out.append(" ".join(words))
    return out


@pytest.mark.parametrize("rounds, block, at_a_time", [(0, 2, 7), (0, 512, 4096), (2, 3, 4096), (6, 512, 64)])
def test_classes_against_brute_force(spark, monkeypatch, rounds, block, at_a_time):
    monkeypatch.setattr(shingles, "ROUNDS", rounds)
    monkeypatch.setattr(shingles, "BLOCK", block)
    monkeypatch.setattr(shingles, "SHINGLES", at_a_time)
    texts = _texts(random.Random(12))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    got = {r.id: r.component_id for r in shingles.near_duplicates(df, "id", "text").collect()}
    assert [got[i] for i in range(len(texts))] == slow_classes(texts)
    assert shingles.near_duplicates(df.limit(0), "id", "text").count() == 0


def test_pipeline_stage_holds_the_threshold(spark):
    texts = _texts(random.Random(13))
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").orderBy(F.col("doc_id")).coalesce(1)
    left = {r.doc_id for r in P.drop_near_duplicates(spark, docs, "").collect()}
    assert left == set(slow_classes(texts))


def test_one_large_group(spark):
    """3,000 near copies of one text, of which some are too far from all others, and a chain whose ends are apart."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(3000):
        words = base.copy()
        for at in rng.sample(range(0, 120, 6), 1 + i % 6):
            words[at] = f"n{i}_{at}"
        texts.append(" ".join(words))
    chain = base = [f"c{i}" for i in range(200)]
    for i in range(12):
        chain = chain.copy()
        chain[i * 12] = f"d{i}"
        texts.append(" ".join(chain))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4)
    got = {r.id: r.component_id for r in shingles.near_duplicates(df, "id", "text").collect()}
    sets, index = [_set(t) for t in texts[:3000]], {g: i for i, g in enumerate(_set(" ".join(f"w{i}" for i in range(120))))}
    marks = np.zeros((3000, len(index)))  # only the base's shingles are in two texts
    for i, own in enumerate(sets):
        marks[i, [index[g] for g in own if g in index]] = 1
    both, size = marks @ marks.T, np.array([len(x) for x in sets])
    near, label = both >= 0.8 * (size[:, None] + size[None] - both), np.arange(3000)
    np.fill_diagonal(near, True)
    while True:
        new = np.where(near, label[None], 3000).min(axis=1)
        if (new == label).all():
            break
        label = new
    assert 1 < len(set(label.tolist())) < 2000
    assert [got[i] for i in range(3000)] == label.tolist()
    assert {got[i] for i in range(3000, 3012)} == {3000}
