"""The classifier: held-out accuracy, lookup tables, odd rows."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from vocabspark.llm import quality, queries


def test_tables_and_pairs_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y, rounds=20)
    assert (0, 1) in model.pairs
    fresh = rng.random((2000, 3))
    want = (fresh[:, 0] > 0.5) != (fresh[:, 1] > 0.5)
    assert ((model.score(fresh) > 0.5) == want).mean() > 0.85
    whole = np.full(len(fresh), model.base)
    for f, t in enumerate(model.tables):
        whole += t[np.searchsorted(model.edges[f], fresh[:, f], side="right")]
    assert set(model.pairs) and not np.allclose(1 / (1 + np.exp(-whole)), model.score(fresh))
    assert quality.fit(x[:0], y[:0]).score(x[:3]).tolist() == [0.5] * 3
    assert (quality.fit(x, np.ones(4000)).score(x[:9]) > 0.99).all()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op4_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    own = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in own]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "word " * 50_000, "z"), (None, "word " * 50_000, "z")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (1, 0)], "doc_id long, quality int")
    model = quality.train(docs, labels, "doc_id", "text", "quality")
    got = quality.score(docs, model, ["doc_id"], "text").collect()
    assert len(got) == 4 and len({r.score for r in got if r.doc_id is None}) == 1
    assert quality.score(docs.limit(0), model, ["doc_id"], "text").count() == 0
    empty = quality.train(docs, labels.limit(0), "doc_id", "text", "quality")
    assert {r.score for r in quality.score(docs, empty, ["doc_id"], "text").collect()} == {0.5}
    assert docs.select(quality.held_out("doc_id").alias("h")).filter(F.col("h").isNull()).count() == 0
