"""The pipeline's stages on planted cases, odd rows and the given tables."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from vocabspark.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, label int, start long"


def _docs(rng):
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9)))
    text = lambda n: "\n".join(" ".join(word() for _ in range(12)) + "." for _ in range(n))
    rows = {i: text(rng.randint(6, 12)) for i in range(40)}
    passage = text(5)  # over 50 words, in three documents
    for i in (3, 4, 5):
        rows[i] = rows[i] + "\n" + passage + "\n" + text(1)
    for i in range(40, 48):  # two lines each: the line dedup leaves them
        rows[i] = " ".join(word() for _ in range(120)) + "\n" + " ".join(word() for _ in range(60))
    near = rows[40].split(" ")
    near[30] = "changed"
    rows[48], rows[49] = rows[41], " ".join(near)  # an exact and a near copy
    for i in range(50, 60):
        rows[i] = " ".join(f"{word().upper()}!! ###" for _ in range(40))  # junk
    return rows, passage


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(11)
    rows, passage = _docs(rng)
    path = str(tmp_path_factory.mktemp("planted"))
    data = [(i, t, None if i % 7 == 0 else "en", f"s{i % 3}", len(t), 0.5, "x", None, 1) for i, t in rows.items()]
    data += [(100, None, None, None, None, None, None, None, None), (None, "", "en", "s1", 0, None, None, 1, None), (None, "null id text", None, None, None, None, None, None, None)] * 2
    spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 50), 0) for i in range(60)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows, passage


def test_stages(spark, planted):
    path, rows, passage = planted
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, stages = docs.columns, dict(P.STAGES)
    good = stages["quality"](spark, docs, path)
    assert good.columns == columns
    assert {r.doc_id for r in good.collect()} - {None, 100} == set(range(50))
    good = spark.createDataFrame(good.collect(), docs.schema)

    cut = stages["line_dedup"](spark, good, path)
    assert cut.columns == columns
    got = {r.doc_id: r for r in cut.collect()}
    assert passage in got[3].text and passage not in got[4].text and passage not in got[5].text
    assert got[4].text == rows[4].replace(passage + "\n", "") and got[4].n_chars == len(got[4].text)
    assert all(got[i].text == rows[i] and got[i].n_chars == len(rows[i]) for i in range(50) if i not in (4, 5))
    cut = spark.createDataFrame(cut.collect(), docs.schema)

    left = stages["near_dedup"](spark, cut, path)
    assert left.columns == columns
    ids = [r.doc_id for r in left.collect()]
    assert 48 not in ids and 49 not in ids and set(range(48)) <= set(ids)
    assert len([i for i in ids if i in (None, 100)]) == 2  # the empty ones are one class, and the text with no id
    left = spark.createDataFrame(left.collect(), docs.schema)

    mixed = stages["mixing"](spark, left, path)
    assert mixed.columns == columns
    times = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert set(times) <= set(ids) and max(n for i, n in times.items() if i is not None) <= 3
    again = stages["mixing"](spark, left.repartition(5), path)
    assert sorted(map(str, again.collect())) == sorted(map(str, mixed.collect()))

    pieces = stages["packing"](spark, mixed, path).collect()
    assert sum(r.length for r in pieces) == sum(len(np.frombuffer(r.ids, "<u4")) for r in pieces)
    assert {r.doc_id for r in pieces} == set(times)


def test_run_and_empty_table(spark, planted, tmp_path):
    path, _, _ = planted
    assert P.run(spark, path).count() > 0
    docs = spark.read.parquet(f"{path}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_quality_stage_equals_scores_of_each_text(spark, sf_small):
    """Brute force: the model's tables, text by text."""
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{sf_small}/labels.parquet"), "doc_id", "text", "quality")
    kept = {r.doc_id for r in P.keep_good(spark, docs, sf_small).collect()}
    for r in docs.collect():
        x = quality.features(r.text)
        total = model.base + sum(t[int(np.sum(e <= v))] for t, e, v in zip(model.tables, model.edges, x))
        total += sum(t[int(np.sum(model.coarse[f] <= x[f])), int(np.sum(model.coarse[g] <= x[g]))] for (f, g), t in model.pairs.items())
        assert (1 / (1 + np.exp(-total)) >= quality.THRESHOLD) == (r.doc_id in kept)


def test_extra_columns_survive(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").withColumns({"score": F.lit(1), "copies": F.lit("c"), "k": F.lit(None).cast("int"), "n_lines": F.lit(2)})
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf_small)
        assert out.columns == docs.columns and out.count() > 0, name


def test_near_dedup_joins_links_of_both_ways(spark):
    """SimHash links what the other way leaves apart, and a group may take both kinds of links."""
    from vocabspark.llm import shingles, simhash

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    base = [word() for _ in range(40)]
    # The chorus is five shingles, very often each: they outweigh the others in a fingerprint, which counts repeats, not in a set.
    chorus = " ".join([" ".join(base[:5])] * 400)
    verse = lambda: " ".join(word() for _ in range(30))
    first, second = chorus + " " + verse(), chorus + " " + verse()
    texts = [(1, first), (2, second), (3, " ".join(base)), (4, verse())]
    docs = spark.createDataFrame([(i, t, None, "s", len(t), None, None, None, None) for i, t in texts], SCHEMA)
    by = lambda df: {r["doc_id"]: r["component_id"] for r in df.collect()}
    assert by(simhash.near_duplicates(docs, "doc_id", "text")) == {1: 1, 2: 1, 3: 3, 4: 4}
    assert by(shingles.near_duplicates(docs, "doc_id", "text", 5, 0.8)) == {1: 1, 2: 2, 3: 3, 4: 4}
    assert sorted(r.doc_id for r in P.drop_near_duplicates(spark, docs, "").collect()) == [1, 3, 4]
