"""Readers and writers on temporary folders."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from vocabspark.operators.embtable import fingerprint
from vocabspark.sources import documents as D
from vocabspark.sources import images as I
from vocabspark.sources import tables as T


def dump(path, value):
    path.write_text(json.dumps(value))
    return str(path)


def test_vocabulary_and_templates(spark, tmp_path):
    noun = dict(id=1, target_noun="cat", pretty_noun="cat", singulars=["cat"], singulars_freq=[2], plurals=[], plurals_freq=[], hypernyms=[])
    assert D.read_vocab(spark, dump(tmp_path / "v.json", [noun, {**noun, "id": 2}])).count() == 2
    doc = {"prompts": {"A": [[1, "a {noun}"], [2, "the {noun}"]]}, "hypernyms": {"None": [[1, None]]}}
    path = dump(tmp_path / "p.json", doc)
    assert [tuple(r) for r in D.read_templates(spark, path, "prompts").orderBy("pos").collect()] == [("A", 0, 1, "a {noun}"), ("A", 1, 2, "the {noun}")]
    assert [tuple(r) for r in D.read_templates(spark, path, "hypernyms").collect()] == [("None", 0, 1, None)]


def test_class_prompts_with_alias(spark, tmp_path):
    prompts = D.read_class_prompts(spark, dump(tmp_path / "c.json", {"cifar10": ["a {c}"], "food101": ["food {c}"]}))
    wanted = spark.createDataFrame([("fashionmnist",), ("food101",), ("unknown",)], "dataset string")
    got = sorted(tuple(r) for r in D.resolve_class_prompts(prompts, wanted).collect())
    assert got == [("fashionmnist", "cifar10", 0, "a {noun}"), ("food101", "food101", 0, "food {noun}")]


def prediction_doc(**change):
    cfg = dict(pred=[["a", "b"], ["c", "d"]], score=[[0.9, 0.1], [0.8, 0.2]], result=[[0, 3], [1, 2]], gen_cfg=dict(topk=2))
    return {**dict(version=1, model="m", samples=["s1", "s2"], predictions={"beam": cfg}), **change}


def test_predictions_from_files_and_folders(spark, tmp_path):
    folder = tmp_path / "preds"
    folder.mkdir()
    dump(folder / "one.json", prediction_doc())
    (folder / "note.txt").write_text("no")
    extra = dump(tmp_path / "two.json", prediction_doc(model="n"))
    docs = D.read_predictions(spark, [str(folder), extra, extra])
    rows = D.flatten_predictions(docs)
    assert rows.count() == 8
    assert sorted(r["model"] for r in rows.select("model").distinct().collect()) == ["m", "n"]
    first = rows.filter("model = 'm' AND sample = 's2' AND k = 1").first()
    assert (first["pred"], first["score"], first["result"], first["gen_topk"]) == ("c", 0.8, 1, 2)
    with pytest.raises(ValueError):
        D.prediction_paths(["x.csv"])


def test_length_mismatch_fails(spark, tmp_path):
    path = dump(tmp_path / "bad.json", prediction_doc(samples=["s1"]))
    with pytest.raises(Exception, match="differ in length"):
        D.flatten_predictions(D.read_predictions(spark, [path])).collect()


def test_annotations_and_upsert(spark, tmp_path):
    ann = D.read_annotations(spark, dump(tmp_path / "a.json", {"s1": {"correct_primary": ["a", "b"], "incorrect": []}, "s2": {}}))
    assert [r["category"] for r in D.annotation_categories(ann).collect()] == ["correct_primary", "incorrect"]
    assert ann.filter("noun IS NOT NULL").count() == 2
    samples = spark.createDataFrame([("s1",), ("s3",)], "sample string")
    assert {r["sample"] for r in D.upsert_samples(ann, samples).filter("category IS NULL").collect()} == {"s2", "s3"}


def test_specificity(spark, tmp_path):
    rows = D.read_specificity(spark, dump(tmp_path / "s.json", {"cat": 0.5, "dog": 1}))
    assert sorted(tuple(r) for r in rows.collect()) == [("cat", 0.5), ("dog", 1.0)]


def test_embedding_table_round_trip_and_reuse(spark, tmp_path):
    rows = spark.createDataFrame([(0, [1.0, 0.0], [1], [1.0])], "row_id long, embedding array<float>, target_ids array<int>, target_weights array<float>")
    targets = spark.createDataFrame([(0, ""), (1, "cat")], "target_id int, noun string")
    built = []

    def build(path):
        built.append(path)
        T.write_embedding_table(path, rows, targets, 1, "e", full_targets=True)

    for _ in range(2):
        table = T.reuse_table(spark, str(tmp_path), "abc", build)
    assert len(built) == 1
    assert (table.meta["embed_num"], table.meta["embed_dim"], table.meta["full_targets"]) == (1, 2, True)
    assert table.targets.count() == 2
    with pytest.raises(FileNotFoundError):
        T.read_embedding_table(spark, str(tmp_path / "none"))


def test_image_listing_and_class_folders(spark, tmp_path):
    for name in ("train/cat_x/a.JPG", "val/cat_x/b.png", "val/dog/c.txt", "val/dog/d.webp"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    files = I.list_files(spark, str(tmp_path), recursive=True)
    got = sorted((r["class_name"], r["split"]) for r in I.class_folders(files).collect())
    assert got == [("cat x", "train"), ("cat x", "valid"), ("dog", "valid")]
    assert I.class_folders(files, "train").count() == 1
    assert sorted((r["n_images"], r["n_others"]) for r in I.image_counts(files).collect()) == [(1, 0), (1, 0), (1, 1)]


def test_fingerprint_order_and_exclusion(spark):
    from pyspark.sql import functions as F

    make = lambda *kv: F.create_map(*[F.lit(x) for x in kv])
    row = spark.range(1).select(
        fingerprint(make("a", "1", "b", "2"), ("z",)).alias("x"), fingerprint(make("b", "2", "z", "9", "a", "1"), ("z",)).alias("y"),
        fingerprint(make("a", "1", "b", "3"), ("z",)).alias("w"), fingerprint(make("a", "0", "b", "2"), ("z",), {"a": "1"}).alias("v"),
    ).first()
    assert row["x"] == row["y"] == row["v"] != row["w"]


def test_prompts_of_one_dataset_are_dealt_out(spark):
    """No key of the join holds more than a share of a dataset's prompts."""
    prompts = spark.range(2000).select(F.lit("cifar10").alias("dataset"), F.col("id").cast("int").alias("pos"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("template"))
    wanted = spark.createDataFrame([("cifar10",), ("fashionmnist",), ("unheard",)], "dataset string")
    out = D.resolve_class_prompts(prompts, wanted)
    assert "share" in out._jdf.queryExecution().optimizedPlan().toString()
    want = sorted((d, "cifar10", i, f"t{i}") for d in ("cifar10", "fashionmnist") for i in range(2000))
    assert sorted(map(tuple, out.collect())) == want
