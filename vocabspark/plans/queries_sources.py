"""Queries through the document and table formats, on documents made from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import checkpoint_dir
from ..sources import documents as D
from ..sources import images as I
from ..sources import tables as T
from . import fixtures as X
from .registry import query


def scratch(spark) -> str:
    return f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"


@query("io01_vocabulary_file", "vocab", "SELECT id, target_noun, len(singulars) AS n_singulars, len(plurals) AS n_plurals, len(hypernyms) AS n_hypernyms FROM vocab")
def _(spark, sf):
    path = scratch(spark)
    X.vocab(spark, sf).write.json(path)
    rows = D.read_vocab(spark, path, lines=True)
    return rows.select(
        "id", "target_noun", F.size("singulars").alias("n_singulars"), F.size("plurals").alias("n_plurals"), F.size("hypernyms").alias("n_hypernyms")
    )


def _documents(rows, key: str, entry):
    """JSON map documents, one per block of at most 64 keys, from rows (block, key, entry)."""
    maps = rows.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct(F.col(key), entry))).alias("doc"))
    return maps.select(F.to_json("doc").alias("value"))


@query("io02_template_documents", "doc_prompts", """
    SELECT pos // 10000 AS doc_id, (row_number() OVER (PARTITION BY pos // 10000 ORDER BY pos) - 1)::INT AS pos, freq::INT AS freq, template FROM doc_prompts""")
def _(spark, sf):
    rows = X.doc_templates(spark, sf).withColumn("doc_id", F.expr("pos div 10000"))
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("pos", "freq", "template"))), lambda r: F.array(r["freq"].cast("string"), r["template"]))
    lists = rows.groupBy("doc_id").agg(pairs.alias("entries")).select(
        F.to_json(F.struct(F.create_map(F.col("doc_id").cast("string"), F.col("entries")).alias("prompts"))).alias("value")
    )
    return D.parse_templates(lists, "prompts").select(F.col("collection").cast("long").alias("doc_id"), "pos", "freq", "template")


_DATASETS = ("imagenet1k", "cifar10", "food101", "imagenette", "fashionmnist", "imagenet-r", "unheard")


@query("io03_class_prompts", "caption_rows", f"""
    WITH p AS (SELECT id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS pos, (['imagenet1k', 'cifar10', 'food101'])[doc_id % 3 + 1] || '' AS ds, caption AS template FROM caption_rows),
         d AS (SELECT doc_id, ({list(_DATASETS)})[doc_id % 7 + 1] AS dataset FROM documents),
         r AS (SELECT dataset, CASE dataset WHEN 'imagenette' THEN 'imagenet1k' WHEN 'imagenet-r' THEN 'imagenet1k' WHEN 'fashionmnist' THEN 'cifar10' ELSE dataset END AS source FROM (SELECT DISTINCT dataset FROM d))
    SELECT r.dataset, r.source, p.pos, replace(replace(template, '{{singular}}', '{{noun}}'), '{{plural}}', '{{noun}}') AS template FROM r JOIN p ON p.ds = r.source""")
def _(spark, sf):
    rows = X.caption_rows(spark, sf)
    name = F.get(F.array(*[F.lit(n) for n in _DATASETS[:3]]), (F.col("doc_id") % 3).cast("int"))
    text = F.replace(F.replace("caption", F.lit("{singular}"), F.lit("{c}")), F.lit("{plural}"), F.lit("{c}"))
    lists = rows.groupBy("doc_id", name.alias("ds")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", text.alias("t")))), lambda r: r["t"]).alias("l"))
    prompts = D.parse_class_prompts(lists.select(F.to_json(F.create_map("ds", "l")).alias("value")))
    wanted = X.table(spark, sf, "documents").select(
        F.get(F.array(*[F.lit(n) for n in _DATASETS]), (F.col("doc_id") % 7).cast("int")).alias("dataset")
    ).distinct()
    return D.resolve_class_prompts(prompts, wanted)


@query("io04_prediction_files", "predictions", """
    SELECT model, gencfg, count(DISTINCT sample) AS n_samples, count(*) AS n_predictions FROM predictions GROUP BY ALL""")
def _(spark, sf):
    """All model folders, one of them named twice."""
    path = scratch(spark)
    D.write_predictions(X.predictions(spark, sf).withColumn("block", F.expr("sample_id div 64")), path, ["block"])
    folders = [f"{path}/model=model_{m}" for m in (2, 0, 3, 1)] + [f"{path}/model=model_0/"]
    docs = D.read_predictions(spark, folders, lines=True)
    rows = D.flatten_predictions(docs.withColumn("model", F.regexp_extract("file", "/model=([^/]*)/", 1)))
    return rows.groupBy("model", "gencfg").agg(F.countDistinct("sample").alias("n_samples"), F.count("*").alias("n_predictions"))


@query("io06_annotation_documents", "annotations", "SELECT sample, category, noun FROM annotations")
def _(spark, sf):
    by_category = X.annotations(spark, sf).groupBy("sample", "category").agg(F.collect_list("noun").alias("nouns"))
    by_sample = by_category.groupBy("sample").agg(F.map_from_entries(F.collect_list(F.struct("category", "nouns"))).alias("categories"))
    docs = _documents(by_sample.withColumn("block", F.expr("cast(substring(sample, 5) AS bigint) div 64")), "sample", F.col("categories"))
    return D.parse_annotations(docs).select("sample", "category", "noun")


@query("io08_written_predictions", "predictions", "SELECT model, gencfg, gen_topk, sample, k, pred, score FROM predictions")
def _(spark, sf):
    rows = X.predictions(spark, sf).withColumn("block", F.expr("sample_id div 64"))
    path = scratch(spark)
    D.write_predictions(rows, path, ["block"])
    return D.flatten_predictions(D.read_predictions(spark, [path], lines=True)).select("model", "gencfg", "gen_topk", "sample", "k", "pred", "score")


@query("io09_embedding_table", "multi_targets", "SELECT row_id, len(embedding) AS dim, target_ids[1] AS first_target, target_weights[1] AS first_weight, (SELECT count(*) FROM multi_targets) AS embed_num, 3::INT AS width, true AS complete FROM multi_targets")
def _(spark, sf):
    path = scratch(spark)
    targets = X.vocab(spark, sf).select(F.col("id").alias("target_id"), F.col("target_noun").alias("noun"))
    T.write_embedding_table(path, X.multi_targets(spark, sf), targets, 3, "hashing-64")
    stored = T.read_embedding_table(spark, path)
    return stored.rows.select(
        "row_id", F.size("embedding").alias("dim"), F.get("target_ids", F.lit(0)).alias("first_target"), F.get("target_weights", F.lit(0)).alias("first_weight"),
        F.lit(stored.meta["embed_num"]).alias("embed_num"), F.lit(stored.meta["embed_targets_dim"]).alias("width"), F.lit(stored.meta["use_targets"]).alias("complete"),
    )


@query("io10_image_names", "page_images", """
    SELECT page_id, regexp_matches(lower(source), '\\.(jpg|jpeg|png|bmp|gif|webp|tiff)$') AS is_image FROM page_images""".replace("\\\\", "\\"))
def _(spark, sf):
    return X.page_images(spark, sf).select("page_id", I.is_image(F.col("source")).alias("is_image"))


@query("io11_specificity_documents", "specificity", "SELECT noun, specificity FROM specificity")
def _(spark, sf):
    rows = X.specificity(spark, sf).withColumn("block", F.expr("cast(element_at(split(noun, ' '), -1) AS bigint) div 64"))
    return D.parse_specificity(_documents(rows, "noun", F.col("specificity")))


@query("io12_class_folders", "", """
    SELECT o_orderkey, 'priority ' || substr(o_orderpriority, 1, 1) AS class_name, CASE WHEN o_orderstatus = 'F' THEN 'valid' ELSE 'train' END AS split FROM orders WHERE o_orderstatus <> 'P' AND o_custkey % 5 <> 0""")
def _(spark, sf):
    folder = F.when(F.col("o_orderstatus") == "F", "val").when(F.col("o_orderstatus") == "O", "train").otherwise("extra")
    tail = F.when(F.col("o_custkey") % 5 == 0, ".txt").otherwise(".JPEG")
    path = F.concat(F.lit("/data/set/"), folder, F.lit("/priority_"), F.substring("o_orderpriority", 1, 1), F.lit("/"), F.col("o_orderkey"), tail)
    rows = I.class_folders(X.table(spark, sf, "orders").select(path.alias("path")))
    return rows.select(F.regexp_extract("path", r"/(\d+)\.JPEG$", 1).cast("long").alias("o_orderkey"), "class_name", "split")
