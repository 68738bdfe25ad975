"""JSON documents: vocabularies, templates, predictions, annotations, specificity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.vocab import VOCAB_SCHEMA

GENCFG_SCHEMA = (
    "struct<method:string,topk:int,vocab_prior:boolean,vocab_per_token:boolean,vocab_scaler:double,"
    "guided:boolean,guide_renorm:boolean,temperature:double,length_alpha:double,name:string>"
)
PREDICTION_SCHEMA = (
    "version int, model string, model_cfg map<string,string>, infer_cfg map<string,string>, "
    "guide_targets array<string>, vocab_targets array<string>, samples array<string>, "
    f"predictions map<string, struct<gen_cfg:{GENCFG_SCHEMA}, "
    "valid_guide:array<array<boolean>>, valid_vocab:array<array<boolean>>, valid:array<array<boolean>>, "
    "pred:array<array<string>>, score:array<array<double>>, result:array<array<int>>>>"
)
ANNOTATION_TYPE = "map<string, map<string, array<string>>>"


def read_vocab(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A vocabulary: one JSON array of noun objects, or one object per line (splittable, for large ones)."""
    return spark.read.schema(VOCAB_SCHEMA).json(path, multiLine=not lines)


def read_captions(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A captions file: vocabulary objects with their caption lists and quotas; one object per line with `lines`."""
    lists = [T.StructField(f"{k}_captions", T.ArrayType(T.StringType())) for k in ("singular", "plural")]
    quotas = [T.StructField(f"num_{k}_captions", T.IntegerType()) for k in ("singular", "plural")]
    return spark.read.schema(T.StructType([*VOCAB_SCHEMA.fields, *lists, *quotas])).json(path, multiLine=not lines)


# Readers of documents that are one JSON map take the whole file as one document; with `lines` each line is a
# document with any part of the map, so that large ones are split over tasks.


def parse_templates(texts: DataFrame, section: str) -> DataFrame:
    """Section 'prompts' or 'hypernyms' of template documents (column value) as rows (collection, pos, freq, template).

    An entry is a [frequency, template] pair; a null template is a legal row.
    """
    pairs = "array<array<string>>"
    parsed = texts.select(
        F.from_json("value", f"struct<prompts: map<string, {pairs}>, hypernyms: map<string, {pairs}>>").alias("doc")
    )
    collections = parsed.select(F.explode(F.col("doc")[section]).alias("collection", "entries"))
    return collections.select("collection", F.posexplode("entries").alias("pos", "entry")).select(
        "collection", "pos", F.get("entry", F.lit(0)).cast("int").alias("freq"), F.get("entry", F.lit(1)).alias("template")
    )


def read_templates(spark: SparkSession, path: str, section: str, lines: bool = False) -> DataFrame:
    return parse_templates(spark.read.text(path, wholetext=not lines), section)


def parse_class_prompts(texts: DataFrame) -> DataFrame:
    """Class prompt documents as rows (dataset, pos, template), with {c} turned into {noun}."""
    parsed = texts.select(F.from_json("value", "map<string, array<string>>").alias("doc"))
    rows = parsed.select(F.explode("doc").alias("dataset", "prompts")).select("dataset", F.posexplode("prompts").alias("pos", "template"))
    return rows.withColumn("template", F.replace("template", F.lit("{c}"), F.lit("{noun}")))


def read_class_prompts(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return parse_class_prompts(spark.read.text(path, wholetext=not lines))


# Datasets that use another dataset's prompts when they have none of their own.
PROMPT_ALIASES = {
    "fashionmnist": "cifar10",
    "tinyimagenet": "cifar100",
    "imagenette": "imagenet1k",
    "imagewoof": "imagenet1k",
    "imagenet-a": "imagenet1k",
    "imagenet-r": "imagenet1k",
}

PROMPT_SHARES = 256


def resolve_class_prompts(prompts: DataFrame, datasets: DataFrame) -> DataFrame:
    """Prompts of each dataset (column `dataset`, lower case), through its alias where it has none.

    A dataset has any number of prompts: they are dealt into shares, each met by all datasets, so that none is one task's.
    """
    own = prompts.select("dataset").distinct().withColumn("own", F.lit(True))
    alias = F.lit(None).cast("string")
    for name, target in PROMPT_ALIASES.items():
        alias = F.when(F.col("dataset") == name, F.lit(target)).otherwise(alias)
    keyed = datasets.join(own, "dataset", "left").withColumn("source", F.when(F.col("own"), F.col("dataset")).otherwise(alias))
    shares = keyed.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(PROMPT_SHARES - 1))))
    dealt = prompts.withColumnRenamed("dataset", "source").withColumn("share", F.pmod(F.xxhash64("pos", "template"), F.lit(PROMPT_SHARES)).cast("int"))
    return shares.join(dealt, ["source", "share"]).select("dataset", "source", "pos", "template")


def prediction_paths(paths: list[str]) -> list[str]:
    """Distinct sorted prediction paths; a folder is read by its *.json files."""
    for path in paths:
        if path and "." in path.rsplit("/", 1)[-1] and not path.endswith(".json"):
            raise ValueError(f"predictions must be JSON files: {path}")
    return sorted({path.rstrip("/") for path in paths if path})


def read_predictions(spark: SparkSession, paths: list[str], lines: bool = False) -> DataFrame:
    """Prediction documents of files and folders, each with its file name.

    A file is one document, or with `lines` one document per line, as `write_predictions` writes
    them; only the latter can be split over tasks.
    """
    reader = spark.read.schema(PREDICTION_SCHEMA).option("multiLine", not lines).option("pathGlobFilter", "*.json")
    return reader.json(prediction_paths(paths)).withColumn("file", F.col("_metadata.file_path"))


def flatten_predictions(docs: DataFrame) -> DataFrame:
    """Documents as long rows (file, model, gencfg, gen_topk, sample, k, pred, score, result), k from 1.

    The sample list and each prediction list must have the same length.
    """
    configs = docs.select("file", "model", "samples", F.explode("predictions").alias("gencfg", "p"))
    lists = F.arrays_zip(
        F.col("samples").alias("sample"), F.col("p.pred").alias("preds"), F.col("p.score").alias("scores"), F.col("p.result").alias("results")
    )
    same = (F.size("samples") == F.size("p.pred")) & (F.coalesce(F.size("p.score"), F.size("samples")) == F.size("samples"))
    failed = F.raise_error(F.concat(F.lit("samples and predictions differ in length: "), F.col("file")))
    checked = F.when(same, lists).otherwise(failed.cast("array<struct<sample:string,preds:array<string>,scores:array<double>,results:array<int>>>"))
    rows = configs.select("file", "model", "gencfg", F.col("p.gen_cfg.topk").alias("gen_topk"), F.inline(checked))
    items = F.arrays_zip(F.col("preds").alias("pred"), F.col("scores").alias("score"), F.col("results").alias("result"))
    return rows.select("file", "model", "gencfg", "gen_topk", "sample", F.posexplode(items).alias("pos", "item")).select(
        "file", "model", "gencfg", "gen_topk", "sample", (F.col("pos") + 1).alias("k"), "item.pred", "item.score", "item.result"
    )


def prediction_documents(preds: DataFrame, shard: list[str]) -> DataFrame:
    """Long prediction rows as documents, one per (file, model, shard).

    A document holds all its samples, so `shard` columns bound its size; every shard is a complete
    document with its own sample list.
    """
    has_result = "result" in preds.columns
    result = F.col("result").cast("int") if has_result else F.lit(None).cast("int")
    keys = ["file", "model", *shard]
    by_sample = preds.groupBy(*keys, "gencfg", "gen_topk", "sample").agg(
        F.array_sort(F.collect_list(F.struct("k", "pred", "score", result.alias("result")))).alias("items")
    )
    # Sample lists must agree between decodings: samples are the shard's union, with empty lists where a decoding lacks one.
    configs = by_sample.groupBy(*keys, "sample").agg(F.collect_list(F.struct("gencfg", "gen_topk", "items")).alias("own"))
    known = by_sample.groupBy(*keys).agg(F.collect_set(F.struct("gencfg", "gen_topk")).alias("all"))
    every = configs.join(known, keys).select(*keys, "sample", "own", F.explode("all").alias("cfg"))
    mine = F.get(F.filter("own", lambda x: (x["gencfg"] == F.col("cfg.gencfg")) & x["gen_topk"].eqNullSafe(F.col("cfg.gen_topk"))), F.lit(0))["items"]
    none = F.array().cast("array<struct<k:int,pred:string,score:double,result:int>>")
    lists = every.select(*keys, "cfg", F.struct("sample", F.coalesce(mine, none).alias("items")).alias("row"))
    per_config = lists.groupBy(*keys, "cfg").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    part = lambda name: F.transform("rows", lambda r: F.transform(r["items"], lambda y: y[name])).alias(name)
    entry = F.struct(F.struct(F.col("cfg.gen_topk").alias("topk"), F.col("cfg.gencfg").alias("name")).alias("gen_cfg"), *[part(n) for n in ("pred", "score", "result")])
    made = per_config.groupBy(*keys).agg(
        F.first(F.transform("rows", lambda r: r["sample"])).alias("samples"), F.map_from_entries(F.collect_list(F.struct("cfg.gencfg", entry))).alias("predictions")
    )
    return made.select(*keys, F.lit(1).alias("version"), "samples", "predictions")


def write_predictions(preds: DataFrame, path: str, shard: list[str]) -> None:
    """Write prediction documents as JSON lines, partitioned by model."""
    prediction_documents(preds, shard).write.mode("overwrite").partitionBy("model").json(path)


def parse_annotations(texts: DataFrame) -> DataFrame:
    """Annotation documents as rows (sample, category, category_pos, noun); a sample without nouns keeps a null row."""
    parsed = texts.select(F.from_json("value", ANNOTATION_TYPE).alias("doc"))
    samples = parsed.select(F.explode("doc").alias("sample", "categories"))
    categories = samples.select("sample", F.posexplode_outer(F.map_entries("categories")).alias("category_pos", "entry"))
    return categories.select(
        "sample", F.col("entry.key").alias("category"), "category_pos", F.explode_outer("entry.value").alias("noun")
    )


def read_annotations(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return parse_annotations(spark.read.text(path, wholetext=not lines))


def annotation_categories(ann: DataFrame) -> DataFrame:
    """Categories in order of first appearance position."""
    return ann.filter("category IS NOT NULL").groupBy("category").agg(F.min("category_pos").alias("pos")).orderBy("pos", "category")


def upsert_samples(ann: DataFrame, samples: DataFrame) -> DataFrame:
    """Annotations plus one empty row for every sample they do not hold yet."""
    unseen = samples.select("sample").distinct().join(ann.select("sample").distinct(), "sample", "left_anti")
    return ann.select("sample", "category", "noun").unionByName(unseen, allowMissingColumns=True)


def parse_specificity(texts: DataFrame) -> DataFrame:
    parsed = texts.select(F.from_json("value", "map<string, double>").alias("doc"))
    return parsed.select(F.explode("doc").alias("noun", "specificity"))


def read_specificity(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return parse_specificity(spark.read.text(path, wholetext=not lines))
