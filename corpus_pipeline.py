"""The corpus pipeline: quality, line dedup, near-duplicates, mixture, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows the one before kept; all but the last return the columns
of the documents they get. What a stage has decided is in its rows: rejected documents are gone, removed lines are
cut, one document of each near-duplicate group is left, and a document stands as often as the mixture takes it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocabspark.llm import common, lines, mixing, packing, quality, shingles, simhash
from vocabspark.llm.components import connected_components

#: No SQL says what a fitted model, fingerprints or a tokenizer do.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; its labels are those of `labels`, held-out ones left out."""
    model = quality.train(docs, common.table(spark, sf_dir, "labels"), "doc_id", "text", "quality")
    scored = quality.score(docs, model, docs.columns, "text", "__score")
    return scored.filter(F.col("__score") >= quality.THRESHOLD).select(*docs.columns)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later places of repeated passages; a document of which no line is left is gone."""
    cut = lines.dedup_lines(docs, "doc_id", "text", out=("__lines", "__removed"))
    left = cut.filter((F.col("__removed") == 0) | (F.col("__removed") < F.col("__lines")))
    changed = F.when(F.col("__removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return left.withColumn("n_chars", changed).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the least id (null first), then the first in the table.

    Texts are linked whose SimHash fingerprints differ in two bits at most, as op1 links them, and those whose sets
    of five-word shingles have a Jaccard similarity of 0.8 or more, which SimHash alone would miss. Groups are what both join.
    """
    placed = docs.withColumn("__place", F.struct("doc_id", F.monotonically_increasing_id().alias("row")))
    alike = simhash.near_duplicates(placed, "__place", "text").select("__place", F.col("component_id").alias("__alike"))
    classes = common.cut_lineage(alike.join(shingles.near_duplicates(placed, "__place", "text", 5, 0.8), "__place"))
    # The first document of each class by either way is a node; every document links its two classes.
    edges = classes.select(F.col("__alike.row").alias("u"), F.col("component_id.row").alias("v")).filter("u <> v").distinct()
    roots = connected_components(common.cut_lineage(edges)).select(F.col("node").alias("__node"), "root")
    named = classes.join(roots, F.col("__alike.row") == F.col("__node"), "left").select("__place", F.coalesce("root", "__alike.row").alias("__root"))
    firsts = named.groupBy("__root").agg(F.min("__place").alias("__first")).select(F.col("__first.row").alias("__row"))
    return docs.withColumn("__at", F.monotonically_increasing_id()).join(firsts, F.col("__at") == F.col("__row"), "left_semi").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it."""
    names = {c: f"__kept_{i}" for i, c in enumerate(docs.columns)}
    mixed = mixing.mix(docs.withColumnsRenamed(names), names["doc_id"], names["source"], mixing.words(F.col(names["text"])))
    taken = mixed.filter("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return taken.select(*[F.col(new).alias(old) for old, new in names.items()])


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all windows, with their ids."""
    return packing.pack(docs, "doc_id", "text", "source", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", keep_good),
    ("line_dedup", cut_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = common.cut_lineage(stage(spark, docs, sf_dir))
        if before is not None:
            common.discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
