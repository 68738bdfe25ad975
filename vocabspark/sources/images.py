"""Image listings and class-folder datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: file name tails of images, matched without case.
IMAGE_TAILS = (".jpg", ".jpeg", ".png", ".bmp", ".gif", ".webp", ".tiff")


def is_image(path: Column) -> Column:
    return F.lower(path).rlike("(" + "|".join(t.replace(".", r"\.") for t in IMAGE_TAILS) + ")$")


def list_files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """Paths and sizes of the files of a folder; file contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    return reader.load(folder).select("path", "length")


def image_counts(files: DataFrame) -> DataFrame:
    """Images and non-images per folder."""
    return files.groupBy(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder")).agg(
        F.count_if(is_image(F.col("path"))).alias("n_images"), F.count_if(~is_image(F.col("path"))).alias("n_others")
    )


# Folder names of the splits.
SPLIT_FOLDERS = {"train": "train", "val": "valid", "valid": "valid", "test": "valid"}


def class_folders(files: DataFrame, split: str = "all") -> DataFrame:
    """Images of a .../<split>/<class>/<file> tree with class and split; 'all' unites both splits."""
    if split not in ("train", "valid", "all"):
        raise ValueError(f"unknown split: {split}")
    parts = F.split("path", "/")
    folder = F.element_at(parts, -3)
    name = F.lit(None).cast("string")
    for source, target in SPLIT_FOLDERS.items():
        name = F.when(folder == source, F.lit(target)).otherwise(name)
    rows = files.filter(is_image(F.col("path"))).select(
        "path", F.regexp_replace(F.element_at(parts, -2), "_", " ").alias("class_name"), name.alias("split")
    ).filter("split IS NOT NULL")
    return rows if split == "all" else rows.filter(F.col("split") == split)
