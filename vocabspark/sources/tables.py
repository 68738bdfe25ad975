"""Embedding tables on disk: data/, targets/ and a one-row meta/ that marks the table complete."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT_VERSION = 1
META_SCHEMA = (
    "version int, use_targets boolean, full_targets boolean, default_weights boolean, unit_weights boolean, "
    "embedder_hash string, target_hash string, embed_num long, embed_targets_dim int, embed_dim int"
)


@dataclass(frozen=True)
class StoredTable:
    rows: DataFrame
    targets: DataFrame
    meta: dict


def write_embedding_table(
    path: str, rows: DataFrame, targets: DataFrame, width: int, embedder_hash: str, full_targets: bool = False,
    unit_weights: bool = True, default_weights: bool = False,
) -> None:
    """Write rows and target dictionary, then the meta row that makes the table readable.

    The fingerprint of the target dictionary does not depend on row order.
    """
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{path}/data")
    targets.write.mode("overwrite").parquet(f"{path}/targets")
    data = spark.read.parquet(f"{path}/data")
    stats = data.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    digest = spark.read.parquet(f"{path}/targets").agg(
        F.coalesce(F.sum(F.xxhash64("target_id", "noun").cast("decimal(38,0)")), F.lit(0)).cast("string")
    ).first()[0]
    meta = (
        FORMAT_VERSION, width > 0, full_targets, default_weights, unit_weights, embedder_hash, digest, stats["n"], width, stats["dim"] or 0,
    )
    spark.createDataFrame([meta], META_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def read_embedding_table(spark: SparkSession, path: str) -> StoredTable:
    """Open a complete table; one without its meta row was not finished."""
    try:
        meta = spark.read.schema(META_SCHEMA).parquet(f"{path}/meta").first()
    except AnalysisException as exc:
        raise FileNotFoundError(f"no complete embedding table at {path}") from exc
    if meta is None or meta["version"] != FORMAT_VERSION:
        raise ValueError(f"unreadable embedding table at {path}")
    return StoredTable(spark.read.parquet(f"{path}/data"), spark.read.parquet(f"{path}/targets"), meta.asDict())


def reuse_table(spark: SparkSession, root: str, fingerprint: str, build: Callable[[str], None]) -> StoredTable:
    """The complete table of this configuration fingerprint, built first if there is none."""
    path = f"{root}/{fingerprint}"
    try:
        return read_embedding_table(spark, path)
    except FileNotFoundError:
        build(path)
        return read_embedding_table(spark, path)
