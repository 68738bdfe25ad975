"""Set and multiset operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row with the number of surplus copies on each side, both zero for equal multisets, and the rows of each side.

    Copies are counted before the comparison, so a row with very many copies is one counter.
    """
    tagged = left.withColumn("__side", F.lit(1)).unionByName(right.withColumn("__side", F.lit(-1)))
    balance = tagged.groupBy(*left.columns).agg(
        F.sum("__side").alias("balance"), F.count_if(F.col("__side") > 0).alias("l"), F.count_if(F.col("__side") < 0).alias("r")
    )
    return balance.agg(
        F.coalesce(F.sum("l"), F.lit(0)).alias("n_left"), F.coalesce(F.sum("r"), F.lit(0)).alias("n_right"),
        F.coalesce(F.sum(F.greatest("balance", F.lit(0))), F.lit(0)).alias("only_left"),
        F.coalesce(F.sum(F.greatest(-F.col("balance"), F.lit(0))), F.lit(0)).alias("only_right"),
    )


def union_splits(valid: DataFrame, train: DataFrame) -> DataFrame:
    """Both splits of a dataset, each row tagged with its split; valid first in id order."""
    return valid.withColumn("split", F.lit("valid")).unionByName(train.withColumn("split", F.lit("train")))


def unknown_guides(guides: DataFrame, targets: DataFrame, key: str = "noun") -> DataFrame:
    """Guide nouns that are not model targets."""
    return guides.select(key).distinct().join(targets.select(key).distinct(), key, "left_anti")


def all_keys(*frames: DataFrame) -> DataFrame:
    """Distinct keys over several inputs."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out.distinct()
