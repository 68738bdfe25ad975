"""Seeded selection without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.keys import digest_bucket, digest_uniform, seeded_digest


def n_smallest(df: DataFrame, n: int, key: Column, tie: Column, bucket: Column) -> DataFrame:
    """The n rows with the smallest (key, tie), for any n, without sorting the table.

    `bucket` is a monotone function of the key. One counting job finds the bucket the cut falls
    into; the buckets below it are then a plain filter, and only that bucket is ranked.
    """
    counts = df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    before = W.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    left = counts.withColumn("left", F.lit(n) - F.coalesce(F.sum("n").over(before), F.lit(0)))
    last = left.filter("left > 0").orderBy(F.desc("bucket")).limit(1).collect()
    if not last:
        return df.limit(0)
    edge = F.lit(last[0]["bucket"])
    if last[0]["left"] >= last[0]["n"]:
        return df.filter(bucket <= edge)
    cut = df.filter(bucket == edge).orderBy(key, tie).limit(int(last[0]["left"]))
    return df.filter(bucket < edge).unionByName(cut)


def sample_n(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Uniform sample of n rows without replacement (all rows if fewer), chosen by digest of the key."""
    digest = seeded_digest(seed, F.col(key))
    return n_smallest(df, n, digest, F.col(key), digest_bucket(digest))


def weighted_sample_n(df: DataFrame, key: str, weight: Column, n: int, seed: int) -> DataFrame:
    """Weighted sample of n rows without replacement: the smallest exponential keys -ln(u)/w.

    Scaling all weights (by their mean, say) does not change the choice, so no mean is needed.
    """
    arrival = -F.log(digest_uniform(seeded_digest(seed, F.col(key)))) / weight
    rows = df.withColumn("__arrival", arrival)
    fine = F.floor(F.log2(F.greatest("__arrival", F.lit(1e-300))) * 4096)
    return n_smallest(rows, n, F.col("__arrival"), F.col(key), fine).drop("__arrival")


def shuffle_rows(df: DataFrame, key: str, seed: int, partitions: int | None = None) -> DataFrame:
    """Rows in seeded random order: range partitions on the digest, sorted inside, ready to write."""
    keyed = df.withColumn("shuffle_key", seeded_digest(seed, F.col(key)))
    spread = keyed.repartitionByRange(partitions, "shuffle_key") if partitions else keyed.repartitionByRange("shuffle_key")
    return spread.sortWithinPartitions("shuffle_key")
