"""Positions and running sums that stay spread over the cluster.

An ordered window over a whole table, or over one hot group, runs in a single task. Here the rows are dealt
by ranges of (group, order), as many as the rows need, and written with the number of their range; rows are summed
inside (group, range), and only the ranges' totals, one row for each group and range that meet, are summed in
order. The result is exact for any skew of the groups or of the values they are ordered by. Where the order
is a digest its leading digits are the ranges, as digests are even by nature.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut_lineage

_BUCKET = "__bucket"


def _sums(work: DataFrame, kept: Sequence[str], by: Sequence[str], order: Sequence[Column], names: Sequence[str]) -> DataFrame:
    """Exclusive running sums of the `__v_` columns in (bucket, order) order, per group.

    Groups may be as many as rows, and what rows are exploded from says little of their number; so the offsets of groups are
    merged with the rows and never broadcast.
    """
    totals = work.groupBy(*by, _BUCKET).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in names])
    before = W.partitionBy(*(by or [F.lit(0)])).orderBy(_BUCKET).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(c).alias(f"__k_{c}") for c in [*by, _BUCKET]],
        *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in names],
    )
    local = W.partitionBy(*by, _BUCKET).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    summed = work.withColumns({f"__l_{n}": F.coalesce(F.sum(f"__v_{n}").over(local), F.lit(0)) for n in names})
    same, nullable = F.lit(True), {f.name for f in work.schema if f.nullable}
    for c in [*by, _BUCKET]:  # plain equality keeps the rows where the sums have dealt them
        key = F.col(f"__k_{c}")
        same = same & (F.col(c).eqNullSafe(key) if c in nullable else F.col(c) == key)
    return summed.join(offsets.hint("merge") if by else offsets, same).select(*kept, *[(F.col(f"__o_{n}") + F.col(f"__l_{n}")).alias(n) for n in names])


def in_ranges(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """`df` dealt by ranges of `order` and written, with the number of each row's range; rows equal in the order share one."""
    return cut_lineage(df.repartitionByRange(*order).withColumn(_BUCKET, F.spark_partition_id()))


def ranged_sums(df: DataFrame, by: Sequence[str], order: Sequence[Column], **values: Column) -> DataFrame:
    """For each named value, its exclusive running sum per group in `order`; the values are non-null numbers."""
    work = df.withColumns({f"__v_{n}": v for n, v in values.items()})
    kept = [c for c in df.columns if c not in values]
    return _sums(in_ranges(work, [*[F.col(c) for c in by], *order]), kept, by, order, list(values))


def bucketed_sums(df: DataFrame, by: Sequence[str], bucket: Column, order: Sequence[Column], **values: Column) -> DataFrame:
    """`ranged_sums` where `bucket`, a monotone function of the order, already spreads the rows evenly, as digits of a digest do."""
    work = df.withColumn(_BUCKET, bucket).withColumns({f"__v_{n}": v for n, v in values.items()})
    return _sums(work, [c for c in df.columns if c not in values], by, order, list(values))


def ranged_rank(df: DataFrame, by: Sequence[str], order: Sequence[Column], out: str = "rank") -> DataFrame:
    """0-based position of each row in its group, in `order`."""
    return ranged_sums(df, by, order, **{out: F.lit(1).cast("long")})


def bucketed_rank(df: DataFrame, by: Sequence[str], bucket: Column, order: Sequence[Column], out: str = "rank") -> DataFrame:
    """0-based position of each row in its group, in (bucket, order) order."""
    return bucketed_sums(df, by, bucket, order, **{out: F.lit(1).cast("long")})


def prefix_ids(df: DataFrame, key: str, **sizes: Column) -> DataFrame:
    """For each named size, its exclusive prefix sum over all rows ordered by a key."""
    return ranged_sums(df, [], [F.col(key)], **sizes)


def deal_round_robin(df: DataFrame, by: Sequence[str], order: Sequence[Column], count: Column, out: str = "slot") -> DataFrame:
    """Deal the rows of each group in turn onto `count` slots."""
    ranked = ranged_rank(df, by, order, "__deal")
    return ranked.withColumn(out, F.pmod(F.col("__deal"), count)).drop("__deal")


def last_at_most(ascending: Column, value: Column) -> Column:
    """Index of the last number in a sorted array that is at most `value`, by halving; 0 if none is."""
    halvings = F.ceil(F.log2(F.size(ascending) + F.lit(1.0))).cast("int")

    def half(bounds: Column, _: Column) -> Column:
        middle = F.ceil((bounds["low"] + bounds["high"]) / 2).cast("int")
        reached = F.get(ascending, middle) <= value
        return F.struct(F.when(reached, middle).otherwise(bounds["low"]).alias("low"), F.when(reached, bounds["high"]).otherwise(F.greatest(middle - 1, bounds["low"])).alias("high"))

    whole = F.struct(F.lit(0).alias("low"), (F.size(ascending) - 1).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), halvings), whole, half, lambda bounds: bounds["low"])


def last_start(points: DataFrame, starts: DataFrame, by: Sequence[str], at: str, start: str) -> DataFrame:
    """`points` with `start`: the largest start of their group at or before `at`, null if there is none.

    Both are dealt by ranges of (group, place); each range looks back in itself and, at its beginning, to the last
    start of the ranges before. So one wide interval or one crowded place costs no more than others. `points` may not
    have a column named `start`.
    """
    here = F.col(at).cast("long")
    both = points.withColumns({"__place": here, "__point": F.lit(1), start: F.lit(None).cast("long")}).unionByName(
        starts.select(*by, F.col(start).cast("long").alias(start), F.col(start).cast("long").alias("__place"), F.lit(0).alias("__point")), allowMissingColumns=True
    )
    ranged = in_ranges(both, [*[F.col(c) for c in by], F.col("__place"), F.col("__point")])
    tops = ranged.filter("__point = 0").groupBy(*by, _BUCKET).agg(F.max(start).alias("__top"))
    groups = ranged.groupBy(*by, _BUCKET).agg(F.count("*").alias("__n")).join(tops, [*by, _BUCKET], "left")
    before = W.partitionBy(*(by or [F.lit(0)])).orderBy(_BUCKET).rowsBetween(W.unboundedPreceding, -1)
    carried = groups.select(*by, _BUCKET, F.max("__top").over(before).alias("__carried"))
    inside = W.partitionBy(*by, _BUCKET).orderBy("__place", "__point").rowsBetween(W.unboundedPreceding, 0)
    found = ranged.withColumn("__own", F.max(start).over(inside)).filter("__point = 1").join(carried, [*by, _BUCKET])
    return found.select(*points.columns, F.coalesce("__own", "__carried").alias(start))
