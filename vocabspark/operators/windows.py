"""Running flags and training-metric windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut_lineage
from .ordinals import ranged_rank

SMALLEST_DOUBLE_HALVINGS = 1075


def cumulative_any(df: DataFrame, by: list[str], order: str, flag: str, out: str) -> DataFrame:
    """True from the first row of a group on where `flag` holds. Groups are one sample's ranks."""
    upto = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(out, F.max(flag).over(upto))


def batch_positions(metrics: DataFrame, run: str = "run_id") -> DataFrame:
    """Batches of each run numbered from 0 in time order; a long run, or a burst in it, is spread over ranges of time."""
    return ranged_rank(metrics, [run], [F.col("ts"), F.col("event_id")], "batch_id")


def ewa_metrics(metrics: DataFrame, halflife: float, chunk: int = 1, run: str = "run_id", block: int | None = None) -> DataFrame:
    """Exponentially weighted loss and accuracy per batch with a running maximum of the accuracy.

    With decay d = 0.5 ** (1 / (halflife * chunk)), each sum is s_t = d * s_(t-1) + x_t. Blocks of
    consecutive batches are summed on their own with weights relative to the block, then each block
    gets the decayed state of the blocks before it. Only one row per block meets in a run-wide window.
    """
    steps = halflife * chunk
    block = block or max(2, min(4096, int(400 * steps)))
    names = {"loss": "loss_sum", "basis": "loss_basis", "correct": "correct", "tokens": "tokens"}
    offset = F.pmod(F.col("batch_id"), F.lit(block))
    work = metrics.withColumn("block", F.floor(F.col("batch_id") / block)).withColumn("off", offset)
    grow, fade = F.pow(F.lit(2.0), F.col("off") / steps), F.pow(F.lit(2.0), -F.col("off") / steps)
    inside = W.partitionBy(run, "block").orderBy("off").rowsBetween(W.unboundedPreceding, 0)
    local = work.withColumns({f"l_{n}": F.sum(F.col(c) * grow).over(inside) * fade for n, c in names.items()})
    # State at the end of each full block, carried over the run in blocks of blocks.
    last = work.groupBy(run, "block").agg(
        *[F.sum(F.col(c) * F.pow(F.lit(2.0), (F.col("off") - (block - 1)) / steps)).alias(f"e_{n}") for n, c in names.items()]
    )
    carry = _decayed_carry(last, run, [f"e_{n}" for n in names], block / steps)
    joined = local.join(carry, [run, "block"], "left")
    decay = F.pow(F.lit(2.0), -(F.col("off") + 1) / steps)
    state = {n: F.col(f"l_{n}") + F.coalesce(F.col(f"e_{n}"), F.lit(0.0)) * decay for n in names}
    out = joined.select(
        run, "batch_id", "block", (state["loss"] / state["basis"]).alias("ewa_loss"), (state["correct"] / state["tokens"]).alias("ewa_top1")
    )
    out = cut_lineage(out)  # read twice below
    tops = out.groupBy(run, "block").agg(F.max("ewa_top1").alias("top"))
    earlier = W.partitionBy(run).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = tops.select(run, "block", F.max("top").over(earlier).alias("before"))
    here = W.partitionBy(run, "block").orderBy("batch_id").rowsBetween(W.unboundedPreceding, 0)
    running = out.withColumn("own", F.max("ewa_top1").over(here)).join(before, [run, "block"])
    return running.select(run, "batch_id", "ewa_loss", "ewa_top1", F.greatest("own", "before").alias("ewa_top1_max"))


def _decayed_carry(last: DataFrame, run: str, columns: list[str], halvings: float) -> DataFrame:
    """For each block, the decayed sum of the end states of all blocks before it.

    A block's end state fades by 2**-halvings per block. Consecutive blocks form parts of about 400
    halvings, summed with weights relative to the part. Between parts a state fades by 2**-400 or
    so per part, so beyond a few parts its share is below the smallest double: `lag` over those few
    is the whole sum. Batch numbers are dense, so blocks and parts have no gaps.
    """
    span = max(1, int(400 / halvings))
    work = last.withColumn("part", F.floor(F.col("block") / span)).withColumn("poff", F.pmod(F.col("block"), F.lit(span)))
    before = W.partitionBy(run, "part").orderBy("poff").rowsBetween(W.unboundedPreceding, -1)
    grow, fade = F.pow(F.lit(2.0), F.col("poff") * halvings), F.pow(F.lit(2.0), (1 - F.col("poff")) * halvings)
    local = work.select(
        run, "block", "part", "poff", *[(F.coalesce(F.sum(F.col(c) * grow).over(before), F.lit(0.0)) * fade).alias(c) for c in columns]
    )
    to_end = F.pow(F.lit(2.0), (F.col("poff") - (span - 1)) * halvings)
    ends = work.groupBy(run, "part").agg(*[F.sum(F.col(c) * to_end).alias(c) for c in columns])
    by_part = W.partitionBy(run).orderBy("part")
    reach = range(1, 2 + int(SMALLEST_DOUBLE_HALVINGS / (halvings * span)))
    state = lambda c: sum((F.lag(c, j, 0.0).over(by_part) * F.lit(2.0 ** -(halvings * span * (j - 1))) for j in reach), F.lit(0.0))
    states = ends.select(run, "part", *[state(c).alias(f"q_{c}") for c in columns])
    joined = local.join(states, [run, "part"])
    fading = F.pow(F.lit(2.0), -F.col("poff") * halvings)
    return joined.select(run, "block", *[(F.col(c) + F.col(f"q_{c}") * fading).alias(c) for c in columns])


def chunk_stats(metrics: DataFrame, chunk: int, value: str, run: str = "run_id") -> DataFrame:
    """Per chunk of batches: min, mean, sample deviation (0 for one value) and max."""
    numbered = metrics.withColumn("chunk", F.floor(F.col("batch_id") / chunk))
    return numbered.groupBy(run, "chunk").agg(
        F.count("*").alias("n"), F.min(value).alias("low"), F.avg(value).alias("mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.max(value).alias("high"),
    )
