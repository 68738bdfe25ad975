"""Streaming jobs whose state Spark's own operators keep: usage windows and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.annotation import usage_cost
from ..operators.scoring import attach_category


def stream_usage(
    responses: DataFrame, window: str, watermark: str, slide: str | None = None, session_gap: str | None = None, by: tuple[str, ...] = ()
) -> DataFrame:
    """Usage and cost per window of `ts` and key; tumbling, sliding (with `slide`) or session windows (with `session_gap`).

    Rows later than the watermark are dropped. Session windows need at least one key.
    """
    if session_gap and not by:
        raise ValueError("session windows need a key")
    timed = responses.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    span = F.session_window("ts", session_gap) if session_gap else F.window("ts", window, slide) if slide else F.window("ts", window)
    sums = timed.groupBy(*by, span.alias("span")).agg(
        F.count("*").alias("requests"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens")
    )
    return sums.select(
        *by, F.col("span.start").alias("start"), F.col("span.end").alias("end"), "requests", "prompt_tokens", "completion_tokens",
        usage_cost(F.col("prompt_tokens"), F.col("completion_tokens")).alias("cost_usd"),
    )


def stream_score(preds: DataFrame, ann: DataFrame) -> DataFrame:
    """Predictions with their category as they arrive; the annotations are static."""
    return attach_category(preds, ann)
