"""Books of request batches whose answers arrive as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY_MS = 86_400_000


class BadBatches(StatefulProcessor):
    """Per run: the number of bad batches so far. Closed batches come in order of their closing time, so a stop is
    flagged at the same batch however the input is cut; the state ends `keep_ms` after the run's last batch."""

    def __init__(self, max_bad: int, keep_ms: int) -> None:
        self.max_bad, self.keep_ms = max_bad, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bad", "n_bad long, end_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        closed = pd.concat(rows).sort_values(["closed_at", "batch"])  # a row for each batch that closed
        n_bad = self.state.get()[0] if self.state.exists() else 0
        closed["n_bad"] = n_bad + (closed["done"] & ~closed["accepted"]).cumsum()
        closed["stop"] = closed["n_bad"] >= self.max_bad
        end = int(closed["closed_at"].iloc[-1].timestamp() * 1000) + self.keep_ms
        self.state.update((int(closed["n_bad"].iloc[-1]), end))
        self.handle.registerTimer(end)
        yield closed

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists() and self.state.get()[1] <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        return
        yield

    def close(self) -> None:
        pass


def stream_batch_health(
    responses: DataFrame, watermark: str, patience: str = "1 day", min_valid: float = 0.8, max_bad: int = 5, keep_days: int = 365
) -> DataFrame:
    """Closed request batches (run, batch), each once: done, accepted if enough answers are valid, bad batches so far, stop.

    Columns in: run, batch, request_id, ts, valid, expected. Copies of an answer within the watermark count once. A batch closes when
    no answer has come for `patience` of event time, once the watermark has passed that, and its state ends; from the
    batch on that is the run's `max_bad`th done but not accepted, `stop` tells the sender to give up.
    """
    timed = responses.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    once = timed.dropDuplicatesWithinWatermark(["run", "batch", "request_id"])
    counts = once.groupBy("run", "batch", F.session_window("ts", patience).alias("span")).agg(
        F.max("expected").alias("expected"), F.count("*").alias("n_answers"), F.count_if("valid").alias("n_valid")
    )
    closed = counts.select("run", "batch", F.window_time("span").alias("closed_at"), "expected", "n_answers", "n_valid").withColumns({
        "done": F.col("n_answers") >= F.col("expected"), "accepted": F.col("n_valid") >= F.col("expected") * F.lit(min_valid),
    })
    types = dict(closed.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in closed.columns) + ", n_bad long, stop boolean"
    return closed.groupBy("run").transformWithStateInPandas(BadBatches(max_bad, keep_days * DAY_MS), schema, "append", "eventTime", eventTimeColumnName="closed_at")
