"""Exponentially weighted training metrics on a stream.

Three steps, of which only the middle one has a run's windows in order, as one small row each:

1. the rows of a run and a span of time, in order, with their decayed sums: an aggregate by (run, window) that the watermark closes;
2. the state each window begins with: a fold over the windows' sums, in a stateful processor;
3. the metrics after each row, from the window's rows and the state it began with.

So the rows of a hot run are spread over its windows, and nothing depends on how the input is cut into micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .run import append_available, run_to_end, stream_folder

SUMS = {"loss": "loss_sum", "basis": "loss_basis", "correct": "correct", "tokens": "tokens"}


def _decay(halflife: float, chunk: int) -> float:
    return 2.0 ** (-1 / (halflife * chunk))


def _after(decay: float, state: Column, row: Column) -> dict[str, Column]:
    return {s: state[s] * F.lit(decay) + row[c].cast("double") for s, c in SUMS.items()}


def stream_windows(metrics: DataFrame, halflife: float, span: str, watermark: str, chunk: int = 1) -> DataFrame:
    """Closed windows (run_id, start): n, the rows in (ts, event_id) order, and their sums decayed to the window's end.

    `span` bounds the rows of a run that are held together. Rows later than the watermark are left out; those without a run have
    windows but, having no state, no metrics. No filter on the run stands here: it would move below the watermark and take the end mark out.
    """
    timed = metrics.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    row = F.struct("ts", "event_id", *SUMS.values())
    windows = timed.groupBy("run_id", F.window("ts", span).alias("w")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(row)).alias("rows"))
    decay = _decay(halflife, chunk)
    zero = F.struct(*[F.lit(0.0).alias(s) for s in SUMS])
    sums = F.aggregate("rows", zero, lambda a, r: F.struct(*[x.alias(s) for s, x in _after(decay, a, r).items()]))
    return windows.select("run_id", F.col("w.start").alias("start"), "n", "rows", sums.alias("sums"))


class Entering(StatefulProcessor):
    """Per run: the decayed sums so far. Hands out the sums each window begins with; a timer ends the state of a run once
    the watermark has passed its last window."""

    def __init__(self, decay: float) -> None:
        self.decay = decay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = ", ".join(f"{s} double" for s in SUMS)
        self.state = handle.getValueState("sums", f"last_ms long, n long, {fields}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        _, n, *sums = self.state.get() if self.state.exists() else (0, 0, *[0.0] * len(SUMS))
        windows, out = pd.concat(rows).sort_values("start"), []  # a row for each window, without its rows
        for start, size, *own in windows[["start", "n", *SUMS]].itertuples(index=False):
            out.append((key[0], start, n, *sums))
            fade = self.decay ** int(size)
            n, sums = n + int(size), [float(s * fade + x) for s, x in zip(sums, own)]
        last = int(windows["start"].iloc[-1].timestamp() * 1000)
        self.state.update((last, n, *sums))
        self.handle.registerTimer(last)
        yield pd.DataFrame(out, columns=["run_id", "start", "n_before", *SUMS])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists() and self.state.get()[0] <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        return
        yield

    def close(self) -> None:
        pass


def stream_entering(windows: DataFrame, halflife: float, chunk: int = 1, keep_days: int = 365) -> DataFrame:
    """(run_id, start, n_before, sums): what each window of `stream_windows` begins with.

    Windows must come in order of time, as they close. A run's state ends `keep_days` of event time after its last window.
    """
    small = windows.select("run_id", "start", "n", *[F.col(f"sums.{s}").alias(s) for s in SUMS]).withWatermark("start", f"{keep_days} days")
    schema = f"run_id {dict(windows.dtypes)['run_id']}, start timestamp, n_before long, " + ", ".join(f"{s} double" for s in SUMS)
    return small.groupBy("run_id").transformWithStateInPandas(Entering(_decay(halflife, chunk)), schema, "append", "eventTime")


def window_metrics(windows: DataFrame, entering: DataFrame, halflife: float, chunk: int = 1) -> DataFrame:
    """(run_id, start, n_batches, ewa_loss, ewa_top1, ewa_top1_max): after each window, the maximum being over the window's rows."""
    both = windows.select("run_id", "start", "n", "rows").join(entering, ["run_id", "start"])
    decay = _decay(halflife, chunk)
    begin = F.struct(*[F.col(s).alias(s) for s in SUMS], F.lit(0.0).alias("best"))

    def step(a, r):
        now = _after(decay, a, r)
        return F.struct(*[x.alias(s) for s, x in now.items()], F.greatest(a["best"], F.try_divide(now["correct"], now["tokens"])).alias("best"))

    done = both.withColumn("end", F.aggregate("rows", begin, step))
    return done.select(
        "run_id", "start", (F.col("n_before") + F.col("n")).alias("n_batches"), F.try_divide("end.loss", "end.basis").alias("ewa_loss"),
        F.try_divide("end.correct", "end.tokens").alias("ewa_top1"), F.col("end.best").alias("ewa_top1_max"),
    )


def run_ewa(metrics: DataFrame, halflife: float, span: str = "1 day", watermark: str = "1 hour", chunk: int = 1, path: str | None = None) -> DataFrame:
    """`window_metrics` of all that a stream of metrics (run_id, ts, event_id, loss_sum, loss_basis, correct, tokens) has."""
    spark = metrics.sparkSession
    path = path or stream_folder(spark)
    closed = run_to_end(metrics, lambda m: stream_windows(m, halflife, span, watermark, chunk), run=append_available, path=f"{path}/windows")
    windows = spark.read.parquet(closed)
    begun = append_available(stream_entering(spark.readStream.schema(windows.schema).parquet(closed), halflife, chunk), f"{path}/entering")
    return window_metrics(windows, spark.read.parquet(begun), halflife, chunk)


def run_totals(metrics: DataFrame) -> DataFrame:
    """Each run's state after its last window, with the best accuracy of all."""
    last = F.max_by(F.struct("n_batches", "ewa_loss", "ewa_top1"), "start").alias("r")
    return metrics.groupBy("run_id").agg(last, F.max("ewa_top1_max").alias("ewa_top1_max")).select("run_id", "r.*", "ewa_top1_max")
