"""Stateful streams: the same rows however the input is cut into micro-batches, and state that ends."""

from __future__ import annotations

import os
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from vocabspark import streaming as S
from vocabspark.operators import annotation as A
from vocabspark.operators import vectors as VS
from vocabspark.operators import windows as WN

RULE = A.OpinionRule(2, 5, 0.78)


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    """Events in time order; a third of them are of one user."""
    frame = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).toPandas()
    frame = frame.sort_values(["ts", "event_id"]).reset_index(drop=True).head(600)
    frame.loc[frame.index % 3 == 0, "user_id"] = 7
    frame["ts"] = frame["ts"].astype("datetime64[us]")
    return frame


def in_files(spark, events: pd.DataFrame, folder, cuts: int, disorder: int = 0):
    """A stream of one file a micro-batch; `disorder` swaps so many rows on both sides of each cut."""
    rows = [len(events) * i // cuts for i in range(cuts + 1)]
    parts = [list(range(a, b)) for a, b in zip(rows, rows[1:])]
    for one, two in zip(parts, parts[1:]):
        one[-disorder or len(one) :], two[:disorder] = two[:disorder], one[-disorder or len(one) :]
    folder.mkdir(exist_ok=True)
    for i, part in enumerate(parts):
        name = folder / f"events_{i:03d}.parquet"
        events.iloc[part].to_parquet(name)
        os.utime(name, (time.time() - 1000 + i, time.time() - 1000 + i))
    schema = spark.read.parquet(str(folder)).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def opinions(df):
    return df.select(F.col("user_id").cast("string").alias("image"), F.col("event_type").alias("noun"), "ts", "event_id", (F.col("value") > 20).alias("opinion"))


CUTS = [(1, 0), (3, 4), (20, 2)]


@pytest.mark.parametrize("cuts, disorder", CUTS)
def test_consensus(spark, events, tmp_path, cuts, disorder):
    source = opinions(in_files(spark, events, tmp_path, cuts, disorder))
    rows = S.run_to_end(source, lambda o: S.stream_consensus(o, RULE, "7 days"), "update")
    got = S.latest_updates(rows, ["image", "noun"])
    accepted = A.accept_opinions(opinions(spark.createDataFrame(events)), RULE)
    want = A.consensus(accepted, RULE).select("image", "noun", "n", "n_correct", "category")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def metrics(df):
    return df.select(
        F.col("user_id").alias("run_id"), "ts", "event_id", F.col("value").alias("loss_sum"), F.lit(1.0).alias("loss_basis"),
        (F.col("event_id") % 4).alias("correct"), F.lit(4).alias("tokens"),
    )


@pytest.mark.parametrize("cuts, disorder", CUTS)
def test_running_metrics(spark, events, tmp_path, cuts, disorder):
    """A third of the rows are of one run; its state sees one row for each of its windows."""
    source, path = metrics(in_files(spark, events, tmp_path / "in", cuts, disorder)), f"{tmp_path}/job"
    got = {r["run_id"]: r for r in S.run_totals(S.run_ewa(source, 8, "6 hours", "7 days", path=path)).collect()}
    batch = WN.ewa_metrics(WN.batch_positions(metrics(spark.createDataFrame(events))), 8)
    want = batch.groupBy("run_id").agg(F.max("batch_id").alias("last"), F.max_by("ewa_loss", "batch_id").alias("loss"), F.max_by("ewa_top1", "batch_id").alias("top1"), F.max("ewa_top1").alias("best")).collect()
    assert len(got) == len(want)
    for w in want:
        r = got[w["run_id"]]
        assert r["n_batches"] == w["last"] + 1
        assert [r["ewa_loss"], r["ewa_top1"], r["ewa_top1_max"]] == pytest.approx([w["loss"], w["top1"], w["best"]], rel=1e-9)
    windows, entering = spark.read.parquet(f"{path}/windows/rows"), spark.read.parquet(f"{path}/entering/rows")
    hot = windows.filter("run_id = 7").agg(F.count("*"), F.max("n"), F.sum("n")).first()
    assert hot[2] >= len(events) // 3 and hot[1] < 20
    assert entering.filter("run_id = 7").count() == hot[0] and "rows" not in entering.columns


def answers(df):
    return df.select(
        F.expr("event_id div 10 % 2").alias("run"), F.expr("event_id div 10").alias("batch"), F.col("event_id").alias("request_id"), "ts",
        (F.col("event_type") != "error").alias("valid"), F.lit(10).alias("expected"),
    )


@pytest.mark.parametrize("cuts, disorder", CUTS)
def test_batch_books(spark, events, tmp_path, cuts, disorder):
    """Batches close by silence; each request counts once; the stop is flagged at the same batch; states end."""
    source = answers(in_files(spark, events, tmp_path, cuts, disorder)).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    got = S.run_to_end(source, lambda a: S.stream_batch_health(a, "7 days", "3 days", max_bad=3)).drop("batch_id")
    frame, want = answers(spark.createDataFrame(events)).toPandas().sort_values("ts"), []
    for (run, batch), rows in frame.groupby(["run", "batch"]):
        cut = (rows["ts"].diff() >= pd.Timedelta(days=3)).cumsum()
        for _, part in rows.groupby(cut):
            want.append((run, part["ts"].iloc[-1] + pd.Timedelta(days=3), batch, len(part), int(part["valid"].sum())))
    bad, rows = {}, []
    for run, at, batch, n, valid in sorted(want):
        bad[run] = bad.get(run, 0) + (n >= 10 and valid < 8)
        rows.append((run, batch, n, valid, n >= 10, valid >= 8, bad[run], bad[run] >= 3))
    assert sorted(map(tuple, got.select("run", "batch", "n_answers", "n_valid", "done", "accepted", "n_bad", "stop").collect())) == sorted(rows)


def test_state_ends(spark, events, tmp_path):
    """After the watermark has passed everything, no state row is left but that of the end mark itself."""
    source = answers(in_files(spark, events, tmp_path / "in", 3))
    left = []

    def run(stream, path):
        query = stream.writeStream.foreachBatch(lambda batch, _: batch.count()).outputMode("append").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        left.append([s["numRowsTotal"] for s in query.lastProgress["stateOperators"]])

    job = lambda a: S.stream_batch_health(a, "1 hour", "3 days", keep_days=30)
    from vocabspark.streaming.run import _states_on_disk

    with _states_on_disk(spark):
        S.run_to_end(source, job, run=run, path=f"{tmp_path}/job")
    assert sum(left[0]) > 10 and sum(left[1]) == 2, left  # the mark's window and its place among the seen


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_classify_in_blocks(spark, sf_dir, tmp_path, limit):
    """Blocks written once and met by each micro-batch give the rows of the batch operator."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    for i in range(3):
        table.filter(F.col("vec_id") % 3 == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    protos = table.filter("vec_id < 90").select(F.col("vec_id").alias("class_id"), F.col("embedding").cast("array<double>").alias("vector"))
    each = S.stream_classify(protos, ["vec_id"], 3, limit=limit, block=16, slice_rows=50)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = S.run_available(stream, each=each)
    assert got.select("batch_id").distinct().count() == 3
    rounded = lambda df: sorted((r.vec_id, r["rank"], r.class_id, round(r.dot, 9)) for r in df.collect())
    assert rounded(got) == rounded(VS.top_prototypes(table, protos, 3, ["vec_id"]))
