"""Streams over several micro-batches against their batch form."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vocabspark import streaming as S


@pytest.fixture(scope="module")
def pieces(spark, sf_dir, tmp_path_factory):
    """The events table cut into four time-ordered files, read one file per micro-batch."""
    folder = tmp_path_factory.mktemp("events")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    bounds = events.approxQuantile("event_id", [0.25, 0.5, 0.75], 0)
    edges = [-1, *bounds, 1e18]
    import os
    import time

    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        part = events.filter((F.col("event_id") > low) & (F.col("event_id") <= high)).toPandas()
        part["ts"] = part["ts"].astype("datetime64[us]")
        name = folder / f"events_{i}.parquet"
        part.to_parquet(name)
        os.utime(name, (time.time() - 100 + i, time.time() - 100 + i))
    return str(folder)


def stream(spark, folder):
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("kind", [dict(), dict(slide="12 hours"), dict(session_gap="40 hours", by=("user_id",))])
def test_usage_windows(spark, pieces, kind):
    usage = lambda df: df.select("ts", "user_id", F.col("event_id").alias("prompt_tokens"), F.lit(1).alias("completion_tokens"))
    rows = S.run_available(S.stream_usage(usage(stream(spark, pieces)), "1 day", "1 hour", **kind), "append")
    static = spark.read.parquet(pieces)
    span = F.session_window("ts", "40 hours") if "session_gap" in kind else F.window("ts", "1 day", kind.get("slide"))
    want = usage(static).groupBy(*kind.get("by", ()), span.alias("s")).agg(F.count("*").alias("n"), F.sum("prompt_tokens").alias("p"))
    # Compared here and not in the plan: a filter on the end of a merged session must not move below the merge.
    watermark = static.agg(F.max("ts") - F.expr("INTERVAL 1 HOUR")).first()[0]
    got = {(r["start"], r["requests"], r["prompt_tokens"]) for r in rows.collect()}
    assert got == {(r["s"]["start"], r["n"], r["p"]) for r in want.collect() if r["s"]["end"] <= watermark}


def test_tables_that_are_files_or_folders(spark, tmp_path):
    rows = spark.range(20).withColumn("x", F.col("id") * 2)
    rows.repartition(3).write.parquet(f"{tmp_path}/many.parquet")
    rows.toPandas().to_parquet(f"{tmp_path}/one.parquet")
    rows.toPandas().to_parquet(f"{tmp_path}/one_more.parquet")
    spark.range(5).write.parquet(f"{tmp_path}/other.parquet")
    for name, times in (("many", 1), ("one", 2)):
        got = S.run_available(S.read_table_stream(spark, str(tmp_path), name)).select("id", "x")
        assert sorted(map(tuple, got.collect())) == sorted([(i, 2 * i) for i in range(20)] * times), name
