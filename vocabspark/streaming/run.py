"""Reading tables as streams and running jobs over all that is there."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: Later than any row; pandas can hold it.
END_OF_TIME = "2200-01-01 00:00:00"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def read_table_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 100) -> DataFrame:
    """A Parquet table as a stream, with the table's schema: one file, files `name*.parquet` that arrive beside it, or a folder of files.

    `files_per_trigger` bounds a micro-batch.
    """
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/{name}*.parquet")


@contextmanager
def _states_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB: larger than memory, and needed by stateful processors."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def stream_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"


def run_available(stream: DataFrame, mode: str = "append", path: str | None = None, each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Process all available input, writing each micro-batch to its own folder, and read the rows back.

    `each` makes the rows of a micro-batch from its input, with all that batch tables can do. A repeated
    micro-batch overwrites its folder, so a restart does not write rows twice. Called again with the same `path`, it goes on.
    """
    spark = stream.sparkSession
    path = path or stream_folder(spark)
    schema = (each(spark.createDataFrame([], stream.schema)) if each else stream).schema

    def write(batch: DataFrame, batch_id: int) -> None:
        (each(batch) if each else batch).write.mode("overwrite").parquet(f"{path}/rows/batch_id={batch_id}")

    with _states_on_disk(spark):
        started = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.read.schema(schema.add("batch_id", "long")).option("basePath", f"{path}/rows").parquet(f"{path}/rows")


def append_available(stream: DataFrame, path: str) -> str:
    """Process all available input into a Parquet table, each row once; the folder, which may be read as a stream in turn."""
    with _states_on_disk(stream.sparkSession):
        writer = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/rows")
        started = writer.trigger(availableNow=True).start()
    started.awaitTermination()
    return f"{path}/rows"


def run_to_end(source: DataFrame, job: Callable[[DataFrame], DataFrame], mode: str = "append", at: str = "ts", run: Callable | None = None, path: str | None = None):
    """`run_available` of `job(source)`, then once more with an end mark, so that all that waits for the watermark is handed out.

    The mark is a row of nulls whose time `at` lies beyond all others; jobs leave it out. `run(stream, path)` may take the place of `run_available`.
    """
    spark = source.sparkSession
    path = path or stream_folder(spark)
    run = run or (lambda stream, path: run_available(stream, mode, path))
    marks = f"{path}/marks"
    nulls = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in source.schema])
    nulls.limit(0).write.mode("append").parquet(marks)
    whole = source.unionByName(spark.readStream.schema(source.schema).parquet(marks))
    run(job(whole), path)
    nulls.withColumn(at, F.lit(END_OF_TIME).cast(source.schema[at].dataType)).write.mode("append").parquet(marks)
    return run(job(whole), path)


def latest_updates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last update of each key from an update-mode result."""
    fields = [c for c in rows.columns if c not in (*keys, "batch_id")]
    newest = F.max_by(F.struct(*fields), "batch_id")
    return rows.groupBy(*keys).agg(newest.alias("r")).select(*keys, "r.*")
