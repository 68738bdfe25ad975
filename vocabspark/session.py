"""Session set-up shared by the entry points, the tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cpus: int | str | None = None, app: str = "vocabspark", **conf: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own session.

    Small test tables would be coalesced into one or two tasks by their size; the work per byte is
    high here, so the smallest partition is set low enough to keep all cores busy.
    """
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    local = {
        "spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": "12g",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    }
    for key, value in {**DEFAULTS, **local, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names; a local one only where none is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="vocabspark-checkpoint-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df` as a written table in the shared checkpoint folder.

    A lost executor then does not replay the whole history, a table that is read several times is
    computed once, and the planner knows its true size.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.written_path = path
    return written


def discard(*tables: DataFrame) -> None:
    """Delete tables that `cut_lineage` has written, once all that is made of them has been written itself."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
