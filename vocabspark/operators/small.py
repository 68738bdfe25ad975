"""Literal rows of known size."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def local_rows(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A few literal rows as a local relation with a known size."""
    schema = StructType.fromDDL(ddl)
    data = [dict(zip(schema.names, row)) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(data, schema=to_arrow_schema(schema)), schema=schema)
