"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, discard

__all__ = ["aside", "cut_lineage", "discard", "map_rows", "table", "text_of"]

#: Rows that a Python worker turns into Python objects at a time.
SLICE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def aside(df: DataFrame, *names: str) -> tuple[DataFrame, list[str], Callable[[DataFrame], DataFrame]]:
    """`df` with its columns that begin as helper columns do (two underscores) renamed, what `names` are now, and a function that
    gives such columns of a result their own names back."""
    new: dict[str, str] = {}
    for c in df.columns:
        if c.startswith("__"):
            name = f"own{c}"
            while name.lower() in {x.lower() for x in [*df.columns, *new.values()]}:
                name = f"own_{name}"
            new[c] = name
    back = {v: k for k, v in new.items()}
    return df.withColumnsRenamed(new), [new.get(n, n) for n in names], lambda out: out.withColumnsRenamed(back)


def text_of(column: str):
    """The text column as a string, null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def map_rows(df: DataFrame, keep: list[str], start: Callable[[], Callable[..., tuple]], fields: list[tuple[str, T.DataType]]) -> DataFrame:
    """`df` with its `keep` columns as they are, and new `fields` made row by row from the other columns.

    `start` runs once in each task and gives the function that is called with the other columns'
    values. Only a slice of a batch is held as Python objects, so memory is bounded by the texts in it.
    """
    others = [c for c in df.columns if c not in keep]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(n, t) for n, t in fields])
    kinds = [to_arrow(t) for _, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = start()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                made = [each(*row) for row in zip(*(part.column(c).to_pylist() for c in others))]
                new = [pa.array([m[i] for m in made], type=kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *new], names=schema.names)

    return df.select(*keep, *others).mapInArrow(run, schema)


def to_arrow(kind: T.DataType) -> Any:
    plain = {
        T.StringType(): pa.string(), T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.DoubleType(): pa.float64(),
        T.BooleanType(): pa.bool_(), T.BinaryType(): pa.binary(),
    }
    return pa.list_(to_arrow(kind.elementType)) if isinstance(kind, T.ArrayType) else plain[kind]
