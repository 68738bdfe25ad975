"""Nearest prototypes of embeddings as they arrive, whatever the number of prototypes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.vectors import PROTO_BLOCK, PROTO_LIMIT_BYTES, ROWS_PER_SLICE, prepare, top_prototypes


def stream_classify(
    protos: DataFrame, keep: list[str], k: int = 1, vec: str = "embedding",
    limit: int = PROTO_LIMIT_BYTES, block: int = PROTO_BLOCK, slice_rows: int = ROWS_PER_SLICE,
) -> Callable[[DataFrame], DataFrame]:
    """What makes of a micro-batch of embeddings its rows of nearest prototypes, for `run_available(stream, each=...)`.

    The prototypes are made ready once: a matrix within the limits, else blocks written for all micro-batches, which
    slices of each meet. `keep` must identify a row.
    """
    ready = prepare(protos, limit, block)
    return lambda batch: top_prototypes(batch, ready, k, keep, vec, limit, block, slice_rows)
