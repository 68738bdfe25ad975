"""Mixture-controlled packing: deficit round robin over source queues.

Each source is a queue of its documents' tokens, cut into equal slots. A window takes a fixed number of slots,
and each source gains credit in proportion to its weight; the next slot goes to the source whose credit
is owed most, so the deficits carry over from window to window. The order of slot j of a source of weight w is
that of (j + 1/2) / w, ties by source, which can be counted from the sources' totals alone: any task finds the
window of any slot, and the deficits carried into it, without running the windows before it. When a queue is empty the others go on
in proportion. By default a source's weight is its share of all tokens, so all queues end
together. The rest of each queue that fills no slot follows after the last full slot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import SLICE, cut_lineage
from .tokens import encoder

WINDOW, SLOT = 2048, 128


def _encode(path: str, pattern: str, end_id: int):
    """For batches of (id, source, text): the ids with the end id, and where they start in the task's queue of that source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, queued = encoder(path, pattern), TaskContext.get().partitionId(), {}
        end = end_id.to_bytes(2, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ids = [encode(t or "") + end for t in part.column("__text").to_pylist()]
                starts = []
                for source, own in zip(part.column("__source").to_pylist(), ids):
                    starts.append(queued.get(source, 0))
                    queued[source] = starts[-1] + len(own) // 2
                new = [pa.array([task] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *new], names=[part.schema.names[0], "__source", "__task", "__start", "__ids"])

    return run


class Schedule:
    """Where the slots of each source stand; `totals` and `weights` by source number."""

    def __init__(self, totals: list[int], weights: list[float] | None, slot: int) -> None:
        self.slot = slot
        self.full = np.array([t // slot for t in totals], dtype=np.int64)
        rest = np.array([t % slot for t in totals], dtype=np.int64)
        self.rest_at = self.full.sum() * slot + np.cumsum(rest) - rest
        self.weights = np.maximum(self.full, 1).astype(float) if weights is None else np.array(weights, dtype=float)

    def time(self, source, j):
        return (j + 0.5) / self.weights[source]

    def place(self, source: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The global token position of slot j of each source; j may be the rest beyond the last full slot."""
        rank, when = np.zeros(len(j), dtype=np.int64), self.time(source, j)
        for s in range(len(self.full)):  # slots of s that come before: count by the formula, then settle rounding
            n = np.floor(when * self.weights[s] - 0.5).astype(np.int64)
            first = lambda k, s=s: (self.time(s, k) < when) | ((self.time(s, k) == when) & (s < source))
            for step in (1, 1, -1, -1):
                n = np.where(first(n) if step == 1 else ~first(n - 1), n + step, n)
            rank += np.where(s == source, np.minimum(j, self.full[s]), np.clip(n, 0, self.full[s]))
        return np.where(j >= self.full[source], self.rest_at[source], rank * self.slot)


def _cut(schedule: Schedule, window: int):
    """For batches of encoded documents with their place in their source's queue: the pieces."""
    slot = schedule.slot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ids = part.column("__ids").to_pylist()
                n = np.array([len(x) // 2 for x in ids], dtype=np.int64)
                begin = part.column("__at").to_numpy(zero_copy_only=False).astype(np.int64)
                source = part.column("__number").to_numpy(zero_copy_only=False).astype(np.int64)
                first, last = begin // slot, (begin + n - 1) // slot
                count = last - first + 1
                doc = np.repeat(np.arange(len(n)), count)
                j = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                low, high = np.maximum(j * slot, begin[doc]), np.minimum((j + 1) * slot, begin[doc] + n[doc])
                where = schedule.place(source[doc], j) + low - j * slot
                over = np.flatnonzero(where % window + high - low > window)  # only a rest can cross a window's end
                cross = low[over] + window - where[over] % window
                low, high, where = np.insert(low, over + 1, cross), np.insert(high, over, cross), np.insert(where, over + 1, where[over] + cross - low[over])
                doc = np.insert(doc, over + 1, doc[over])
                # a piece goes on where the document's next slot follows in the same window
                new = np.ones(len(doc), dtype=bool)
                new[1:] = (doc[1:] != doc[:-1]) | (where[1:] != where[:-1] + high[:-1] - low[:-1]) | (where[1:] % window == 0)
                head = np.flatnonzero(new)
                tail = np.append(head[1:], len(doc)) - 1
                own, start, length = doc[head], low[head] - begin[doc[head]], high[tail] - low[head]
                wide = [np.frombuffer(x, "<u2").astype("<u4").tobytes() for x in ids]
                cut = [wide[d][4 * a : 4 * (a + b)] for d, a, b in zip(own.tolist(), start.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(own)), pa.array(start), pa.array(length), pa.array(n[own]), pa.array(where[head] // window), pa.array(where[head] % window), pa.array(cut, pa.binary())],
                    names=[part.schema.names[0], "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
                )

    return run


def pack(
    docs: DataFrame, id_col: str, text_col: str, source_col: str, tokenizer: str, pattern: str,
    end_id: int = 1, window: int = WINDOW, slot: int = SLOT, weights: dict[str | None, float] | None = None,
) -> DataFrame:
    """Pack all rows of `docs` into windows of `window` tokens, mixed by source.

    One row for each piece: id_col, start, length, doc_tokens, sequence_id, offset, and ids (little-endian
    unsigned 32-bit). Every id of a document, the end id included, lies in exactly one piece. All windows but the
    last are full. Null texts count as empty (the end id alone), null sources are a source of their own,
    repeated rows are packed each; an empty table gives no piece. `weights` (by source; every
    source needs one above 0) sets other proportions, as long as no queue is empty. Other columns are ignored.

    The ids are written once, with each document's place in its task's queue; the tasks' totals by source, a
    small table, give each task's place in the source's queue. So the texts are never shuffled. The sources
    are the mixture's components: one row of each comes to the driver.
    """
    if window % slot:
        raise ValueError("a window must hold whole slots")
    own = docs.select(F.col(id_col), F.col(source_col).cast("string").alias("__source"), F.col(text_col).cast("string").alias("__text"))
    fields = [T.StructField("__task", T.IntegerType()), T.StructField("__start", T.LongType()), T.StructField("__ids", T.BinaryType())]
    schema = T.StructType([own.schema[0], own.schema[1], *fields])
    encoded = cut_lineage(own.mapInArrow(_encode(tokenizer, pattern, end_id), schema))
    size = F.octet_length("__ids") / 2
    parts = cut_lineage(encoded.groupBy("__source", "__task").agg(F.sum(size).cast("long").alias("__n")))
    sources = sorted(parts.groupBy("__source").agg(F.sum("__n").alias("n")).collect(), key=lambda r: (r[0] is None, r[0] or ""))
    shares = None if weights is None else [weights[r[0]] for r in sources]
    schedule = Schedule([r.n for r in sources], shares, slot)
    numbers = docs.sparkSession.createDataFrame([(r[0], i) for i, r in enumerate(sources)], "__s string, __number int")
    before = W.partitionBy("__source").orderBy("__task").rowsBetween(W.unboundedPreceding, -1)
    numbered = parts.join(numbers, F.col("__source").eqNullSafe(F.col("__s")))
    # written, so that the planner knows its size: while it is small the ids need no shuffle
    places = cut_lineage(numbered.select("__s", F.col("__task").alias("__t"), "__number", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")))
    placed = encoded.join(places, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__task") == F.col("__t")))
    rows = placed.select(F.col(id_col), "__number", (F.col("__before") + F.col("__start")).alias("__at"), "__ids")
    made = [T.StructField(n, T.LongType()) for n in ("start", "length", "doc_tokens", "sequence_id", "offset")]
    return rows.mapInArrow(_cut(schedule, window), T.StructType([rows.schema[0], *made, T.StructField("ids", T.BinaryType())]))
