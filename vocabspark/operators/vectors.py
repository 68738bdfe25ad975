"""Vector scoring: prototypes, nearest prototype, modality gap, shifts and summaries.

Embeddings are rows (id, embedding ARRAY<FLOAT>, ...). Prototypes are rows (class_id, vector).
Scoring is a block matrix product in Arrow batches. A prototype table within `PROTO_LIMIT_ROWS` and
`PROTO_LIMIT_BYTES` is broadcast as one matrix; a larger one is written out, cut into blocks and met
by slices of the embeddings, so neither side is ever whole in one task. No pair is written as a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import vectors as V
from ..session import cut_lineage
from .ordinals import ranged_rank

PROTO_LIMIT_BYTES = 64 * 1024 * 1024
PROTO_LIMIT_ROWS = 16_384
PROTO_BLOCK = 2048
TILE_CELLS = 1 << 20  # dot products that a task holds at a time: rows are taken in tiles of so many cells
ROWS_PER_SLICE = 20_000
HIST_BINS, HIST_MIN, HIST_MAX = 360, 0.0, 180.0


def mean_vectors(df: DataFrame, by: list[str], vec: str = "embedding", out: str = "vector") -> DataFrame:
    """Element-wise mean per group, with partial sums on the map side (no exploding)."""
    mean = Summarizer.mean(array_to_vector(F.col(vec).cast("array<double>")))
    return df.groupBy(*by).agg(vector_to_array(mean).alias(out))


def prototypes(df: DataFrame, class_col: str, vec: str = "embedding") -> DataFrame:
    """Unit class prototypes: normalised mean of the class's vectors (images, or prompt-ensemble texts)."""
    means = mean_vectors(df, [class_col], vec).withColumnRenamed(class_col, "class_id")
    return means.select("class_id", V.normalise(F.col("vector")).alias("vector"))


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column]) if len(column) else np.empty((0, 0))


def _list_matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix; the values are not copied row by row."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


@dataclass(frozen=True)
class Prototypes:
    """A prototype table made ready once, for one table of rows or the micro-batches of a stream.

    Within the limits it is one broadcast matrix; beyond them a written table whose rows know their block.
    """

    class_type: str
    shared: Broadcast | None
    blocks: DataFrame | None
    n_blocks: int


def prepare(protos: DataFrame | Prototypes, limit: int = PROTO_LIMIT_BYTES, block: int = PROTO_BLOCK) -> Prototypes:
    """Rows and bytes are counted first, so no larger table comes to the driver."""
    if isinstance(protos, Prototypes):
        return protos
    kind = dict(protos.dtypes)["class_id"]
    if limit > 0:
        size = protos.agg(F.count("*").alias("n"), F.sum(F.size("vector")).alias("elements")).first()
        if size.n <= PROTO_LIMIT_ROWS and 8 * (size.elements or 0) <= limit:
            head = protos.select("class_id", "vector").toArrow()
            rows = sorted(zip(head["class_id"].to_pylist(), head["vector"].to_pylist()))
            matrix = [r[0] for r in rows], _matrix([r[1] for r in rows])
            return Prototypes(kind, protos.sparkSession.sparkContext.broadcast(matrix), None, 1)
    written = cut_lineage(protos.select("class_id", "vector"))
    n_blocks = -(-written.count() // block)
    placed = ranged_rank(written, [], [F.col("class_id")], "__at").withColumn("__block", F.expr(f"__at div {block}").cast("int")).drop("__at")
    return Prototypes(kind, None, placed, n_blocks)


def _score_blocks(
    df: DataFrame, protos: DataFrame | Prototypes, keep: list[str], vec: str, schema: str,
    fn: Callable[[pd.DataFrame, list, np.ndarray, np.ndarray], pd.DataFrame], limit: int, block: int, slice_rows: int,
) -> tuple[DataFrame, bool]:
    """Run `fn(rows, class_ids, matrix, dots)` on every (batch of rows) x (block of prototypes).

    The flag says whether each row met all prototypes at once.
    """
    data = df.select(*keep, F.col(vec).alias("__vec"))
    ready = prepare(protos, limit, block)
    if ready.shared is not None:
        shared = ready.shared
        arrow = to_arrow_schema(StructType.fromDDL(schema))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, matrix = shared.value
            for batch in batches:
                tile = max(1, TILE_CELLS // max(1, len(ids)))
                for at in range(0, batch.num_rows, tile):
                    part = batch.slice(at, tile)
                    out = fn(part.select(keep).to_pandas(), ids, matrix, _list_matrix(part.column("__vec")) @ matrix.T)
                    yield pa.RecordBatch.from_pandas(out, schema=arrow, preserve_index=False)

        return data.mapInArrow(run, schema), True

    # A stream's micro-batches meet the blocks one by one, see `streaming.stream_classify`.
    n_slices = max(1, -(-df.count() // slice_rows))
    key = F.xxhash64(*[F.col(c) for c in keep])
    left = data.withColumn("__slice", F.pmod(key, F.lit(n_slices)).cast("int")).withColumn(
        "__block", F.explode(F.sequence(F.lit(0), F.lit(max(0, ready.n_blocks - 1))))
    )
    right = ready.blocks.withColumn("__slice", F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1))))

    def pair(rows: pd.DataFrame, classes: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(classes):
            return fn(rows.iloc[:0], [], np.empty((0, 0)), np.empty((0, 0)))
        classes = classes.sort_values("class_id")
        matrix = _matrix(classes["vector"])
        ids, tile = list(classes["class_id"]), max(1, TILE_CELLS // len(classes))
        parts = (rows.iloc[at : at + tile] for at in range(0, len(rows), tile))
        return pd.concat([fn(part, ids, matrix, _matrix(part["__vec"]) @ matrix.T) for part in parts])

    keys = ["__slice", "__block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(pair, schema), False


def _ddl(df: DataFrame, names: list[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"`{n}` {types[n]}" for n in names)


def top_prototypes(
    df: DataFrame, protos: DataFrame | Prototypes, k: int, keep: list[str], vec: str = "embedding",
    limit: int = PROTO_LIMIT_BYTES, block: int = PROTO_BLOCK, slice_rows: int = ROWS_PER_SLICE,
) -> DataFrame:
    """The k nearest prototypes per row by dot product (ties: smallest class), rank from 1.

    `keep` must identify a row.
    """
    protos = prepare(protos, limit, block)
    class_type = protos.class_type
    schema = f"{_ddl(df, keep)}, rank int, class_id {class_type}, dot double"

    def best(rows: pd.DataFrame, ids: list, matrix: np.ndarray, dots: np.ndarray) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({**{c: rows[c] for c in keep}, "rank": [], "class_id": [], "dot": []})
        n = min(k, dots.shape[1])
        if n < dots.shape[1] // 4:  # only those at or above the n-th largest, so that ties at the cut stay in class order
            cut = np.partition(dots, dots.shape[1] - n, axis=1)[:, dots.shape[1] - n]
            order = np.stack([(at := np.flatnonzero(row >= c))[np.argsort(-row[at], kind="stable")[:n]] for row, c in zip(dots, cut)])
        else:
            order = np.argsort(-dots, axis=1, kind="stable")[:, :n]
        out = {c: np.repeat(rows[c].to_numpy(), n) for c in keep}
        out["rank"] = np.tile(np.arange(1, n + 1, dtype=np.int32), len(rows))
        out["class_id"] = np.asarray(ids)[order].ravel()
        out["dot"] = np.take_along_axis(dots, order, axis=1).ravel()
        return pd.DataFrame(out)

    partial, whole = _score_blocks(df, protos, keep, vec, schema, best, limit, block, slice_rows)
    if whole:
        return partial
    # k rows per row and block remain: the final ranking is a small group per row.
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("dot")).alias("o"), "class_id", "dot")))
    lists = partial.groupBy(*keep).agg(F.slice(ranked, 1, k).alias("best"))
    return lists.select(*keep, F.posexplode("best").alias("pos", "b")).select(
        *keep, (F.col("pos") + 1).alias("rank"), "b.class_id", "b.dot"
    )


def prototype_logits(
    df: DataFrame, protos: DataFrame | Prototypes, keep: list[str], vec: str = "embedding",
    limit: int = PROTO_LIMIT_BYTES, block: int = PROTO_BLOCK, slice_rows: int = ROWS_PER_SLICE,
) -> DataFrame:
    """All dot products of a row in class order, in blocks: `first_class` and the `logits` of it and at most `block` - 1 classes after it.

    No row grows with the number of classes; both plans cut the classes alike. `keep` must identify a row.
    """
    protos = prepare(protos, limit, block)
    schema = f"{_ddl(df, keep)}, first_class {protos.class_type}, logits array<double>"

    def parts(rows: pd.DataFrame, ids: list, matrix: np.ndarray, dots: np.ndarray) -> pd.DataFrame:
        frames = [
            pd.DataFrame({**{c: rows[c] for c in keep}, "first_class": [ids[at]] * len(rows), "logits": list(dots[:, at : at + block])})
            for at in range(0, len(ids), block)
        ]
        return pd.concat(frames) if frames and len(rows) else pd.DataFrame({**{c: rows[c] for c in keep}, "first_class": [], "logits": []})

    return _score_blocks(df, protos, keep, vec, schema, parts, limit, block, slice_rows)[0]


def accuracy(predicted: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """Top-1 accuracy, overall or by group; `predicted` holds rank 1 rows."""
    hit = F.col("class_id") == F.col(label)
    return predicted.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.count_if(hit).alias("n_correct"), (F.count_if(hit) / F.count("*")).alias("accuracy"))


def angle_statistics(
    df: DataFrame, protos: DataFrame, label: str, key: str, vec: str = "embedding",
    limit: int = PROTO_LIMIT_BYTES, block: int = PROTO_BLOCK, slice_rows: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Bin counts and moments of the angles to all classes ('all') and to the own class ('own').

    Each batch emits its own histogram, at most 2 x 360 rows; the batches are then summed.
    The upper edge belongs to the last bin. `key` must identify a row: it spreads the rows over
    slices when the prototypes do not fit one matrix, so that a hot label is no hot slice.
    """
    schema = "kind string, bin int, n bigint, total double, squares double"

    def partial(rows: pd.DataFrame, ids: list, matrix: np.ndarray, dots: np.ndarray) -> pd.DataFrame:
        frames = []
        if len(rows):
            angles = np.degrees(np.arccos(np.clip(dots, -1.0, 1.0)))
            own = np.asarray(ids)[None, :] == rows[label].to_numpy()[:, None]
            for kind, values in (("all", angles.ravel()), ("own", angles[own])):
                width = (HIST_MAX - HIST_MIN) / HIST_BINS
                bins = np.minimum(((values - HIST_MIN) / width).astype(np.int64), HIST_BINS - 1)
                n = np.bincount(bins, minlength=HIST_BINS)
                used = np.nonzero(n)[0]
                frames.append(pd.DataFrame({
                    "kind": kind, "bin": used.astype(np.int32), "n": n[used],
                    "total": np.bincount(bins, values, HIST_BINS)[used], "squares": np.bincount(bins, values**2, HIST_BINS)[used],
                }))
        return pd.concat(frames) if frames else pd.DataFrame({"kind": [], "bin": [], "n": [], "total": [], "squares": []})

    parts, _ = _score_blocks(df, protos, [key, label], vec, schema, partial, limit, block, slice_rows)
    return parts.groupBy("kind", "bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"))


def angle_summary(stats: DataFrame) -> DataFrame:
    """Mean and population deviation of the angles per kind."""
    sums = stats.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("total").alias("t"), F.sum("squares").alias("q"))
    mean = F.col("t") / F.col("n")
    return sums.select("kind", "n", mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"))


def mean_shift(df: DataFrame, protos: DataFrame, label: str, vec: str = "embedding") -> DataFrame:
    """Mean of (embedding - own prototype), one row: the own prototypes enter by their class shares."""
    overall = df.agg(vector_to_array(Summarizer.mean(array_to_vector(F.col(vec).cast("array<double>")))).alias("mean"))
    shares = df.groupBy(F.col(label).alias("class_id")).agg(F.count("*").cast("double").alias("n"))
    weighted = protos.join(shares, "class_id").agg(
        vector_to_array(Summarizer.mean(array_to_vector("vector"), F.col("n"))).alias("text")
    )
    both = overall.withColumn("text", weighted.scalar())
    return both.select(F.zip_with("mean", "text", lambda a, b: a - b).alias("shift"))


def apply_shift(df: DataFrame, shift: DataFrame, vec: str = "embedding") -> DataFrame:
    """Embeddings moved by a one-row shift vector and normalised again."""
    rows = df.withColumn("__shift", shift.select("shift").scalar())
    moved = F.zip_with(F.col(vec).cast("array<double>"), "__shift", lambda a, b: a + b)
    return rows.withColumn("__moved", moved).withColumn(vec, V.normalise(F.col("__moved"))).drop("__moved", "__shift")


def embedding_summary(df: DataFrame, by: str, vec: str = "embedding") -> DataFrame:
    """Element mean, deviation and rms, norm mean and deviation, per slice and overall (slice null)."""
    x = F.col(vec).cast("array<double>")
    rows = df.select(by, F.size(vec).cast("long").alias("e"), V.vec_sum(x).alias("s"), V.sum_squares(x).alias("q"))
    sums = rows.rollup(by).agg(
        F.count("*").alias("n"), F.sum("e").alias("elements"), F.sum("s").alias("s"), F.sum("q").alias("q"),
        F.avg(F.sqrt("q")).alias("norm_mean"), F.stddev_pop(F.sqrt("q")).alias("norm_std"),
    )
    mean, square = F.col("s") / F.col("elements"), F.col("q") / F.col("elements")
    return sums.select(
        by, "n", "elements", mean.alias("elem_mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("elem_std"),
        F.sqrt(square).alias("rms"), "norm_mean", "norm_std",
    )


def position_correlation(df: DataFrame, positions: int, vec: str = "embedding") -> DataFrame:
    """Correlation matrix of the sequence positions, as rows (i, j, corr).

    A row's vector is `positions` pieces of equal length. Mean and deviation are global per position.
    Batches emit sums of products only: positions squared rows each.
    """
    schema = "i int, j int, p double, si double, sj double, qi double, qj double, n bigint"

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _list_matrix(batch.column(vec)).reshape(batch.num_rows, positions, -1)
            products, sums, squares = np.einsum("bie,bje->ij", x, x), x.sum(axis=(0, 2)), (x * x).sum(axis=(0, 2))
            i, j = np.indices((positions, positions)).reshape(2, -1)
            out = pd.DataFrame({
                "i": i.astype(np.int32), "j": j.astype(np.int32), "p": products.ravel(), "si": sums[i], "sj": sums[j],
                "qi": squares[i], "qj": squares[j], "n": np.full(len(i), x.shape[0] * x.shape[2]),
            })
            yield pa.RecordBatch.from_pandas(out, schema=arrow, preserve_index=False)

    sums = df.select(vec).mapInArrow(partial, schema).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("p", "si", "sj", "qi", "qj", "n")])
    n = F.col("n")
    std = lambda q, s: F.sqrt(F.col(q) / n - (F.col(s) / n) * (F.col(s) / n))
    cov = F.col("p") / n - (F.col("si") / n) * (F.col("sj") / n)
    return sums.select("i", "j", (cov / (std("qi", "si") * std("qj", "sj"))).alias("corr"))


def special_weights(logits: DataFrame, keep: list[str], topics: DataFrame, block: int = PROTO_BLOCK) -> DataFrame:
    """(keep, weight): exp of the summed positive excess of each logit over its topic's mean, times its factor.

    `logits` are blocks of `prototype_logits` over all of `topics` (class_id, mean, factor), which are cut into the same blocks; the
    sums of a row's blocks are added.
    """
    placed = ranged_rank(topics.select("class_id", "mean", "factor"), [], [F.col("class_id")], "at").withColumn("block", F.expr(f"at div {block}"))
    lists = placed.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("class_id", "mean", "factor"))).alias("own"))
    lists = lists.select(F.col("own")[0]["class_id"].alias("first_class"), "own")
    excess = F.zip_with("logits", "own", lambda x, t: F.greatest(x - t["mean"], F.lit(0.0)) * t["factor"])
    return logits.join(lists, "first_class").groupBy(*keep).agg(F.exp(F.sum(V.vec_sum(excess))).alias("weight"))
