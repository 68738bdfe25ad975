"""Product codes of vectors: each of some consecutive parts is replaced by its nearest codebook entry.

The codebooks are fitted by rounds over all rows, in integers, so the result does not depend on the order or the
dealing of the rows. The nearest entries come from a GNAT of each codebook. A task sends one row of sums for each entry and
position, and the codebooks, whose size is fixed by the parameters, are all that the driver gets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, to_arrow
from .gnat import Gnat
from .intvec import integers, matrix


def _cut(vectors: np.ndarray, parts: int) -> list[np.ndarray]:
    step = vectors.shape[1] // parts
    return [vectors[:, i * step : (i + 1) * step] for i in range(parts)]


def _sums(books: list[np.ndarray]):
    """For batches of vectors: rows (part, entry, position, total, n), one set a task."""
    names = ["part", "entry", "position", "total", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(b) for b in books]
        totals, counts = [np.zeros_like(b) for b in books], [np.zeros(len(b), dtype=np.int64) for b in books]
        for batch in batches:
            for tree, total, count, part in zip(trees, totals, counts, _cut(matrix(batch.column("__v")), len(books))):
                index, _ = tree.nearest(part)
                np.add.at(total, index, part)
                count += np.bincount(index, minlength=len(count))
        for p, (total, count) in enumerate(zip(totals, counts)):
            entry, position = (x.ravel() for x in np.indices(total.shape))
            columns = [np.full(len(entry), p), entry, position, total.ravel(), count[entry]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=names)

    return run


def fit(rows: DataFrame, books: list[np.ndarray], rounds: int) -> list[np.ndarray]:
    """The codebooks after `rounds`; `rows` has the vectors in `__v`."""
    books = [b.copy() for b in books]
    schema = "part long, entry long, position long, total long, n long"
    for _ in range(rounds if books[0].size else 0):
        sums = rows.select("__v").mapInArrow(_sums(books), schema).filter("n > 0")
        # Totals over all rows may leave the range of a long.
        news = sums.groupBy("part", "entry", "position").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        for r in news.collect():  # at most entries x dimensions rows
            books[r.part][r.entry, r.position] = int(r.total) // r.n
    return books


def _assigned(books: list[np.ndarray], schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, kinds = [Gnat(b) for b in books], [to_arrow(schema[n].dataType) for n in ("__code", "__error")]
        for batch in batches:
            codes, errors = np.zeros((batch.num_rows, len(books)), dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
            for p, (tree, part) in enumerate(zip(trees, _cut(matrix(batch.column("__v")), len(books)))):
                codes[:, p], apart = tree.nearest(part)
                errors += apart
            texts = ["".join(f"{c:02x}" for c in row) for row in codes.tolist()]
            made = [pa.array(texts, type=kinds[0]), pa.array(errors, type=kinds[1])]
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__label"), *made], names=schema.names)

    return run


def encode(df: DataFrame, id_col: str, vec_col: str, label_col: str, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """(id_col, code, error, label_error, codebooks_sha256) of the rows of `df` whose vector is usable.

    A component x counts as floor(scale * x). Dropped are null vectors and those with a null component, one that is not
    finite, or one of 2**15 or more, whose squares no long would hold. Shorter vectors are padded with zeros to the
    longest, and that to a multiple of `parts`; vectors of no component have the code of entry 0 and no error. The codebooks start as the parts of the
    `entries` smallest ids (at most 256), ascending, null ids last, equal ids by their vectors; a smaller table has fewer entries. `code`
    has two hex digits a part, `error` is the squared distance to what the code stands for, `label_error` the sum of `error` over the rows
    of the same label (nulls are one label), and `codebooks_sha256` digests the entries. Repeated rows each have their row. An empty table gives
    an empty result; other columns of `df` are ignored.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    plain = df.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__label"), F.col(vec_col).alias("__v"))
    rows = integers(plain, "__v", scale, parts)
    seeds = rows.orderBy(F.col("__id").asc_nulls_last(), "__v").limit(entries).select("__v").collect()
    first = np.array([r[0] for r in seeds], dtype=np.int64).reshape(len(seeds), len(seeds[0][0]) if seeds else 0)
    books = _cut(first, parts)
    books = fit(rows, books, rounds)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    schema = T.StructType([rows.schema["__id"], rows.schema["__label"], T.StructField("__code", T.StringType()), T.StructField("__error", T.LongType())])
    coded = cut_lineage(rows.mapInArrow(_assigned(books, schema), schema))
    sums = coded.groupBy(F.col("__label").alias("__its")).agg(F.sum("__error").alias("__sum"))
    both = coded.join(sums, F.col("__label").eqNullSafe(F.col("__its")))
    return both.select(
        F.col("__id").alias(id_col), F.col("__code").alias("code"), F.col("__error").alias("error"), F.col("__sum").alias("label_error"),
        F.lit(digest).alias("codebooks_sha256"),
    )


def oracle(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The same in DuckDB SQL over `embeddings`, whose vectors all have one length that is a multiple of `parts`."""
    kept = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    text = f"""
    WITH k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, len(embedding) // {parts} AS w, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE {kept}),
    s AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, v) - 1 AS entry, v, w FROM k QUALIFY entry < {entries}),
    x AS MATERIALIZED (SELECT r, part, v[part * w + 1 : part * w + w] AS p FROM k, (SELECT unnest(range({parts})) AS part)),
    b0 AS MATERIALIZED (SELECT part, entry, v[part * w + 1 : part * w + w] AS e FROM s, (SELECT unnest(range({parts})) AS part))"""
    nearest = "SELECT r, x.part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT r, x.part, entry, list_sum(list_transform(list_zip(p, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN b{0} b ON b.part = x.part) x GROUP BY r, x.part"
    for i in range(rounds):
        text += f""",
    a{i} AS MATERIALIZED ({nearest.format(i)}),
    m{i} AS (SELECT part, entry, list(f ORDER BY pos) AS e FROM (SELECT a.part, a.entry, pos, floor(sum(p[pos]) / count(*)::DOUBLE)::BIGINT AS f FROM a{i} a JOIN x USING (r, part), (SELECT unnest(range(1, (SELECT max(w) FROM k) + 1)) AS pos) GROUP BY ALL) GROUP BY part, entry),
    b{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.e, b.e) AS e FROM b{i} b LEFT JOIN m{i} m USING (part, entry))"""
    return text + f""",
    z AS MATERIALIZED ({nearest.format(rounds)}),
    c AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM z GROUP BY r)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
           (SELECT sha256(string_agg(list_aggregate(e, 'string_agg', ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
    FROM c JOIN k USING (r)"""
