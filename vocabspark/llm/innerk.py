"""Exact top-k by inner product: integer vectors in order of descending length, rotated partial sums, residual bounds.

All vectors are rotated so that the first coordinates hold most of their squares (the right singular vectors of the
whole table, from its matrix of products). After some coordinates an inner product is the partial sum so far and a rest,
which is at most the product of the lengths of what is left of both vectors (Cauchy-Schwarz). A pair whose bound lies
below the query's k-th best score is dropped; those left are scored in integers. Bounds are floats with room for rounding, and only
strictly lower ones are dropped, so equal scores always come to the choice by id.

The candidates lie in bands of descending length, and these in cells of a bounded number of rows, dealt by a digest. Queries meet the
first cell, which gives each a score to beat, and then in passes over ever more cells those of the bands whose longest vector could reach
it; each pass raises the score. Bands and cells are lists that rows are looked up in, once, so plans stay as small at any number of them.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from .common import cut_lineage, discard
from .intvec import integers, matrix

#: Rows of a cell and of a block of queries, about.
CELL, BLOCK = 8192, 2048
#: Larger tables have larger cells, so many of them, and larger blocks, up to so many rows and components: what tiles read grows with their number.
CELLS, MOST, COMPONENTS = 64, 1 << 17, 1 << 23
#: Tiles that a pass is cut into at least, if the queries are enough.
TILES = 64
#: Times as many cells as before that are met at the end of a pass.
WIDER = 12
#: Bands of length at most.
BANDS = 64
#: Candidates and queries that are scored at a time.
CHUNK, SLICE = 512, 2048
#: Candidates of a cell that are turned at a time; a multiple of a chunk.
PART = 1 << 15
#: Shares of the coordinates after which pairs are held against their bounds.
STEPS = (0.125, 0.25, 0.5)
#: Share of pairs left from which all pairs of a chunk are scored by one product.
DENSE = 0.002
#: Chunks at most that are scored without bounds after bounds have left too many pairs.
IDLE = 64
_NONE = np.iinfo(np.int64).min


class Best:
    """The best `k` rows of each query so far, and the score that another one must reach."""

    def __init__(self, floor: np.ndarray, k: int) -> None:
        self.k, self.floor = k, floor.copy()
        self.rows, self.scores = np.full((len(floor), k), -1), np.full((len(floor), k), _NONE + 1)

    def add(self, q: np.ndarray, c: np.ndarray, s: np.ndarray, place: np.ndarray) -> None:
        """Pairs in order of their queries; `place` gives the order of the candidates at equal scores."""
        if not len(q):
            return
        hit, n = np.unique(q, return_counts=True)
        group = np.concatenate([np.repeat(np.arange(len(hit)), self.k), np.repeat(np.arange(len(hit)), n)])
        c, s = np.concatenate([self.rows[hit].ravel(), c]), np.concatenate([self.scores[hit].ravel(), s])
        order = np.lexsort((np.where(c < 0, len(place), place[c]), -s, group))
        taken = order[(np.cumsum(n + self.k) - n - self.k)[:, None] + np.arange(self.k)]
        self.rows[hit], self.scores[hit] = c[taken], s[taken]
        full = hit[self.rows[hit, -1] >= 0]
        self.floor[full] = np.maximum(self.floor[full], self.scores[full, -1])

    @property
    def q(self) -> np.ndarray:
        return np.nonzero(self.rows >= 0)[0]

    @property
    def c(self) -> np.ndarray:
        return self.rows[self.rows >= 0]

    @property
    def s(self) -> np.ndarray:
        return self.scores[self.rows >= 0]


def _lengths(m: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", m, m, dtype=np.float64))


def _turned(m: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """In single precision, rounded after the rotation."""
    out = np.empty(m.shape, dtype=np.float32)
    for at in range(0, len(m), SLICE):
        out[at : at + SLICE] = m[at : at + SLICE].astype(np.float64) @ rotation
    return out


def _highest(scores: np.ndarray, k: int) -> np.ndarray:
    """Which `k` of each row's scores are its highest, of equal ones the first."""
    kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k, None]
    above, equal = scores > kth, scores == kth
    return above | (equal & (np.cumsum(equal, axis=1) <= k - np.count_nonzero(above, axis=1)[:, None]))


def best_of_cell(queries: np.ndarray, floor: np.ndarray, cell: np.ndarray, place: np.ndarray, rotation: np.ndarray, k: int) -> tuple[Best, int]:
    """The best `k` rows of `cell` for each query among those that score `floor` or more, and the number of pairs scored."""
    best, scored, d = Best(floor, k), 0, cell.shape[1]
    if not len(queries) or not len(cell):
        return best, scored
    q_len, c_len = _lengths(queries), _lengths(cell)
    # Chunks by descending length; in a chunk by place, so that the first of equal scores are the ones to keep.
    order = np.argsort(-c_len, kind="stable")
    longest = c_len[order[::CHUNK]]
    order = order[np.lexsort((place[order], np.arange(len(order)) // CHUNK))]
    # No sum of some of a pair's products is greater than the product of the lengths, so floats that hold that hold the integers' products.
    top = q_len.max() * longest[0] * (1 + 1e-9)
    exact = np.float32 if top < 2.0**24 else np.float64 if top < 2.0**52 else np.int64
    single = np.float32
    steps = sorted({int(d * s) for s in STEPS} - {0})
    rests = lambda m: {s: _lengths(m[:, s:]).astype(single) for s in steps}
    rounding = 4 * (d + 8) * 2.0**-23  # of components, sums and lengths in single precision, as a share of the lengths' product, with room
    wait, idle = 0, 1
    room = np.empty((SLICE, CHUNK), dtype=exact)
    for start in range(0, len(order), PART):
        own = order[start : start + PART]
        c = cell[own].astype(exact)
        c_turned = _turned(c, rotation)
        c_rest = rests(c_turned)
        for first in range(0, len(queries), SLICE):
            lens, goals = q_len[first : first + SLICE], best.floor[first : first + SLICE]  # a view that `best` raises
            q, q_turned, q_rest = None, None, None
            for at in range(0, len(c), CHUNK):
                part, reach = slice(at, at + CHUNK), lens * longest[(start + at) // CHUNK]
                alive = np.flatnonzero(reach * (1 + 1e-9) + 1e-6 >= goals)
                if not len(alive):
                    break  # all that follow are shorter still
                if q is None:
                    q = queries[first : first + SLICE].astype(exact)
                if wait:
                    wait -= 1
                elif steps and (goals[alive] > _NONE).any():
                    if q_turned is None:
                        q_turned = _turned(q, rotation)
                        q_rest = rests(q_turned)
                    least = (goals[alive] - reach[alive] * rounding - 1e-6).astype(single)
                    least = np.nextafter(least, single(-np.inf))[:, None]
                    for s in steps:  # partial sums and the products of the rests' lengths in one product
                        bounds = np.column_stack([q_turned[alive, :s], q_rest[s][alive]]) @ np.column_stack([c_turned[part, :s], c_rest[s][part]]).T
                        open_pairs = bounds >= least
                        if few := np.count_nonzero(open_pairs) <= DENSE * open_pairs.size:
                            break
                    if few:
                        idle = 1
                        r, x = np.nonzero(open_pairs)
                        scored += len(r)
                        r, x = alive[r], x + at
                        s = np.empty(len(r), dtype=np.int64)
                        for i in range(0, len(r), 1 << 16):
                            s[i : i + (1 << 16)] = np.einsum("ij,ij->i", q[r[i : i + (1 << 16)]], c[x[i : i + (1 << 16)]])
                        good = s >= goals[r]
                        best.add(first + r[good], own[x[good]], s[good], place)
                        continue
                    wait, idle = idle, min(2 * idle, IDLE)
                    alive = alive[open_pairs.any(axis=1)]
                    if not len(alive):
                        continue
                scores = np.matmul(q if len(alive) == len(q) else q[alive], c[part].T, out=room[: len(alive), : len(c[part])])
                scored += scores.size
                least = goals[alive].astype(exact)
                some = np.flatnonzero(scores.max(axis=1) >= least)
                scores = scores[some]
                hits = scores >= least[some][:, None]
                many = np.flatnonzero(np.count_nonzero(hits, axis=1) > k)
                if len(many):
                    hits[many] = _highest(scores[many], k)
                r, x = np.nonzero(hits)
                best.add(first + alive[some[r]], own[x + at], scores[r, x].astype(np.int64), place)
    return best, scored


def _products(batches):
    """For batches of vectors: one row (i, products) for each row of the matrix of their products, a set a task."""
    total = None
    for batch in batches:
        x = matrix(batch.column("__v")).astype(np.float64)
        total = x.T @ x if total is None else total + x.T @ x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(list(total), type=pa.list_(pa.float64()))], names=["i", "products"])


def rotation(rows: DataFrame, width: int) -> np.ndarray:
    """The right singular vectors of all rows' `__v`, largest singular value first; the driver gets one matrix of the vectors' width."""
    if not width:
        return np.zeros((0, 0))
    parts = rows.select("__v").mapInArrow(_products, "i long, products array<double>").select("i", F.posexplode("products").alias("j", "p"))
    made = np.zeros((width, width))
    sums = parts.groupBy("i", "j").agg(F.sum("p").alias("p")).toArrow()
    made[sums.column("i").to_numpy(), sums.column("j").to_numpy()] = sums.column("p").to_numpy()
    _, vectors = np.linalg.eigh((made + made.T) / 2)
    return np.ascontiguousarray(vectors[:, ::-1])


def _list(values: list) -> Column:
    return F.array(*map(F.lit, values))


def _tile(turn: np.ndarray, k: int, schema: pa.Schema):
    """For a block of queries and a cell: rows (row, query, own, vec_id, score) that can be among the best."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = right.column("__its_id").combine_chunks()
        place = np.empty(len(ids), dtype=np.int64)
        place[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
        floor = pc.fill_null(left.column("__floor"), _NONE).to_numpy()
        best, _ = best_of_cell(matrix(left.column("__v")), floor, matrix(right.column("__its_v")), place, turn, k)
        q, c = pa.array(best.q), pa.array(best.c)
        columns = [left.column("__row").take(q), left.column("__id").take(q), left.column("__squares").take(q), ids.take(c), pa.array(best.s)]
        return pa.table(columns, names=schema.names).cast(schema)

    return run


def top_inner_products(
    df: DataFrame, id_col: str, vec_col: str, is_query: Column, k: int = 5, scale: int = 256, cell: int = CELL, block: int = BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` rows of the greatest inner product with each row of `df` that `is_query` names.

    A component x counts as floor(scale * x). Null vectors and those with a null component, one that is not finite, or
    one of 2**15 or more, whose products no long would hold, take no part; shorter vectors are padded with zeros, so an empty one scores
    0 with all. A row is no candidate of its own query; another row with the same id is. Equal scores go to the smaller id, nulls last.
    Repeated queries each have their rows; a query with fewer candidates has fewer. An empty table, or one without queries, gives an empty
    result. `is_query` may use any column of `df`; the others are ignored.
    """
    plain = df.select(F.col(id_col).alias("__id"), F.col(vec_col).alias("__v"), F.coalesce(is_query, F.lit(False)).alias("__query"))
    squares = F.aggregate("__v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    rows = cut_lineage(integers(plain, "__v", scale).withColumn("__squares", squares).withColumn("__row", F.monotonically_increasing_id()))
    count, queries, width, most = rows.agg(F.count("*"), F.count_if("__query"), F.max(F.size("__v")), F.max("__squares")).first()
    kind = T.StructType([T.StructField("__row", T.LongType()), T.StructField("__query_id", rows.schema["__id"].dataType), T.StructField("__squares", T.LongType()), T.StructField("__its", rows.schema["__id"].dataType), T.StructField("__score", T.LongType())])
    turn = rotation(rows, width or 0)

    # Bands of descending length, by quantiles; the driver gets their bounds, longest vectors and counts.
    limit = max(CELL, min(MOST, COMPONENTS // max(width or 0, 1)))
    cell = max(cell, min(limit, count // CELLS))
    n_bands = max(1, min(BANDS, -(-count // cell)))
    cuts = (rows.agg(F.percentile_approx("__squares", [i / n_bands for i in range(1, n_bands)], 10_000)).first()[0] or []) if n_bands > 1 else []
    cuts = sorted(set(cuts), reverse=True)
    band = F.size(F.filter(_list(cuts), lambda x: F.col("__squares") < x)) if cuts else F.lit(0)
    told = {r.band: (r.longest, r.n) for r in rows.groupBy(band.alias("band")).agg(F.max("__squares").alias("longest"), F.count("*").alias("n")).collect()}
    shares = [-(-told[b][1] // (cell + cell // 8)) if b in told else 0 for b in range(len(cuts) + 1)]
    starts = [0, *accumulate(shares)]
    cells = starts[-1]
    longest = [told[b][0] ** 0.5 if b in told else 0.0 for b in range(len(cuts) + 1)]  # only the last can be empty, and has no cells then
    # The place of a row is written with it: no filter on cells carries the bands into a plan. Vectors are as short as their lengths allow.
    short = "short" if (most or 0) < 1 << 30 else "int" if most < 1 << 62 else "long"
    share = F.pmod(F.xxhash64("__row"), F.greatest(F.col("__share"), F.lit(1)))
    own = rows.withColumn("__band", band).withColumn("__share", F.element_at(_list(shares), F.col("__band") + 1).cast("long"))
    own = own.withColumn("__cell", (F.element_at(_list(starts), F.col("__band") + 1) + share).cast("int"))
    dealt = cut_lineage(own.select("__row", "__id", "__query", "__squares", "__cell", F.col("__v").cast(f"array<{short}>").alias("__v")))
    discard(rows)
    candidates = dealt.select("__cell", F.col("__id").alias("__its_id"), F.col("__v").alias("__its_v"))
    asked = dealt.filter("__query").select("__row", "__id", "__v", "__squares")

    tile, arrow = _tile(turn, k + 1, to_arrow_schema(kind)), ["__block", "__cell"]
    order = [F.col("__score").desc(), F.col("__its").asc_nulls_last()]
    by_query = W.partitionBy("__row").orderBy(*order)

    def meet(left: DataFrame, start: int, end: int) -> DataFrame:
        """Queries and the candidates of the cells from `start` to `end`."""
        n_blocks = max(1, -(-queries // limit), min(-(-queries // block), -(-TILES // (end - start))))
        left = left.withColumn("__block", F.pmod(F.xxhash64("__row"), F.lit(n_blocks)).cast("int"))
        right = candidates.filter((F.col("__cell") >= start) & (F.col("__cell") < end)).withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
        return left.groupBy(*arrow).cogroup(right.groupBy(*arrow)).applyInArrow(tile, kind)

    # The first cell, longest of all, gives every query a score to beat; each pass over more cells gives it a higher one.
    found, done = meet(asked.select("*", F.lit(0).alias("__cell"), F.lit(None).cast("long").alias("__floor")), 0, 1), 1
    end = cells
    while done < end:
        best = cut_lineage(found.withColumn("__rank", F.row_number().over(by_query)).filter(F.col("__rank") <= k + 1).drop("__rank"))
        floors = best.groupBy("__row").agg(F.count("*").alias("__n"), F.min("__score").alias("__least")).filter(F.col("__n") > k).select(F.col("__row").alias("__of"), F.col("__least").alias("__floor"))
        reach = F.sqrt(F.col("__squares").cast("double")) * (1 + 1e-9)
        reached = F.size(F.filter(_list(longest), lambda x: reach * x + 1e-6 >= F.col("__floor")))
        last = F.when(F.col("__floor").isNull(), F.lit(cells)).otherwise(F.element_at(_list(starts), reached + 1))
        ready = asked.join(floors, F.col("__row") == F.col("__of"), "left").drop("__of").withColumn("__last", last)
        found, end = best, min(end, ready.agg(F.max("__last")).first()[0] or 0)
        if done < end:
            until = min(end, done * WIDER)
            visits = ready.filter(F.col("__last") > done).withColumn("__cell", F.explode(F.sequence(F.lit(done), F.least("__last", F.lit(until)) - 1))).drop("__last")
            found, done = best.unionByName(meet(visits, done, until)), until

    # One place more than asked for, as the query's own row may be among them.
    ranked = found.withColumn("__rank", F.row_number().over(by_query)).filter(F.col("__rank") <= k + 1)
    itself = (F.col("__its").eqNullSafe(F.col("__query_id")) & (F.col("__score") == F.col("__squares"))).cast("int")
    passed = ranked.withColumn("__itself", itself).withColumn("__passed", F.sum("__itself").over(W.partitionBy("__row").orderBy("__rank")))
    others = passed.filter("not (__itself = 1 and __passed = 1)").withColumn("__rank", F.col("__rank") - F.least("__passed", F.lit(1))).filter(F.col("__rank") <= k)
    return others.select(F.col("__query_id").alias("query_id"), F.col("__rank").cast("int").alias("rank"), F.col("__its").alias("vec_id"), F.col("__score").alias("score"))


def oracle(divisor: int = 50, k: int = 5, scale: int = 256) -> str:
    """The same in DuckDB SQL over `embeddings`, whose vectors all have one length."""
    return f"""
    WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS e FROM embeddings
         WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % {divisor} = 0),
    n AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST)::INT AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM n WHERE rank <= {k}"""
