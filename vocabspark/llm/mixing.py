"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

import hashlib
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import aside, cut_lineage

#: Rows of one source and size that one task puts in order.
GROUP = 20_000
#: A document is taken so many times at most.
MOST = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: dict[str | None, float | int] | None = None, most: int = MOST) -> dict[str | None, float]:
    """Each source's share of all sizes by weight, at most `most` times its size; what is over goes to the others by weight.

    Without `weights` the sources weigh 1, 2, 3 in turn, by code point, null last.
    """
    order = sorted(sizes, key=lambda s: (s[0] is None, (s[0] or "").encode()))
    weigh = weights or {source: 1 + i % 3 for i, (source, _) in enumerate(order)}
    left, weight, out = sum(n for _, n in order), sum(weigh[s] for s, _ in order), {}
    for source, n in sorted(order, key=lambda s: Fraction(most * s[1]) / Fraction(weigh[s[0]])):
        if most * n * weight >= weigh[source] * left:
            break
        out[source] = float(most * n)
        left, weight = left - most * n, weight - weigh[source]
    return {s: out[s] if s in out else float(weigh[s] * left) / float(weight) if weight else 0.0 for s, _ in order}


def offset(seed: int, source: str | None) -> float:
    """The source's random offset, in [0, 1)."""
    return int(hashlib.md5(f"{seed}:{source or ''}".encode()).hexdigest()[:8], 16) / 2**32


def mix(docs: DataFrame, id_col: str, source_col: str, size: Column, weights: dict[str | None, float] | None = None, seed: int = 42, most: int = MOST, keep: tuple[str, ...] | None = None) -> DataFrame:
    """`keep` columns (all by default) and size, source_size, target, copies: how many times the mix takes each row.

    Within a source every row is expected target / source_size times. Rows are ranked by size, then by the digest of the id;
    the expected copies are prefix-summed in that order, one random offset is added, and a row is taken once for each integer
    that its step crosses. The order by size makes the words taken come close to the target. Reruns agree, whatever the partitions:
    only the seed, the source and the id's digest count. Null sources are a source of their own; null ids come
    first in their size; rows equal in id, source and size are interchangeable. All sizes 0: nothing is taken. An empty table gives an
    empty one. New columns replace those of their names.

    Rows of one source and size are dealt to buckets by digest, as many as they need, so no source or size is put in order by
    one task; only the buckets' counts are summed along a source. One row of each source comes to the driver.
    """
    counted = "words"
    while counted in docs.columns:
        counted += "_"
    names = list(docs.columns if keep is None else keep)
    plain, (id_col, source_col, *names), back = aside(docs.select("*", size.alias(counted)), id_col, source_col, *names)
    return back(_mix(plain, id_col, source_col, F.col(counted), weights, seed, most, names))


def _mix(docs: DataFrame, id_col: str, source_col: str, size: Column, weights: dict[str | None, float] | None, seed: int, most: int, keep: list[str]) -> DataFrame:
    kept = [c for c in keep if c not in ("size", "source_size", "target", "copies")]
    group = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    rows = docs.select(*kept, F.col(source_col).cast("string").alias("__source"), group.alias("__g"), size.alias("size"), F.coalesce(F.md5(F.col(id_col).cast("string").cast("binary")), F.lit("")).alias("__key"))
    small = cut_lineage(rows.groupBy("__g", "__source", "size").agg(F.count("*").alias("__n")))
    totals = [(r[0], r[1], r[2]) for r in small.groupBy("__g", "__source").agg(F.sum(F.col("size") * F.col("__n")).alias("n")).collect()]
    goal = targets([(s, n) for _, s, n in totals], weights, most)
    table = [(g, n, goal[s], goal[s] / n if n else 0.0, offset(seed, s)) for g, s, n in totals]
    sources = docs.sparkSession.createDataFrame(table, "__g string, source_size long, target double, __r double, __u double")

    buckets = F.ceil(F.col("__n") / F.lit(GROUP)).cast("long")
    counts = small.select("__g", "size", buckets.alias("__b"))
    digest = F.coalesce(F.conv(F.substring("__key", 1, 8), 16, 10).cast("long"), F.lit(0))
    dealt = rows.join(counts, ["__g", "size"]).withColumn("__at", F.shiftright(digest * F.col("__b"), 32))
    held = dealt.groupBy("__g", "size", "__at").agg(F.count("*").alias("__m"))
    before = W.partitionBy("__g").orderBy("size", "__at").rowsBetween(W.unboundedPreceding, -1)
    starts = held.select("__g", "size", "__at", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__start"))
    local = F.row_number().over(W.partitionBy("__g", "size", "__at").orderBy("__key"))
    ranked = dealt.withColumn("__local", local).join(starts, ["__g", "size", "__at"]).join(sources, "__g")
    rank = F.col("__start") + F.col("__local")
    step = lambda k: F.floor(k * F.col("__r") + F.col("__u"))
    return ranked.select(*kept, "size", "source_size", "target", (step(rank) - step(rank - 1)).cast("long").alias("copies"))


def oracle(seed: int = 42) -> str:
    """The same rows in DuckDB, for the turning weights 1, 2, 3."""
    return rf"""
  WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
       s AS (SELECT source, sum(size)::HUGEINT AS n, count(*) AS docs FROM d GROUP BY source),
       w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
       o AS (SELECT *, sum(n) OVER () - coalesce(sum({MOST} * n) OVER before, 0) AS t_left, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS w_left
             FROM w WINDOW before AS (ORDER BY {MOST} * n / weight::DOUBLE, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
       c AS (SELECT *, {MOST} * n * w_left < weight * t_left AS capped FROM o),
       f AS (SELECT (SELECT sum(n) FROM c) - coalesce(sum({MOST} * n) FILTER (WHERE capped), 0) AS t, coalesce(sum(weight) FILTER (WHERE NOT capped), 0) AS w FROM c),
       g AS (SELECT source, n::BIGINT AS source_size, CASE WHEN capped THEN ({MOST} * n)::DOUBLE WHEN f.w = 0 THEN 0.0 ELSE (weight * f.t)::DOUBLE / f.w::DOUBLE END AS target,
                    ('0x' || substr(md5('{seed}:' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM c, f),
       r AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.u, CASE WHEN source_size = 0 THEN 0.0 ELSE target / source_size::DOUBLE END AS r,
                    row_number() OVER (PARTITION BY d.source ORDER BY d.size, coalesce(md5(d.doc_id::VARCHAR), '')) AS k
             FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
  SELECT doc_id, size, source_size, target, (floor(k::DOUBLE * r + u) - floor((k - 1)::DOUBLE * r + u))::BIGINT AS copies,
         size * (floor(k::DOUBLE * r + u) - floor((k - 1)::DOUBLE * r + u))::BIGINT AS taken FROM r"""
