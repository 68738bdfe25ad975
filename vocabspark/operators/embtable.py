"""Embedding tables with multi-target columns: check, merge, view, batch.

Rows are (row_id, embedding, target_ids, target_weights); id 0 means no target and only trails.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import vectors as V
from .ordinals import prefix_ids


def count_nonzero(arr: Column) -> Column:
    return F.size(F.filter(arr, lambda x: x != 0))


def _zeros_trail(arr: Column) -> Column:
    """True when no non-zero element follows a zero."""
    last = F.coalesce(F.array_max(F.transform(arr, lambda x, i: F.when(x != 0, i + 1))), F.lit(0))
    return last == count_nonzero(arr)


def row_violations(df: DataFrame, n_targets: int, full_targets: bool, unit_weights: bool, eps: float = V.F32_EPS) -> DataFrame:
    """Rows (row_id, rule) of every rule an embedding row breaks; tolerances are four float steps."""
    tol = 4 * eps
    x, ids, w = F.col("embedding").cast("array<double>"), F.col("target_ids"), F.col("target_weights")
    rises = F.exists(
        F.zip_with(F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), lambda b, a: b - a),
        lambda d: d > tol,
    )
    rules = {
        "not_unit": F.abs(V.norm(x) - 1) > tol,
        "id_range": F.exists(ids, lambda i: (i < 0) | (i >= n_targets)),
        "no_first_target": F.get(ids, F.lit(0)) <= 0,
        "zero_target": F.exists(ids, lambda i: i == 0) if full_targets else F.lit(False),
        "target_after_zero": ~_zeros_trail(ids),
        "negative_weight": F.exists(w, lambda v: v < 0),
        "no_first_weight": F.get(w, F.lit(0)) <= 0,
        "weights_rise": rises,
        "weight_without_target": F.exists(F.zip_with(ids, w, lambda i, v: (i == 0) & (v != 0)), lambda b: b),
        "weight_after_zero": ~_zeros_trail(w),
        "weights_not_unit": F.abs(V.vec_sum(w.cast("array<double>")) - 1) > tol if unit_weights else F.lit(False),
    }
    found = F.array_compact(F.array(*[F.when(test, F.lit(rule)) for rule, test in rules.items()]))
    return df.select("row_id", F.explode(found).alias("rule"))


def targets_to_ids(rows: DataFrame, dictionary: DataFrame, width: int) -> DataFrame:
    """Target nouns of each row as ids padded with zeros to `width`.

    The empty string has id 0 unless the dictionary holds it as a target. More than `width`
    targets in a row are an error, as is an unknown noun.
    """
    known = dictionary.select(F.col("noun"), "target_id").filter("noun != '' OR target_id != 0")
    exploded = rows.select("row_id", F.posexplode_outer("targets").alias("pos", "noun"))
    found = exploded.join(known, "noun", "left").withColumn(
        "target_id",
        F.when(F.col("target_id").isNotNull(), F.col("target_id"))
        .when(F.coalesce(F.col("noun"), F.lit("")) == "", F.lit(0))
        .otherwise(F.raise_error(F.concat(F.lit("unknown target noun: "), F.col("noun"))).cast("long")),
    )
    grouped = found.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("pos", "target_id"))).alias("found"))
    ids = F.transform("found", lambda x: x["target_id"].cast("int"))
    padded = F.when(
        F.size("found") <= width, F.slice(F.concat(ids, F.array_repeat(F.lit(0), width)), 1, width)
    ).otherwise(F.raise_error(F.lit("a row has more targets than the table is wide")).cast("array<int>"))
    return grouped.select("row_id", padded.alias("target_ids"))


def default_weights(ids: Column) -> Column:
    """Equal weights over the non-zero targets."""
    n = F.greatest(count_nonzero(ids), F.lit(1))
    return F.transform(ids, lambda i: F.when(i == 0, F.lit(0.0)).otherwise(F.lit(1.0) / n))


@dataclass(frozen=True)
class EmbedTable:
    """An embedding table with the header fields that merging needs."""

    rows: DataFrame
    width: int
    full_targets: bool = False
    unit_weights: bool = True
    freq: int = 1


def resize(arr: Column, width: int, zero) -> Column:
    return F.slice(F.concat(arr, F.array_repeat(F.lit(zero), width)), 1, width)


def merge_tables(tables: list[EmbedTable], multi_mode: str | int = "max") -> EmbedTable:
    """Union of tables, each repeated `freq` times, with targets padded or cut to one width.

    Cut weights are not rescaled here; the merged table then loses its unit weights instead.
    """
    if not tables or any(t.freq < 1 for t in tables):
        raise ValueError("merging needs tables with positive frequencies")
    widths = [t.width for t in tables]
    width = {"min": min(widths), "max": max(widths)}.get(multi_mode) or int(multi_mode)
    parts = []
    for i, t in enumerate(tables):
        part = t.rows.select(
            F.lit(i).alias("source"), "row_id", F.explode(F.sequence(F.lit(1), F.lit(t.freq))).alias("copy"), "embedding",
            resize(F.col("target_ids"), width, 0).alias("target_ids"), resize(F.col("target_weights"), width, 0.0).alias("target_weights"),
        )
        parts.append(part)
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return EmbedTable(
        rows, width,
        full_targets=all(t.full_targets and width <= t.width for t in tables),
        unit_weights=all(t.unit_weights and width >= t.width for t in tables),
    )


def merge_compatibility(headers: DataFrame, by: list[str]) -> DataFrame:
    """Per group of table headers, whether the tables may be merged, with the reason if not."""
    same = lambda c: F.min(c).eqNullSafe(F.max(c))
    checks = headers.groupBy(*by).agg(
        F.count("*").alias("n_tables"), same("embedder_hash").alias("same_embedder"), same("target_hash").alias("same_targets"),
        same("use_targets").alias("same_use_targets"), (F.min("freq") >= 1).alias("freqs_ok"),
    )
    fine = F.col("same_embedder") & F.col("same_targets") & F.col("same_use_targets") & F.col("freqs_ok")
    return checks.withColumn("compatible", fine)


def assign_batches(df: DataFrame, batch_size: int, training: bool, offset: int = 0, n_rows: int | None = None, pos: str = "row_id") -> DataFrame:
    """Batch numbers over dense row positions, starting `offset` rows in and wrapping around.

    Training drops the incomplete last batch, evaluation keeps it and ignores the offset.
    """
    total = F.lit(n_rows) if n_rows is not None else df.agg(F.count("*").alias("n")).scalar()
    start = offset if training else 0
    rows = df.withColumn("batch", F.floor(F.pmod(F.col(pos) - F.lit(start), total) / batch_size))
    return rows.filter(F.col("batch") < F.floor(total / batch_size)) if training else rows


def rebatch_sources(df: DataFrame, batch_size: int, source: str, pos: str) -> DataFrame:
    """Fixed-size batches over several sources read one after another (sources in order, dense positions)."""
    sizes = df.groupBy(source).agg(F.count("*").alias("n"))
    starts = prefix_ids(sizes, source, start=F.col("n")).drop("n")
    placed = df.join(starts, source)
    position = F.col("start") + F.col(pos)
    return placed.withColumns({"batch": F.floor(position / batch_size), "batch_pos": F.pmod(position, F.lit(batch_size))}).drop("start")


def multi_target_view(
    df: DataFrame, width: int, multi_length: int, unit_weights: bool, table_unit_weights: bool, fixed_length: bool = False
) -> DataFrame:
    """Batch rows with targets cut to `multi_length`, per batch without its all-zero tail columns,
    and weights rescaled to sum one when they were cut or never did. Needs a `batch` column."""
    cut = multi_length < width
    ids, weights = F.col("target_ids"), F.col("target_weights")
    rows = df
    if cut:
        rows = rows.withColumns({"target_ids": F.slice(ids, 1, multi_length), "target_weights": F.slice(weights, 1, multi_length)})
    if not fixed_length:
        used = F.greatest(F.max(count_nonzero(weights)).over(W.partitionBy("batch")), F.lit(1))
        rows = rows.withColumn("used", used).withColumns(
            {"target_ids": F.slice(ids, F.lit(1), F.col("used")), "target_weights": F.slice(weights, F.lit(1), F.col("used"))}
        ).drop("used")
    if unit_weights and (cut or not table_unit_weights):
        total = F.greatest(V.vec_sum(weights.cast("array<double>")), F.lit(1e-12))
        rows = rows.withColumn("target_weights", F.transform(weights, lambda w: w / total))
    return rows


def single_target_view(df: DataFrame, width: int, unit_weights: bool, table_unit_weights: bool) -> DataFrame:
    """Only the first target of each row; its weight is one in a unit-weight view."""
    weight = F.get("target_weights", F.lit(0))
    if unit_weights and (width > 1 or not table_unit_weights):
        weight = F.lit(1.0)
    return df.withColumns({"target_id": F.get("target_ids", F.lit(0)), "target_weight": weight}).drop("target_ids", "target_weights")


def compare_tables(a: DataFrame, b: DataFrame, key: str, rtol: float, atol: float, vec: str = "embedding") -> DataFrame:
    """One row: matched and unmatched keys, rows outside the tolerance, worst absolute and relative error."""
    left = a.select(key, F.col(vec).cast("array<double>").alias("x"))
    right = b.select(key, F.col(vec).cast("array<double>").alias("y"))
    joined = left.join(right, key, "full")
    errors = F.zip_with("x", "y", lambda x, y: F.struct(F.abs(x - y).alias("e"), F.abs(y).alias("r")))
    rows = joined.select(
        (F.col("x").isNotNull() & F.col("y").isNotNull()).alias("both"), errors.alias("err")
    ).select(
        "both",
        F.array_max(F.transform("err", lambda z: z["e"] - rtol * z["r"])).alias("a"),
        F.array_max(F.transform("err", lambda z: F.when(z["r"] > 0, (z["e"] - atol) / z["r"]))).alias("r"),
        F.exists("err", lambda z: z["e"] > atol + rtol * z["r"]).alias("bad"),
    )
    return rows.agg(
        F.count_if("both").alias("n_matched"), F.count_if(~F.col("both")).alias("n_unmatched"),
        F.count_if(F.coalesce("bad", F.lit(False))).alias("n_outside"), F.max("a").alias("worst_atol"), F.max("r").alias("worst_rtol"),
    )


def repeated_targets(targets: DataFrame, noun: str = "noun") -> DataFrame:
    """Target nouns that occur more than once; the empty noun may occur twice."""
    counts = targets.groupBy(noun).agg(F.count("*").alias("n"))
    return counts.filter((F.col("n") > 2) | ((F.col("n") > 1) & (F.col(noun) != "")))


def fingerprint(config: Column, exclude: tuple[str, ...] = (), override: dict[str, str] | None = None, bits: int = 256) -> Column:
    """Digest of a string map as compact JSON with sorted keys, without some keys and with others replaced."""
    override = override or {}
    kept = F.filter(F.map_entries(config), lambda e: ~e["key"].isin(*exclude, *override) if (exclude or override) else F.lit(True))
    extra = [F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in sorted(override.items())]
    entries = F.array_sort(F.concat(kept, F.array(*extra)) if extra else kept)
    text = F.to_json(F.map_from_entries(entries))
    return F.md5(text.cast("binary")) if bits == 128 else F.sha2(text.cast("binary"), bits)
