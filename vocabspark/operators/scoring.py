"""Scoring of label predictions against class annotations.

Predictions are long rows (file, model, gencfg, gen_topk, sample, k, pred, score), k from 1.
Annotations are long rows (sample, category, noun).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut_lineage

# The weight of each annotation category, in category order.
CATEGORY_SCORES = {
    "correct_primary": 1.0,
    "correct_secondary": 0.8,
    "close_primary": 0.5,
    "close_secondary": 0.4,
    "incorrect": 0.0,
}
CORRECT_CATEGORIES = ("correct_primary", "correct_secondary")
GROUP = ("file", "model", "gencfg")  # a file has one model
PER_SAMPLE = ("file", "gencfg", "sample")


def category_score(category: Column) -> Column:
    """Weight of a category; none and unknown categories weigh nothing."""
    out = F.lit(0.0)
    for name, weight in CATEGORY_SCORES.items():
        out = F.when(category == name, F.lit(weight)).otherwise(out)
    return out


def pair_categories(ann: DataFrame) -> DataFrame:
    """One category per (sample, noun): the alphabetically smallest, with the number of categories."""
    return ann.groupBy("sample", "noun").agg(F.min("category").alias("category"), F.countDistinct("category").alias("n_categories"))


def attach_category(preds: DataFrame, ann: DataFrame) -> DataFrame:
    """Predictions with their category (null where not annotated).

    Annotations are as many as images times nouns, so they are merged; the planner would take exploded ones for few and broadcast them.
    """
    pairs = pair_categories(ann).select("sample", F.col("noun").alias("pred"), "category")
    return preds.join(pairs.hint("merge"), ["sample", "pred"], "left")


def category_counts(category: Column) -> list[Column]:
    counts = [F.count_if(F.coalesce(category == name, F.lit(False))).alias(name) for name in CATEGORY_SCORES]
    other = F.count_if(~F.coalesce(category.isin(*CATEGORY_SCORES), F.lit(False))).alias("other")
    return [*counts, other]


def score_of_counts() -> Column:
    """Total weight from category counts, so that the sum does not depend on row order."""
    total = F.lit(0.0)
    for name, weight in CATEGORY_SCORES.items():
        total = total + F.col(name) * F.lit(weight)
    return total


def score_top1(scored: DataFrame) -> DataFrame:
    """Category counts, score and score share of the first predictions per (file, model, gencfg).

    Samples without annotation stay in the denominator with weight zero.
    """
    counts = scored.filter("k = 1").groupBy(*GROUP).agg(F.count("*").alias("n"), *category_counts(F.col("category")))
    return counts.withColumn("score", score_of_counts()).withColumn("score_ratio", F.col("score") / F.col("n"))


def multiple_categories(preds: DataFrame, ann: DataFrame) -> DataFrame:
    """Predicted (sample, noun) pairs annotated in several categories."""
    repeated = (
        ann.groupBy("sample", "noun")
        .agg(F.array_sort(F.collect_set("category")).alias("categories"))
        .filter(F.size("categories") > 1)
    )
    pairs = preds.select("sample", F.col("pred").alias("noun"))
    return repeated.join(pairs, ["sample", "noun"], "left_semi").select(
        "sample", "noun", F.array_join("categories", ",").alias("categories")
    )


def cumulative_best_category(scored: DataFrame, topk: int) -> DataFrame:
    """Per rank k, the category counted when the first k predictions may be used.

    The best weight so far counts. An item that equals it counts with its own category; one that is
    worse counts with the earliest category that reached it. The window holds one sample's ranks.
    """
    upto = W.partitionBy(*PER_SAMPLE).orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    rows = scored.filter((F.col("k") <= topk) & (F.col("k") <= F.col("gen_topk"))).withColumn(
        "cat_score", category_score(F.col("category"))
    )
    best = F.max(F.struct(F.col("cat_score").alias("s"), (-F.col("k")).alias("o"), F.col("category").alias("c"))).over(upto)
    counted = F.when(F.col("cat_score") == F.col("best.s"), F.col("category")).otherwise(F.col("best.c"))
    return rows.withColumn("best", best).withColumn("counted", counted).drop("best", "cat_score")


def topk_scores(scored: DataFrame, topk: int) -> DataFrame:
    """Counts, score and score share per (file, model, gencfg, k)."""
    rows = cumulative_best_category(scored, topk)
    counts = rows.groupBy(*GROUP, "k").agg(F.count("*").alias("n"), *category_counts(F.col("counted")))
    return counts.withColumn("score", score_of_counts()).withColumn("score_ratio", F.col("score") / F.col("n"))


def missing_nouns(preds: DataFrame, ann: DataFrame) -> DataFrame:
    """Distinct (sample, noun) predicted for annotated samples but not annotated themselves."""
    pairs = preds.select("sample", F.col("pred").alias("noun")).distinct()
    known = ann.select("sample").distinct()
    annotated = ann.select("sample", "noun").distinct()
    return pairs.join(known, "sample", "left_semi").join(annotated, ["sample", "noun"], "left_anti")


def missing_samples(preds: DataFrame, ann: DataFrame) -> DataFrame:
    """Predicted samples without any annotation."""
    return preds.select("sample").distinct().join(ann.select("sample").distinct(), "sample", "left_anti")


def model_maximum(scores: DataFrame) -> DataFrame:
    """Best top-1 score of each model over its decodings (ties: smallest decoding name)."""
    top1 = scores.filter("k = 1")
    fields = [c for c in top1.columns if c not in ("file", "model", "gencfg", "score", "k")]
    best = F.min_by(F.struct("gencfg", "score", *fields), F.struct(-F.col("score"), "gencfg"))
    return top1.groupBy("file", "model").agg(best.alias("b")).select("file", "model", "b.*")


def score_grid(scores: DataFrame) -> DataFrame:
    """Decoding x model grid of scores with their ratios, by kind of row.

    cell: one decoding of one model; mean: a decoding over the models; max: a model's best decoding; top: per k the
    best of the decodings' means. A maximum's ratio is that of the row with the highest score (ties: the higher ratio).
    """
    sets = [["gencfg", "file", "k"], ["gencfg", "k"], ["file", "k"]]
    sums = scores.groupingSets(sets, "gencfg", "file", "k").agg(
        F.grouping("gencfg").alias("over_gencfg"), F.grouping("file").alias("over_file"),
        F.avg("score").alias("mean_score"), F.avg("score_ratio").alias("mean_ratio"),
        F.max("score").alias("best_score"), F.max_by("score_ratio", F.struct("score", "score_ratio")).alias("best_ratio"),
    )
    highest = F.col("over_gencfg") == 1
    kind = F.when(highest, "max").when(F.col("over_file") == 1, "mean").otherwise("cell")
    rows = sums.select(
        kind.alias("kind"), "gencfg", "file", "k", F.when(highest, F.col("best_score")).otherwise(F.col("mean_score")).alias("score"),
        F.when(highest, F.col("best_ratio")).otherwise(F.col("mean_ratio")).alias("ratio"),
    )
    place = F.row_number().over(W.partitionBy("kind", "k").orderBy(F.desc("score"), F.desc("ratio"), "gencfg"))
    kinds = F.when((F.col("kind") == "mean") & (place == 1), F.array(F.lit("mean"), F.lit("top"))).otherwise(F.array("kind"))
    return rows.withColumn("kinds", kinds).select(F.explode("kinds").alias("kind"), "gencfg", "file", "k", "score", "ratio")


def best_cell(scores: DataFrame) -> DataFrame:
    """The single best top-1 cell (ties: file, then decoding)."""
    return scores.filter("k = 1").orderBy(F.desc("score_ratio"), "file", "gencfg").select("file", "gencfg", "score_ratio").limit(1)


def attach_specificity(preds: DataFrame, spec: DataFrame, strict: bool = True) -> DataFrame:
    """Predictions with the specificity of their noun; strict mode fails on a noun without one."""
    joined = preds.join(spec.withColumnRenamed("noun", "pred"), "pred", "left")
    if not strict:
        return joined
    missing = F.raise_error(F.concat(F.lit("no specificity for noun: "), F.col("pred"))).cast("double")
    return joined.withColumn("specificity", F.when(F.col("specificity").isNull(), missing).otherwise(F.col("specificity")))


def specificity_scores(preds: DataFrame, ann: DataFrame, spec: DataFrame, strict: bool = True) -> DataFrame:
    """Top-1 prediction score and specificity-weighted score per (file, model, gencfg).

    A noun in several categories takes its last one in category order here, unlike `attach_category`.
    Strict mode fails on predictions without annotation; otherwise they weigh nothing and are counted.
    """
    position = F.array_position(F.array(*[F.lit(c) for c in CATEGORY_SCORES]), F.col("category"))
    last = ann.groupBy("sample", F.col("noun").alias("pred")).agg(
        F.max_by("category", position).alias("category")
    )
    rows = attach_specificity(preds.filter("k = 1").join(last, ["sample", "pred"], "left"), spec, strict)
    weight = category_score(F.col("category"))
    if strict:
        missing = F.raise_error(F.concat(F.lit("no annotation for: "), F.col("pred"))).cast("double")
        weight = F.when(F.col("category").isNull(), missing).otherwise(weight)
    return rows.groupBy(*GROUP).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("category").isNull()).alias("n_missing"),
        (F.sum(weight) / F.count("*")).alias("prediction_score"),
        (F.sum(weight * F.coalesce("specificity", F.lit(0.0))) / F.count("*")).alias("overall_score"),
    )


def correct_set(ann: DataFrame) -> DataFrame:
    """Distinct correct (sample, noun): primary and secondary together."""
    return ann.filter(F.col("category").isin(*CORRECT_CATEGORIES)).select("sample", "noun").distinct()


def result_types(preds: DataFrame, correct: DataFrame, guides: DataFrame, vocab: DataFrame) -> DataFrame:
    """Flags and result code of every prediction: 0 correct, 1 valid guide, 2 valid vocabulary, 3 other."""
    flag = F.lit(True)
    rows = (
        preds.join(correct.select("sample", F.col("noun").alias("pred")).distinct().withColumn("c", flag), ["sample", "pred"], "left")
        .join(guides.select(F.col("noun").alias("pred")).distinct().withColumn("g", flag), "pred", "left")
        .join(vocab.select(F.col("noun").alias("pred")).distinct().withColumn("v", flag), "pred", "left")
    )
    flags = {"correct": "c", "valid_guide": "g", "valid_vocab": "v"}
    rows = rows.withColumns({name: F.coalesce(F.col(c), F.lit(False)) for name, c in flags.items()}).drop(*flags.values())
    code = F.when(F.col("correct"), 0).when(F.col("valid_guide"), 1).when(F.col("valid_vocab"), 2).otherwise(3)
    return rows.withColumn("result", code)


def topk_hit_ratios(results: DataFrame) -> DataFrame:
    """Shares of samples with any hit among the first k: correct, also guide, also vocabulary; invalid and valid."""
    upto = W.partitionBy(*PER_SAMPLE).orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    # The smallest code so far says which nested sets are hit; code 3 anywhere says invalid.
    rows = results.withColumn("best", F.min("result").over(upto)).withColumn("worst", F.max("result").over(upto))
    n = F.count("*")
    invalid = F.count_if(F.col("worst") == 3) / n
    return rows.groupBy(*GROUP, "k").agg(
        n.alias("n"),
        (F.count_if(F.col("best") == 0) / n).alias("topk"),
        (F.count_if(F.col("best") <= 1) / n).alias("topk_guide"),
        (F.count_if(F.col("best") <= 2) / n).alias("topk_vocab"),
        invalid.alias("topk_invalid"),
        ((n - F.count_if(F.col("worst") == 3)) / n).alias("topk_valid"),
    )


def direct_guided_buckets(direct: DataFrame, guided: DataFrame | None = None) -> DataFrame:
    """Direct (correct, valid, invalid) against guided (correct, incorrect) outcomes per (file, model).

    Inputs are first predictions with `correct` and valid flags. Without guided rows the three
    unguided outcomes are used. The outcome direct-correct-guided-incorrect should stay zero.
    """
    level = F.when(F.col("correct"), "correct").when(F.col("valid_vocab"), "valid").otherwise("invalid")
    rows = direct.select("file", "model", "sample", level.alias("direct"))
    if guided is None:
        rows = rows.withColumn("guided", F.col("direct") == "correct")
    else:
        rows = rows.join(guided.select("file", "model", "sample", F.col("correct").alias("guided")), ["file", "model", "sample"])
    counts = [
        F.count_if((F.col("direct") == d) & (F.col("guided") if g else ~F.col("guided"))).alias(f"{d}_{'correct' if g else 'incorrect'}")
        for d in ("correct", "valid", "invalid")
        for g in (True, False)
    ]
    total = rows.groupBy("file", "model").agg(F.count("*").alias("n"), *counts)
    share = lambda *cols: sum((F.col(c) for c in cols[1:]), F.col(cols[0])) / F.col("n")
    return total.select(
        "*",
        share("correct_correct", "correct_incorrect").alias("direct_correct"),
        share("valid_correct", "valid_incorrect").alias("direct_valid"),
        share("invalid_correct", "invalid_incorrect").alias("direct_invalid"),
        share("correct_correct", "valid_correct", "invalid_correct").alias("guided_correct"),
        share("correct_incorrect", "valid_incorrect", "invalid_incorrect").alias("guided_incorrect"),
    )


def mean_over_models(ratios: DataFrame, value: str, max_k: int, by: tuple[str, ...] = ("gencfg",)) -> DataFrame:
    """Mean over models per (by, k) with best flags; a k that some model lacks makes the mean -infinity.

    The ratios are a report-sized table used three times, so they are computed once and written out.
    """
    ratios = cut_lineage(ratios)
    n_models = ratios.agg(F.countDistinct("file").alias("n_models")).scalar()
    cells = ratios.filter(F.col("k") <= max_k).groupBy(*by, "k").agg(F.avg(value).alias("mean"), F.countDistinct("file").alias("n"))
    grid = ratios.select(*by).distinct().withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(max_k))))
    full = grid.join(cells, [*by, "k"], "left")
    mean = F.when(F.col("n") == n_models, F.col("mean")).otherwise(F.lit(float("-inf")))
    over_k = W.partitionBy(*[b for b in by if b != "gencfg"], "k")
    rows = full.withColumn("mean", mean)
    return rows.select(*by, "k", "mean", (F.col("mean") == F.max("mean").over(over_k)).alias("is_best"))


def dataset_cube(ratios: DataFrame, value: str) -> DataFrame:
    """Means per (dataset, gencfg, k), per (gencfg, k) over datasets, and per k over all, with the decodings' order.

    Within a dataset, and over all (dataset null), decodings are ranked for each k by their mean, ties at nine places by name; `is_best` says that
    no mean is higher. The means over all decodings have neither.
    """
    means = ratios.rollup("k", "gencfg", "dataset").agg(
        F.avg(value).alias("mean"), F.count("*").alias("n"), F.grouping("k").alias("all"), F.grouping("gencfg").alias("over_gencfg"), F.grouping("dataset").alias("over_dataset")
    ).filter("all = 0")
    peers = W.partitionBy("over_gencfg", "over_dataset", "k", "dataset")
    mark = F.round("mean", 9)
    place, best = F.row_number().over(peers.orderBy(mark.desc(), "gencfg")), mark == F.max(mark).over(peers)
    ranked = F.col("over_gencfg") == 0
    return means.select("k", "gencfg", "dataset", "mean", "n", F.when(ranked, place).alias("rank"), F.when(ranked, best).alias("is_best"))


def best_decodings(cube: DataFrame, top: int = 1) -> DataFrame:
    """The best decoding of each dataset, and of all (dataset null), by its mean top-`top` ratio."""
    return cube.filter((F.col("rank") == 1) & (F.col("k") == top)).select("dataset", "gencfg", "mean", "n")


def prediction_sets(preds: DataFrame, topk: int, gencfgs: list[str] | None = None) -> DataFrame:
    """Distinct top-k nouns per sample over files and, optionally, the named decodings."""
    rows = preds.filter(F.col("k") <= topk)
    if gencfgs:
        rows = rows.filter(F.col("gencfg").isin(*gencfgs))
    return rows.select(F.col("sample").alias("image"), F.col("pred").alias("noun")).distinct()


def top_k(preds: DataFrame, k: int) -> DataFrame:
    """The best k rows per (file, model, gencfg, sample) by score; ties by noun."""
    order = W.partitionBy(*PER_SAMPLE).orderBy(F.desc("score"), "pred")
    return preds.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def drop_annotated(preds: DataFrame, ann: DataFrame) -> DataFrame:
    """Predictions whose noun is not annotated for their sample yet."""
    known = ann.select("sample", F.col("noun").alias("pred")).distinct()
    return preds.join(known, ["sample", "pred"], "left_anti")
