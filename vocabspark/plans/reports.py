"""Composite report queries: tables a user reads, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import runs as R
from ..operators import scoring as S

# Fixed value: first number inside a report cell.
NUMBER = r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?"


def order_report(df: DataFrame, spec: str | None = None, default: list[Column] | None = None) -> DataFrame:
    """Sort a report: by default order, then by a named column.

    `spec` is [+|-][0]name, case-insensitive; 0 sorts text by the first number in it, and cells
    without a value come last. An unknown name falls back to the first column.
    """
    order = list(default) if default is not None else [F.col(c) for c in df.columns]
    if not spec:
        return df.orderBy(*order)
    name = spec.lower()
    descending = name[0] == "-"
    name = name[1:] if name[0] in "+-" else name
    numeric = name[:1] == "0"
    name = name[1:] if numeric else name
    column = next((c for c in df.columns if c.lower() == name), df.columns[0])
    key = F.col(column)
    if numeric and dict(df.dtypes)[column] == "string":
        key = F.regexp_extract(key, NUMBER, 0).try_cast("double")
    return df.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), *order)


def noun_report(preds: DataFrame, correct: DataFrame, k: int) -> DataFrame:
    """Top-k nouns per sample with a code: 0 if the noun is correct for the sample, else its stored result."""
    hits = correct.select("sample", F.col("noun").alias("pred")).distinct().withColumn("hit", F.lit(True))
    rows = preds.filter(F.col("k") <= k).join(hits, ["sample", "pred"], "left")
    code = F.when(F.coalesce("hit", F.lit(False)), F.lit(0)).otherwise(F.col("result"))
    return rows.select("file", "gencfg", "sample", "k", "pred", "score", code.alias("code"))


def topk_report(preds: DataFrame, ann: DataFrame, k: int, sort: str | None = None) -> DataFrame:
    """One row per (gencfg, file): top-1 category counts, then score and score share for each k."""
    scores = S.topk_scores(S.attach_category(preds, ann), k)
    first = [F.max(F.when(F.col("k") == 1, F.col(c))).alias(c) for c in [*S.CATEGORY_SCORES, "other"]]
    wide = [F.max(F.when(F.col("k") == i, F.col(c))).alias(f"{c}_{i}") for c in ("score", "score_ratio") for i in range(1, k + 1)]
    report = scores.groupBy("gencfg", "file", "model").agg(*first, *wide)
    return order_report(report, sort) if sort else report


def model_max_report(preds: DataFrame, ann: DataFrame) -> DataFrame:
    scores = S.topk_scores(S.attach_category(preds, ann), 1)
    return order_report(S.model_maximum(scores), default=[F.desc("score_ratio"), F.col("file")])


def grid_report(preds: DataFrame, ann: DataFrame, k: int) -> DataFrame:
    """Each model's best decoding per k, with its distance from the best decoding's mean over the models."""
    grid = S.score_grid(S.topk_scores(S.attach_category(preds, ann), k))
    top = F.max(F.when(F.col("kind") == "top", F.col("score"))).over(W.partitionBy("k"))
    rows = grid.withColumn("above_mean", F.col("score") - top).filter("kind = 'max'")
    return rows.select("file", "k", "score", "ratio", "above_mean").orderBy("k", F.desc("score"), "file")


def specificity_report(preds: DataFrame, ann: DataFrame, spec: DataFrame, strict: bool = True) -> DataFrame:
    """Both scores of each prediction file as shares and as texts of two places, with its place by either score."""
    scores = S.specificity_scores(preds, ann, spec, strict)
    percent = lambda c: F.format_string("%.2f%%", F.round(100 * F.round(c, 9), 2))
    place = lambda c: F.rank().over(W.orderBy(F.round(c, 9).desc()))  # noqa: E731  a row for each file and decoding
    columns = ("prediction_score", "overall_score")
    return scores.withColumns({f"{c.split('_')[0]}_{kind}": of(c) for c in columns for kind, of in (("text", percent), ("place", place))})


MODEL = ["model_dir", "model_name"]


def _top1_columns(patterns: dict[str, str], pairs: dict[str, str]) -> tuple[dict[str, str], list]:
    """All patterns by column, pairs once for each kind, and the columns: noun and token top-1, for pairs the noun's."""
    kinds = {f"{name}_{kind}": pattern.replace("$TYPE", kind) for name, pattern in pairs.items() for kind in ("multi", "guide")}
    value = lambda name, field: F.max(F.when(F.col("column") == name, F.col(field)))
    columns = [value(n, "noun_top1").alias(n) for n in (*patterns, *kinds)] + [value(n, "top1").alias(f"{n}_token") for n in patterns]
    return patterns | kinds, columns


def eval_report(runs: DataFrame, patterns: dict[str, str], pairs: dict[str, str], classes: str, sort: str | None = None) -> DataFrame:
    """One row per model of any run: tag, command, the first result of each named dataset pattern (noun and token
    top-1), both kinds of each paired pattern, and the class evaluation of the dataset `classes`."""
    named, columns = _top1_columns(patterns, pairs)
    picked = R.pick_by_pattern(R.eval_results(runs), named).groupBy(*MODEL).agg(*columns)
    report = R.model_headers(runs).join(picked.hint("merge"), MODEL, "left").join(R.class_results(runs, classes).hint("merge"), MODEL, "left")
    return order_report(report, sort) if sort else report


def infer_report(logs: DataFrame, samples: list[str] | None = None) -> DataFrame:
    """Newest infer run per model with tag, valid share and its prediction for each sample, '-' where it has none.

    By default all samples seen are columns, in order: as many as a report has.
    """
    newest = R.latest_per_model(logs.filter("action = 'infer'"), "tag", "valid").drop("created_at")
    said = R.parse_run_logs(logs).select("run_id", "sample", "pred")
    if samples is None:
        samples = sorted(r[0] for r in said.join(newest.select("run_id"), "run_id", "left_semi").select("sample").distinct().collect())
    columns = [
        F.coalesce(F.max(F.when(F.col("sample") == s, F.col("pred"))), F.lit("-")).alias(s.rsplit(".", 1)[0]) for s in samples
    ]
    return newest.join(said, "run_id", "left").groupBy(*MODEL, "run_id", "tag", "valid").agg(*columns)


def all_report(logs: DataFrame, runs: DataFrame, ann: DataFrame, patterns: dict[str, str], pairs: dict[str, str], classes: str) -> DataFrame:
    """Eval results, class evaluation and infer scores per model; models with one side only keep defaults on the other."""
    evals = eval_report(runs, patterns, pairs, classes)
    newest = R.latest_per_model(logs.filter("action = 'infer'"), "valid").select(*MODEL, "run_id", F.col("valid").alias("infer_valid"))
    preds = R.parse_run_logs(logs).join(newest.select("run_id"), "run_id", "left_semi")
    scored = S.attach_category(preds.select(*MODEL, "sample", "pred"), ann)
    counts = scored.groupBy(*MODEL).agg(F.count("*").alias("n"), *S.category_counts(F.col("category")))
    infers = newest.drop("run_id").join(counts.withColumn("score", S.score_of_counts()).hint("merge"), MODEL, "left")
    joined = evals.join(infers.hint("merge"), MODEL, "full")
    filled = joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in [*S.CATEGORY_SCORES, "other", "n"]})
    filled = filled.withColumns({"score": F.coalesce("score", F.lit(0.0)), "tag": F.coalesce("tag", F.lit("-")), "command": F.coalesce("command", F.lit("-"))})
    return filled.withColumn("score_ratio", F.when(F.col("n") > 0, F.col("score") / F.col("n")))


def diff_report(docs: DataFrame, by: list[str], doc: str) -> DataFrame:
    """Values of the fields that differ between documents, long form."""
    return R.differing_values(R.flatten_documents(docs, [*by, doc]), by, doc)
