"""Run rows of an experiment tracker: filters, logs, result collection, document differences, page images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Limits of a usable page image.
MIN_IMAGE_AREA = 20_000
MAX_IMAGE_AREA = 89_478_485
BAD_IMAGE_TAILS = (".svg", ".pdf", ".ogv")


def filter_runs(
    runs: DataFrame, actions: list[str], after: str | None = None, before: str | None = None,
    hosts: list[str] | None = None, models: list[str] | None = None, state: str = "finished",
) -> DataFrame:
    """Finished runs of the given actions in a time range, on hosts (full patterns), with models (dir or dir/name)."""
    keep = (F.col("state") == state) & F.col("action").isin(*actions)
    if after:
        keep = keep & (F.col("created_at") > F.lit(after).cast("timestamp"))
    if before:
        keep = keep & (F.col("created_at") < F.lit(before).cast("timestamp"))
    if hosts:
        keep = keep & F.col("host").rlike("^((" + ")|(".join(sorted(hosts)) + "))$")
    if models:
        specs = [m for m in models if "/" in m]
        dirs = [m for m in models if "/" not in m]
        keep = keep & (F.concat_ws("/", "model_dir", "model_name").isin(*specs) | F.col("model_dir").isin(*dirs))
    return runs.filter(keep)


def _recent() -> Column:
    """Order of runs, newest first."""
    return F.struct((-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("age"), F.col("run_id").alias("run"))


def latest_per_model(runs: DataFrame, *fields: str) -> DataFrame:
    """The most recent row per model (one partial aggregate, no sort)."""
    newest = F.min_by(F.struct("run_id", "created_at", *fields), _recent())
    return runs.groupBy("model_dir", "model_name").agg(newest.alias("r")).select("model_dir", "model_name", "r.*")


def eval_results(runs: DataFrame) -> DataFrame:
    """First results (newest run) per (model, dataset) of the eval runs, with the run order of that first row."""
    rows = runs.filter((F.col("action") == "eval") & F.col("dataset").isNotNull())
    return rows.groupBy("model_dir", "model_name", "dataset").agg(
        F.min_by(F.struct("noun_top1", "top1"), _recent()).alias("r"), F.min(_recent()).alias("first")
    ).select("model_dir", "model_name", "dataset", "r.*", "first")


def pick_by_pattern(results: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Per model and named full-match pattern: results of the first matching dataset, and how many matched."""
    named = F.array_compact(
        F.array(*[F.when(F.col("dataset").rlike(f"^(?:{p})$"), F.lit(name)) for name, p in patterns.items()])
    )
    rows = results.withColumn("column", F.explode(named))
    return rows.groupBy("model_dir", "model_name", "column").agg(
        F.min_by(F.struct("noun_top1", "top1"), "first").alias("r"), F.count("*").alias("n_options")
    ).select("model_dir", "model_name", "column", "r.*", "n_options")


def class_results(runs: DataFrame, dataset: str) -> DataFrame:
    """Per model the newest class evaluation of a dataset that has any result: valid, direct, fixed, guided."""
    values = {"valid": "valid", "direct": "direct", "fixed": "fixed", "guided": "noun_top1"}
    rows = runs.filter((F.col("action") == "eval_cls") & (F.col("dataset") == dataset) & F.coalesce(*values.values()).isNotNull())
    newest = F.min_by(F.struct(*[F.col(c).alias(n) for n, c in values.items()]), _recent())
    return rows.groupBy("model_dir", "model_name").agg(newest.alias("r")).select("model_dir", "model_name", "r.*")


def model_headers(runs: DataFrame) -> DataFrame:
    """Tag and command per model, of its newest run, and whether all its runs have the same."""
    newest = F.min_by(F.struct("tag", "command"), _recent())
    same = (F.countDistinct("tag") <= 1) & (F.countDistinct("command") <= 1)
    return runs.groupBy("model_dir", "model_name").agg(newest.alias("r"), same.alias("consistent")).select("model_dir", "model_name", "r.*", "consistent")


# The marker and prediction lines of a run log.
_START_LINE = r"(?md)\] Inferencing loaded model on the generated embeddings\.\.\.$"
_END_LINE = r"(?md)\] -{40,}$"
_PREDICTION_LINE = r"(?md)\] (.*) -->(.*)$"


def parse_run_logs(runs: DataFrame) -> DataFrame:
    """Predictions (run_id, model_dir, model_name, sample, pred) of infer logs.

    Lines count between the model's start marker and the next rule line; a log whose markers are
    missing or in the wrong order gives none. A sample named twice keeps its last prediction.
    """
    spec = F.concat_ws("/", "model_dir", "model_name")
    model_line = F.concat(F.lit(r"(?md)\] Loading model: .*/\Q"), spec, F.lit(r"\E$"))
    tail = F.get(F.split("log", model_line, 2), F.lit(1))
    until_end = F.when(F.col("tail").rlike(_END_LINE), F.get(F.split("tail", _END_LINE, 2), F.lit(0)))
    body = F.get(F.split("until_end", _START_LINE, 2), F.lit(1))
    rows = runs.filter("action = 'infer'").withColumn("tail", tail).withColumn("until_end", until_end).withColumn("body", body)
    pairs = F.arrays_zip(
        F.regexp_extract_all("body", F.lit(_PREDICTION_LINE), 1).alias("sample"), F.regexp_extract_all("body", F.lit(_PREDICTION_LINE), 2).alias("pred")
    )
    exploded = rows.select("run_id", "created_at", "model_dir", "model_name", F.posexplode(pairs).alias("pos", "p"))
    last = exploded.groupBy("run_id", "created_at", "model_dir", "model_name", F.col("p.sample").alias("sample")).agg(F.max_by("p.pred", "pos").alias("pred"))
    return last.withColumn("pred", F.trim(F.regexp_replace("pred", r"\s+", " ")))


def merge_results(evals: DataFrame, infers: DataFrame) -> DataFrame:
    """Eval and infer results per model (columns tag, command each), missing sides filled with '-', mismatches flagged."""
    keys = ["model_dir", "model_name"]
    left = evals.withColumnsRenamed({"tag": "eval_tag", "command": "eval_command"})
    right = infers.withColumnsRenamed({"tag": "infer_tag", "command": "infer_command"})
    joined = left.join(right, keys, "full")
    pick = lambda name: F.coalesce(F.col(f"eval_{name}"), F.col(f"infer_{name}"), F.lit("-"))
    differs = lambda name: F.coalesce(F.col(f"eval_{name}") != F.col(f"infer_{name}"), F.lit(False))
    return joined.withColumns({"tag": pick("tag"), "command": pick("command"), "mismatch": differs("tag") | differs("command")}).drop(
        "eval_tag", "infer_tag", "eval_command", "infer_command"
    )


def _entries(column: Column, dtype: T.DataType, key: Column) -> Column:
    """(key, value) entries of a nested column: structs by field, maps by entry, other values as text."""
    if isinstance(dtype, T.StructType):
        parts = [_entries(column[f.name], f.dataType, F.concat(key, F.lit(f".{f.name}"))) for f in dtype.fields]
        return F.concat(*parts)
    if isinstance(dtype, T.MapType):
        return F.transform(
            F.coalesce(F.map_entries(column), F.array().cast(f"array<struct<key:string,value:{dtype.valueType.simpleString()}>>")),
            lambda e: F.struct(F.concat_ws(".", key, e["key"]).alias("key"), e["value"].cast("string").alias("value")),
        )
    text = F.to_json(column) if isinstance(dtype, T.ArrayType) else column.cast("string")
    return F.array(F.struct(key.alias("key"), text.alias("value")))


def flatten_documents(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Nested document columns as rows (keep..., key, value), keys joined with dots."""
    fields = [f for f in docs.schema.fields if f.name not in keep]
    parts = [_entries(F.col(f.name), f.dataType, F.lit(f.name)) for f in fields]
    return docs.select(*keep, F.inline(F.concat(*parts)))


def differing_fields(flat: DataFrame, by: list[str], doc: str) -> DataFrame:
    """Per group, keys whose value is not the same in all its documents; a missing key counts as null."""
    docs = flat.groupBy(*by).agg(F.countDistinct(doc).alias("n_docs"))
    keys = flat.groupBy(*by, "key").agg(
        F.countDistinct("value").alias("n_values"), F.count("value").alias("n_present")
    )
    joined = keys.join(docs, by) if by else keys.withColumn("n_docs", docs.scalar())
    n_kinds = F.col("n_values") + F.when(F.col("n_present") < F.col("n_docs"), 1).otherwise(0)
    return joined.filter(n_kinds > 1).select(*by, "key", "n_values", "n_present", "n_docs")


def differing_values(flat: DataFrame, by: list[str], doc: str) -> DataFrame:
    """The differing keys with each document's value: rows (by..., key, doc, value)."""
    keys = differing_fields(flat, by, doc).select(*by, "key")
    return flat.join(keys, [*by, "key"], "left_semi").select(*by, "key", doc, "value")


def first_page_titles(results: DataFrame) -> DataFrame:
    """First title per noun (columns noun, rank, title) that is not a disambiguation page."""
    usable = results.filter(~F.contains(F.lower("title"), F.lit("disambiguation")))
    return usable.groupBy("noun").agg(F.min_by("title", "rank").alias("title"))


def page_image_candidates(titles: DataFrame, images: DataFrame) -> DataFrame:
    """Usable images (title, width, height, source) of the distinct titles."""
    area = F.col("width").cast("long") * F.col("height")
    bad_tail = F.lower("source").rlike("(" + "|".join(t.replace(".", r"\.") for t in BAD_IMAGE_TAILS) + ")$")
    usable = images.filter(area.between(MIN_IMAGE_AREA, MAX_IMAGE_AREA) & ~bad_tail)
    return usable.join(titles.select("title").distinct(), "title", "left_semi")


def title_counts(titles: DataFrame, least: int = 4) -> DataFrame:
    """Titles found at least `least` times."""
    return titles.groupBy("title").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
