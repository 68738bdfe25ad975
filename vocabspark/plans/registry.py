"""Registry of runnable queries: a Spark builder and, where SQL can say it, the equivalent DuckDB text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .fixtures import with_ctes

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    oracle: str | None


# Columns that are 32-bit integers in the Spark result; DuckDB would give them as 64-bit.
INT_COLUMNS = {
    "pos": (
        "j01_hypernym_targets", "j03_class_alignment", "a17_mean_shift", "a18_prototypes", "e10_shifted_embeddings",
        "f18_padded_tokens", "f18_stripped_tokens", "j11_translated_tokens", "j07_joined_captions",
        "f04_filled_templates", "f08_answer_opinions",
    ),
    "k": (
        "j06_prediction_category", "w01_cumulative_best_category", "a04_topk_scores", "a05_category_counts",
        "a08_score_grid", "j08_prediction_specificity", "a10_result_types", "a11_topk_hit_ratios",
        "w02_cumulative_any_hit", "a15_dataset_cube", "r01_noun_report", "r04_grid_report",
        "io05_normalised_documents", "io08_written_predictions",
    ),
    "rank": (
        "l02_top_k", "e16_nearest_prototypes", "e19_rescored_candidates", "st06_stream_classify",
    ),
    "n": (
        "j12_prototype_logits", "e04_multi_target_view",
    ),
    "line": (
        "f05_caption_lines", "f06_caption_templates",
    ),
    "seq": (
        "f09_accepted_opinions",
    ),
    "n_singulars n_plurals n_hypernyms": (
        "io01_vocabulary_file",
    ),
    "dim embed_num": (
        "io09_embedding_table",
    ),
}


REGISTRY: dict[str, Query] = {}


def _typed(name: str, sql: str) -> str:
    columns = [c for names, queries in INT_COLUMNS.items() if name in queries for c in names.split()]
    if not columns:
        return sql
    casts = ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in columns)
    return f"SELECT * REPLACE ({casts}) FROM ({sql})"


def query(name: str, ctes: str = "", sql: str | None = None) -> Callable[[Builder], Builder]:
    """Register a query; `ctes` names the shared fixture CTEs that `sql` reads."""

    def register(build: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"query registered twice: {name}")
        REGISTRY[name] = Query(name, build, None if sql is None else _typed(name, with_ctes(ctes, sql)))
        return build

    return register
