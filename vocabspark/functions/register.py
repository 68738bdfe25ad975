"""The text functions as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import text as T


def _raw(pattern: str) -> str:
    """A raw SQL literal; the patterns hold no double quotes."""
    return f'r"{pattern}"'


def _quoted(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def _article_sql(noun: str) -> str:
    cases = " ".join(f"WHEN {noun} RLIKE {_raw(p)} THEN {_quoted(a)}" for p, a in T.ARTICLE_RULES)
    return f"CASE {cases} ELSE {_quoted(T.DEFAULT_ARTICLE)} END"


def _canon_sql(noun: str) -> str:
    out = f"trim(regexp_replace({noun}, {_raw(T.SPACES)}, ' '))"
    for source, target in T.LONG_FORMS:
        out = f"replace({out}, {_quoted(source)}, {_quoted(target)})"
    out = f"regexp_replace(translate({out}, {_quoted(T.LATIN_FROM)}, {_quoted(T.LATIN_TO)}), {_raw(T.COMBINING_MARKS)}, '')"
    out = f"translate(lower({out}), {_quoted(T.CANON_DROPPED)}, '')"
    return f"trim(regexp_replace({out}, {_raw(T.CANON_BREAKS)}, ' '))"


_CONFIG = (
    "STRUCT<method STRING, topk INT, vocab_prior BOOLEAN, vocab_per_token BOOLEAN, vocab_scaler DOUBLE, guided BOOLEAN, "
    "guide_renorm BOOLEAN, temperature DOUBLE, length_alpha DOUBLE>"
)


def _config_sql() -> str:
    """The fields of a decoding name; a missing field has its default, a malformed number is null."""
    value = lambda mark: f"substr(try_element_at(filter(split(substr(name, instr(name, '_') + 1), '_'), x -> startswith(x, '{mark}')), -1), 2)"
    prior = f"coalesce({value('v')}, 'none')"
    return (
        f"named_struct('method', split(name, '_')[0], 'topk', coalesce(try_cast({value('k')} AS INT), 0), 'vocab_prior', {prior} <> 'none', "
        f"'vocab_per_token', startswith({prior}, 'tok'), 'vocab_scaler', CASE WHEN {prior} = 'none' THEN 0D ELSE try_cast(substr({prior}, 4) AS DOUBLE) END, "
        f"'guided', coalesce({value('g')}, 'n') <> 'n', 'guide_renorm', coalesce({value('g')}, 'n') = 'r', "
        f"'temperature', CASE WHEN {value('t')} IS NULL THEN 1D ELSE try_cast({value('t')} AS DOUBLE) END, "
        f"'length_alpha', CASE WHEN {value('a')} IS NULL THEN 0D ELSE try_cast({value('a')} AS DOUBLE) END)"
    )


def _name_sql() -> str:
    number = lambda field: f"regexp_replace(format_string('%.3f', cfg.{field}), {_raw(chr(92) + '.?0+$')}, '')"
    prior = f"CASE WHEN cfg.vocab_prior THEN concat(CASE WHEN cfg.vocab_per_token THEN 'tok' ELSE 'tgt' END, {number('vocab_scaler')}) ELSE 'none' END"
    guide = "CASE WHEN NOT cfg.guided THEN 'n' WHEN cfg.guide_renorm THEN 'r' ELSE 'p' END"
    return f"concat(cfg.method, '_k', CAST(cfg.topk AS STRING), '_v', {prior}, '_g', {guide}, '_t', {number('temperature')}, '_a', {number('length_alpha')})"


def register_functions(spark: SparkSession) -> None:
    """Temporary SQL functions with_article(noun), canonical_noun(noun), decoding_topk(name), decoding_config(name) and decoding_name(cfg).

    Their bodies are SQL, so calls are inlined into the plan like any built-in expression.
    """
    create = "CREATE OR REPLACE TEMPORARY FUNCTION"
    spark.sql(f"{create} with_article(noun STRING) RETURNS STRING RETURN concat({_article_sql('noun')}, noun)")
    spark.sql(f"{create} canonical_noun(noun STRING) RETURNS STRING RETURN {_canon_sql('noun')}")
    spark.sql(f"{create} decoding_topk(name STRING) RETURNS INT RETURN try_cast(regexp_extract(name, '_k([0-9]+)(_|$)', 1) AS INT)")
    spark.sql(f"{create} decoding_config(name STRING) RETURNS {_CONFIG} RETURN {_config_sql()}")
    spark.sql(f"{create} decoding_name(cfg {_CONFIG}) RETURNS STRING RETURN {_name_sql()}")
