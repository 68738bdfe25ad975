"""Streaming queries over the given tables, compared with their batch replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import streaming as S
from ..operators import annotation as A
from ..operators import vectors as VS
from . import fixtures as X
from .queries_annotation import _ACCEPT, _CATEGORY, RULE
from .registry import query


def opinion_stream(spark, sf):
    return S.read_table_stream(spark, sf, "events").select(
        F.concat(F.lit("img_"), F.col("user_id")).alias("image"), F.concat_ws(" ", "event_type", (F.col("event_id") % 4).cast("string")).alias("noun"),
        "ts", "event_id", (F.col("value") > 20).alias("opinion"),
    )


@query("st01_stream_consensus", "opinions", f"""
    WITH {_ACCEPT.strip()}, c AS (SELECT image, noun, count(*) AS n, count(*) FILTER (WHERE opinion) AS n_correct FROM q WHERE ok GROUP BY ALL)
    SELECT image, noun, n, n_correct, {_CATEGORY} AS category FROM c""")
def _(spark, sf):
    rows = S.run_to_end(opinion_stream(spark, sf), lambda opinions: S.stream_consensus(opinions, RULE), "update")
    return S.latest_updates(rows, ["image", "noun"])


def usage_stream(spark, sf):
    return S.read_table_stream(spark, sf, "events").select(
        "ts", (F.col("event_id") % 500 + 100).alias("prompt_tokens"), (F.col("user_id") % 50 + 10).alias("completion_tokens")
    )


@query("st02_stream_usage", "", """
    WITH w AS (SELECT date_trunc('day', ts) AS start, count(*) AS requests, sum(event_id % 500 + 100)::BIGINT AS prompt_tokens, sum(user_id % 50 + 10)::BIGINT AS completion_tokens FROM events GROUP BY 1)
    SELECT start::VARCHAR AS start, requests, prompt_tokens, completion_tokens, (prompt_tokens * 5 + completion_tokens * 15) / 1e6::DOUBLE AS cost_usd
    FROM w WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)""")
def _(spark, sf):
    rows = S.run_available(S.stream_usage(usage_stream(spark, sf), "1 day", "2 hours"), "append")
    return rows.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "requests", "prompt_tokens", "completion_tokens", "cost_usd")


@query("st03_stream_ewa", "run_metrics", """
    WITH b AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) - 1 AS batch_id FROM run_metrics),
         e AS (SELECT run_id, batch_id, sum(loss_sum * 2.0::DOUBLE ** (batch_id / 8.0::DOUBLE)) OVER w / sum(loss_basis * 2.0::DOUBLE ** (batch_id / 8.0::DOUBLE)) OVER w AS ewa_loss,
                      sum(correct * 2.0::DOUBLE ** (batch_id / 8.0::DOUBLE)) OVER w / sum(tokens * 2.0::DOUBLE ** (batch_id / 8.0::DOUBLE)) OVER w AS ewa_top1
               FROM b WINDOW w AS (PARTITION BY run_id ORDER BY batch_id))
    SELECT run_id, count(*) AS n_batches, round(arg_max(ewa_loss, batch_id), 6) AS ewa_loss, round(arg_max(ewa_top1, batch_id), 6) AS ewa_top1, round(max(ewa_top1), 6) AS ewa_top1_max FROM e GROUP BY run_id""")
def _(spark, sf):
    events = S.read_table_stream(spark, sf, "events")
    tokens = F.regexp_extract("props", r'"k": (\d+)', 1).cast("long") + 1
    metrics = events.select(
        F.col("user_id").alias("run_id"), "ts", "event_id", F.col("value").alias("loss_sum"), tokens.alias("loss_basis"),
        F.pmod(F.col("event_id"), tokens).alias("correct"), tokens.alias("tokens"),
    )
    rows = S.run_totals(S.run_ewa(metrics, halflife=8, span="1 day", watermark="2 hours"))
    return rows.withColumns({c: F.round(c, 6) for c in ("ewa_loss", "ewa_top1", "ewa_top1_max")})


@query("st05_stream_score", "pair_category", """
    SELECT l_orderkey, l_linenumber, 'img_' || (l_orderkey // 10) AS sample, p_name || ' ' || l_partkey AS pred, category
    FROM lineitem JOIN part ON p_partkey = l_partkey LEFT JOIN pair_category c ON c.sample = 'img_' || (l_orderkey // 10) AND c.noun = p_name || ' ' || l_partkey""")
def _(spark, sf):
    lines = S.read_table_stream(spark, sf, "lineitem").join(X.part_names(spark, sf), F.col("l_partkey") == F.col("p_partkey"))
    preds = lines.select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("img_"), F.expr("l_orderkey div 10")).alias("sample"), X.part_noun("p_name", "l_partkey").alias("pred")
    )
    rows = S.run_available(S.stream_score(preds, X.annotations(spark, sf)), "append")
    return rows.select("l_orderkey", "l_linenumber", "sample", "pred", "category")


@query("st06_stream_classify", "dots", """
    SELECT vec_id, rank, class_id, round(dot, 6) AS dot FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dot DESC, class_id) AS rank FROM dots) WHERE rank = 1""")
def _(spark, sf):
    protos = VS.prototypes(X.embeddings(spark, sf), "label")
    rows = S.run_available(S.read_table_stream(spark, sf, "embeddings"), each=S.stream_classify(protos, ["vec_id"]))
    return rows.select("vec_id", "rank", "class_id", F.round("dot", 6).alias("dot"))


@query("st07_stream_batch_health", "", """
    WITH g AS (SELECT event_id // 200 AS batch, 200::INT AS expected, count(*) AS n_answers, count(*) FILTER (WHERE event_type <> 'error') AS n_valid, max(ts) AS last FROM events GROUP BY 1),
         f AS (SELECT *, batch % 3 AS run, n_answers >= expected AS done, n_valid >= expected * 0.8::DOUBLE AS accepted FROM g),
         b AS (SELECT *, (count(*) FILTER (WHERE done AND NOT accepted) OVER (PARTITION BY run ORDER BY last, batch))::BIGINT AS n_bad FROM f)
    SELECT run, batch, expected, n_answers, n_valid, done, accepted, n_bad, n_bad >= 5 AS stop FROM b""")
def _(spark, sf):
    batch = F.expr("event_id div 200")
    events = S.read_table_stream(spark, sf, "events").select(
        (batch % 3).alias("run"), batch.alias("batch"), F.col("event_id").alias("request_id"), "ts", (F.col("event_type") != "error").alias("valid"), F.lit(200).alias("expected")
    )
    health = lambda answers: S.stream_batch_health(answers.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy"), "40 days", "40 days")
    return S.run_to_end(events, health).drop("batch_id", "closed_at")
