"""Queries on opinions, requests and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotation as A
from . import fixtures as X
from .registry import query

RULE = A.OpinionRule(X.OPINIONS_MIN, X.OPINIONS_MAX, X.CONFIDENCE)


def need_sql(n: str, right: str) -> str:
    c = f"{X.CONFIDENCE}::DOUBLE"
    return (
        f"greatest(ceil(least(({n} * {c} - {right}) / (1 - {c}), ({n} * {c} - ({n} - {right})) / (1 - {c}), {X.OPINIONS_MAX} - {n})), "
        f"{X.OPINIONS_MIN} - {n}, 0)::INT"
    )


_CATEGORY = (
    f"CASE WHEN n_correct / n >= {X.CONFIDENCE}::DOUBLE THEN 'correct_primary' "
    f"WHEN (n - n_correct) / n >= {X.CONFIDENCE}::DOUBLE THEN 'incorrect' ELSE 'close_primary' END"
)


@query("a24_consensus", "opinion_pairs", f"""
    SELECT *, n NOT BETWEEN 2 AND 5 OR (category = 'close_primary' AND n <> 5) AS odd_count FROM (SELECT image, noun, n, n_correct, {_CATEGORY} AS category FROM opinion_pairs)""")
def _(spark, sf):
    return A.consensus(X.opinions(spark, sf), RULE)


_PREDICTED = "predicted AS (SELECT 'img_' || (c_custkey % 200) AS image, c_mktsegment || ' ' || (c_custkey % 3) AS noun FROM customer UNION SELECT image, noun FROM opinions WHERE event_id % 3 = 0)"


def predicted(spark, sf):
    segments = X.table(spark, sf, "customer").select(
        F.concat(F.lit("img_"), (F.col("c_custkey") % 200).cast("string")).alias("image"),
        F.concat_ws(" ", "c_mktsegment", (F.col("c_custkey") % 3).cast("string")).alias("noun"),
    )
    seen = X.opinions(spark, sf).filter("event_id % 3 = 0").select("image", "noun")
    return segments.unionByName(seen).distinct()


_NEEDS = f"{_PREDICTED}, needs AS (SELECT image, noun, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN {X.OPINIONS_MIN} ELSE {need_sql('n', 'n_correct')} END AS need FROM opinion_pairs FULL JOIN predicted USING (image, noun))"


@query("a25_needed_opinions", "opinion_pairs", f"WITH {_NEEDS} SELECT image, noun, n, need FROM needs")
def _(spark, sf):
    return A.needed_opinions(X.opinions(spark, sf), predicted(spark, sf), RULE)


_LISTS = f"""{_NEEDS},
  t AS (SELECT *, greatest(top, ceil(total / {2 * X.MIN_NOUNS - 1})::BIGINT) AS r FROM (SELECT image, sum(need)::BIGINT AS total, max(need) AS top, count(*) FILTER (WHERE need = 0) AS n_done FROM needs GROUP BY image) WHERE total > 0),
  p AS (SELECT *, greatest(least(r * ({X.MIN_NOUNS} - total // r) - total % r, r * n_done), 0) AS n_pad FROM t),
  u AS (SELECT image, noun, need, sum(need) OVER (PARTITION BY image ORDER BY need DESC, noun) - need AS start FROM needs WHERE need > 0),
  d AS (SELECT n.image, n.noun, p.*, row_number() OVER (PARTITION BY n.image ORDER BY md5('7|' || n.image || '|' || n.noun), n.noun) - 1 AS rk FROM needs n JOIN p ON p.image = n.image WHERE n.need = 0 AND n_pad > 0),
  pads AS (SELECT image, noun, total + rk * (n_pad // n_done) + least(rk, n_pad % n_done) AS start, n_pad // n_done + CASE WHEN rk < n_pad % n_done THEN 1 ELSE 0 END AS copies FROM d),
  positions AS (SELECT image, noun, start + i AS position, false AS padded FROM u, unnest(range(need)) x(i) UNION ALL SELECT image, noun, start + i, true FROM pads, unnest(range(copies)) x(i)),
  lists AS (SELECT image, (position % r)::BIGINT AS request, (position // r)::BIGINT AS slot, noun, padded FROM positions JOIN t USING (image))"""


def lists(spark, sf):
    return A.request_lists(A.needed_opinions(X.opinions(spark, sf), predicted(spark, sf), RULE), X.MIN_NOUNS, X.SEED)


@query("g17_request_lists", "opinion_pairs", f"WITH {_LISTS} SELECT * FROM lists")
def _(spark, sf):
    return lists(spark, sf)


@query("g18_request_texts", "opinion_pairs", f"""
    WITH {_LISTS}, n AS (SELECT *, row_number() OVER (PARTITION BY image, request ORDER BY slot, noun) AS k FROM lists),
         x AS (SELECT image, request, string_agg(k || ') ' || noun, chr(10) ORDER BY k) AS text FROM n GROUP BY ALL)
    SELECT image, request, text, round_even({A.SYSTEM_CHARS} / 3.8::DOUBLE + 85 + length(text) / 3.8::DOUBLE, 0)::BIGINT AS num_tokens FROM x""")
def _(spark, sf):
    return A.request_texts(lists(spark, sf)).drop("nouns")


@query("l07_packed_requests", "opinion_pairs", f"""
    WITH RECURSIVE {_LISTS}, n AS (SELECT *, row_number() OVER (PARTITION BY image, request ORDER BY slot, noun) AS k FROM lists),
         x AS (SELECT image, request, string_agg(k || ') ' || noun, chr(10) ORDER BY k) AS text FROM n GROUP BY ALL),
         r AS (SELECT image, request, length(text) + 1000 AS num_bytes, round_even({A.SYSTEM_CHARS} / 3.8::DOUBLE + 85 + length(text) / 3.8::DOUBLE, 0)::BIGINT AS num_tokens FROM x),
         i AS (SELECT image, count(*) AS n, sum(num_bytes) AS size, sum(num_tokens) AS tokens, arg_max(num_tokens, request) AS last FROM r GROUP BY image),
         o AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY image) AS pos FROM (
                 SELECT *, (('0x' || substr(md5(image), 1, 15))::BIGINT % (1 + (SELECT count(*) FROM i) // 200))::INT AS shard FROM i)),
         f AS (SELECT shard, pos, image, 0 AS batch, n, size, tokens, last FROM o WHERE pos = 1
               UNION ALL
               SELECT o.shard, o.pos, o.image, f.batch + CASE WHEN full_up THEN 1 ELSE 0 END, CASE WHEN full_up THEN 0 ELSE f.n END + o.n,
                      CASE WHEN full_up THEN 0 ELSE f.size END + o.size, CASE WHEN full_up THEN 0 ELSE f.tokens END + o.tokens, o.last
               FROM (SELECT *, n >= 40 OR size >= 60000 OR tokens >= 20000 - last * 10 AS full_up FROM f) f JOIN o ON o.shard = f.shard AND o.pos = f.pos + 1)
    SELECT f.shard, f.batch, r.image, r.request, r.num_bytes::BIGINT AS num_bytes, r.num_tokens FROM f JOIN r ON r.image = f.image""")
def _(spark, sf):
    rows = A.request_texts(lists(spark, sf)).withColumn("num_bytes", F.length("text") + 1000)
    return A.pack_requests(rows, 40, 60_000, 20_000, images_per_shard=200)


_ACCEPT = f"""
  o AS (SELECT *, row_number() OVER w AS seq, coalesce(sum(opinion::INT) OVER (PARTITION BY image, noun ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM opinions WINDOW w AS (PARTITION BY image, noun ORDER BY ts, event_id)),
  q AS (SELECT *, bool_and({need_sql('(seq - 1)', 'before')} > 0) OVER (PARTITION BY image, noun ORDER BY ts, event_id) AS ok FROM o)"""


@query("f09_accepted_opinions", "opinions", f"WITH {_ACCEPT.strip()} SELECT image, noun, event_id, opinion, seq FROM q WHERE ok")
def _(spark, sf):
    return A.accept_opinions(X.opinions(spark, sf), RULE).select("image", "noun", "event_id", "opinion", "seq")


_PARSED = """
  a AS (SELECT *, CASE WHEN finish_reason <> 'stop' THEN 'finish' WHEN content = '' THEN 'empty' WHEN request_id % 29 = 1 THEN 'order' WHEN request_id % 31 = 2 THEN 'noun' END AS fault FROM answers)"""


@query("f08_parsed_answers", "answers", """
    WITH l AS (SELECT request_id, image, finish_reason, content, nouns, string_split(content, chr(10)) AS lines FROM answers),
         m AS (SELECT *, list_filter(lines, lambda x: regexp_matches(x, '^[1-9][0-9]*\\.')) AS dots, list_filter(lines, lambda x: regexp_matches(x, '^[1-9][0-9]*\\)')) AS brs FROM l),
         s AS (SELECT *, CASE WHEN len(dots) > len(nouns) OR (len(dots) > 0 AND len(brs) > 0) THEN list_filter(dots, lambda x: regexp_matches(x, '(correct|incorrect)\\s*$', 'i')) ELSE dots END AS d2,
                      CASE WHEN len(brs) > len(nouns) OR (len(dots) > 0 AND len(brs) > 0) THEN list_filter(brs, lambda x: regexp_matches(x, '(correct|incorrect)\\s*$', 'i')) ELSE brs END AS b2 FROM m),
         c AS (SELECT *, CASE WHEN len(d2) = len(nouns) THEN d2 WHEN len(b2) = len(nouns) THEN b2 END AS chosen FROM s),
         u AS (SELECT request_id, i, nouns[i] AS noun, regexp_extract(chosen[i], '^([1-9][0-9]*)', 1)::INT <> i AS bad_order,
                      lower(trim(regexp_extract(chosen[i], '^[0-9]+[.)]\\s*(.*?)[''.\\W\\s]+(correct|incorrect)\\s*$', 1, 'i'), '*_ ')) <> lower(nouns[i]) AS bad_noun,
                      length(regexp_extract(chosen[i], '(correct|incorrect)\\s*$', 0, 'i')) AS verdict FROM c, unnest(range(1, len(nouns) + 1)) x(i) WHERE chosen IS NOT NULL),
         e AS (SELECT request_id, arg_min(CASE WHEN bad_order THEN 'order' WHEN bad_noun THEN 'noun' END, i) AS fault FROM u WHERE bad_order OR bad_noun GROUP BY 1)
    SELECT c.request_id, c.image, CASE WHEN finish_reason <> 'stop' THEN 'finish' WHEN content = '' THEN 'empty' WHEN chosen IS NULL THEN 'count' ELSE e.fault END AS error
    FROM c LEFT JOIN e USING (request_id)""".replace("\\\\", "\\"))
def _(spark, sf):
    return A.parse_answers(X.answers(spark, sf)).select("request_id", "image", "error")


@query("f08_answer_opinions", "answers", """
    SELECT a.request_id, a.image, i - 1 AS pos, a.nouns[i] AS noun, e.value > 20 AS opinion FROM answers a, unnest(range(1, len(a.nouns) + 1)) x(i)
    JOIN events e ON e.event_id = a.request_id * 4 + i - 1
    WHERE a.finish_reason = 'stop' AND a.content <> '' AND a.request_id % 29 <> 1 AND a.request_id % 31 <> 2""")
def _(spark, sf):
    opinions = A.answer_opinions(A.parse_answers(X.answers(spark, sf)))
    return opinions.select("request_id", "image", "pos", "noun", "opinion")


@query("a23_description_counts", "answers", """
    SELECT image, 'The scene of ' || request_id || '.' || CASE WHEN request_id % 5 = 4 AND request_id % 3 <> 0 THEN ' 1) a list of things' WHEN request_id % 5 = 4 THEN ' 1) a list of things' ELSE '' END AS description, count(*) AS n
    FROM answers WHERE finish_reason = 'stop' AND content <> '' AND request_id % 29 <> 1 AND request_id % 31 <> 2 GROUP BY ALL""")
def _(spark, sf):
    return A.description_counts(A.parse_answers(X.answers(spark, sf)))


@query("a22_usage_totals", "answers", """
    SELECT image, finish_reason, count(*) AS requests, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens,
           (sum(prompt_tokens) + sum(completion_tokens))::BIGINT AS total_tokens, (sum(prompt_tokens) * 5 + sum(completion_tokens) * 15)::BIGINT / 1e6::DOUBLE AS cost_usd
    FROM answers GROUP BY ROLLUP (image, finish_reason)""")
def _(spark, sf):
    return A.usage_totals(X.answers(spark, sf), ["image", "finish_reason"])


@query("j13_transferred_opinions", "opinions", """
    WITH tgt AS (SELECT * FROM opinions WHERE event_id % 3 = 0), src AS (SELECT * FROM opinions WHERE event_id % 3 <> 0)
    SELECT image, noun, event_id FROM tgt UNION ALL
    SELECT image, noun, event_id FROM src WHERE image IN (SELECT image FROM tgt) AND (image, noun) NOT IN (SELECT (image, noun) FROM tgt)""")
def _(spark, sf):
    rows = X.opinions(spark, sf)
    target, source = rows.filter("event_id % 3 = 0"), rows.filter("event_id % 3 != 0")
    return A.transfer_opinions(target, source, target).select("image", "noun", "event_id")


@query("st07_batch_health_replay", "answers", """
    WITH b AS (SELECT request_id // 50 AS batch, finish_reason = 'stop' AND content <> '' AS valid, 50 AS expected FROM answers),
         g AS (SELECT batch, max(expected)::INT AS expected, count(*) AS n_answers, count(*) FILTER (WHERE valid) AS n_valid FROM b GROUP BY batch)
    SELECT *, n_answers >= expected AS done, n_valid >= expected * 0.8::DOUBLE AS accepted, (SELECT count(*) FROM g WHERE n_answers >= expected AND n_valid < expected * 0.8::DOUBLE) >= 5 AS stop FROM g""")
def _(spark, sf):
    rows = X.answers(spark, sf).select(
        F.expr("request_id div 50").alias("batch"), ((F.col("finish_reason") == "stop") & (F.col("content") != "")).alias("valid"), F.lit(50).alias("expected")
    )
    return A.batch_health(rows)
