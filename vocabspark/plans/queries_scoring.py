"""Queries on predictions, annotations and leaderboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import decoding as D
from ..functions.register import register_functions
from ..operators import scoring as S
from ..sources import documents as J
from . import fixtures as X
from . import reports as R
from .registry import query

_COUNTS = (
    "count(*) FILTER (WHERE {c} = 'correct_primary') AS correct_primary, count(*) FILTER (WHERE {c} = 'correct_secondary') AS correct_secondary, "
    "count(*) FILTER (WHERE {c} = 'close_primary') AS close_primary, count(*) FILTER (WHERE {c} = 'close_secondary') AS close_secondary, "
    "count(*) FILTER (WHERE {c} = 'incorrect') AS incorrect, count(*) FILTER (WHERE {c} IS NULL) AS other"
)
_SCORE = "0.0 + correct_primary * 1.0::DOUBLE + correct_secondary * 0.8::DOUBLE + close_primary * 0.5::DOUBLE + close_secondary * 0.4::DOUBLE + incorrect * 0.0::DOUBLE"

# Running best category in SQL: the item's own category if it reaches the best weight so far, else the earliest best.
_CUM = """
  run AS (SELECT *, max(cscore) OVER w AS best, arg_max(coalesce(category, '-'), (cscore, -k)) OVER w AS best_cat
          FROM scored WINDOW w AS (PARTITION BY file, gencfg, sample ORDER BY k ROWS UNBOUNDED PRECEDING)),
  cum AS (SELECT file, model, gencfg, sample, k, CASE WHEN cscore = best THEN category WHEN best_cat <> '-' THEN best_cat END AS counted FROM run),
  topk AS (SELECT *, {score} AS score, ({score}) / n AS score_ratio FROM (
      SELECT file, model, gencfg, k, count(*) AS n, {counts} FROM cum WHERE k <= {{k}} GROUP BY ALL))
""".format(score=_SCORE, counts=_COUNTS.format(c="counted"))


def cum_sql(k: int, body: str) -> str:
    return "WITH " + _CUM.strip().replace("{k}", str(k)) + "\n" + body


def scored(spark, sf):
    return S.attach_category(X.predictions(spark, sf), X.annotations(spark, sf))


def _rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("j06_prediction_category", "scored", "SELECT file, gencfg, sample, k, pred, category FROM scored")
def _(spark, sf):
    return scored(spark, sf).select("file", "gencfg", "sample", "k", "pred", "category")


@query("a02_category_score", "scored", f"""
    SELECT file, model, gencfg, n, correct_primary, correct_secondary, close_primary, close_secondary, incorrect, other,
           round({_SCORE}, 6) AS score, round(({_SCORE}) / n, 6) AS score_ratio
    FROM (SELECT file, model, gencfg, count(*) AS n, {_COUNTS.format(c='category')} FROM scored WHERE k = 1 GROUP BY ALL)""")
def _(spark, sf):
    return _rounded(S.score_top1(scored(spark, sf)), "score", "score_ratio")


@query("a03_multiple_categories", "predictions annotations", """
    SELECT sample, noun, string_agg(category, ',' ORDER BY category) AS categories FROM annotations
    WHERE (sample, noun) IN (SELECT (sample, pred) FROM predictions) GROUP BY ALL HAVING count(*) > 1""")
def _(spark, sf):
    return S.multiple_categories(X.predictions(spark, sf), X.annotations(spark, sf))


@query("w01_cumulative_best_category", "scored", cum_sql(5, "SELECT file, gencfg, sample, k, counted FROM cum"))
def _(spark, sf):
    return S.cumulative_best_category(scored(spark, sf), 5).select("file", "gencfg", "sample", "k", "counted")


@query("a04_topk_scores", "scored", cum_sql(5, """
    SELECT file, gencfg, k, n, round(score, 6) AS score, round(score_ratio, 6) AS score_ratio FROM topk"""))
def _(spark, sf):
    rows = S.topk_scores(scored(spark, sf), 5).select("file", "gencfg", "k", "n", "score", "score_ratio")
    return _rounded(rows, "score", "score_ratio")


@query("a05_category_counts", "scored", cum_sql(5, """
    SELECT file, model, gencfg, k, n, correct_primary, correct_secondary, close_primary, close_secondary, incorrect, other FROM topk"""))
def _(spark, sf):
    return S.topk_scores(scored(spark, sf), 5).drop("score", "score_ratio")


@query("a06_missing_nouns", "predictions annotations", """
    SELECT DISTINCT sample, pred AS noun FROM predictions p WHERE sample IN (SELECT sample FROM annotations)
    AND NOT EXISTS (SELECT 1 FROM annotations a WHERE a.sample = p.sample AND a.noun = p.pred)""")
def _(spark, sf):
    return S.missing_nouns(X.predictions(spark, sf), X.annotations(spark, sf))


@query("a06_missing_samples", "predictions annotations", """
    SELECT DISTINCT sample FROM predictions WHERE sample NOT IN (SELECT sample FROM annotations)""")
def _(spark, sf):
    return S.missing_samples(X.predictions(spark, sf), X.annotations(spark, sf))


@query("a07_model_maximum", "scored", cum_sql(1, """
    SELECT file, model, gencfg, n, round(score, 6) AS score FROM topk
    QUALIFY row_number() OVER (PARTITION BY file ORDER BY score DESC, gencfg) = 1"""))
def _(spark, sf):
    best = S.model_maximum(S.topk_scores(scored(spark, sf), 1))
    return _rounded(best.select("file", "model", "gencfg", "n", "score"), "score")


@query("a08_score_grid", "scored", cum_sql(5, """
    , means AS (SELECT gencfg, k, avg(score) AS score, avg(score_ratio) AS ratio FROM topk GROUP BY ALL)
    SELECT 'cell' AS kind, gencfg, file, k, round(score, 6) AS score, round(score_ratio, 6) AS ratio FROM topk
    UNION ALL SELECT 'mean', gencfg, NULL, k, round(score, 6), round(ratio, 6) FROM means
    UNION ALL SELECT 'max', NULL, file, k, round(max(score), 6), round(arg_max(score_ratio, (score, score_ratio)), 6) FROM topk GROUP BY file, k
    UNION ALL SELECT 'top', arg_max(gencfg, (score, ratio)), NULL, k, round(max(score), 6), round(arg_max(ratio, (score, ratio)), 6) FROM means GROUP BY k"""))
def _(spark, sf):
    return _rounded(S.score_grid(S.topk_scores(scored(spark, sf), 5)), "score", "ratio")


@query("a08_best_cell", "scored", cum_sql(1, """
    SELECT file, gencfg, round(score_ratio, 6) AS score_ratio FROM topk ORDER BY topk.score_ratio DESC, file, gencfg LIMIT 1"""))
def _(spark, sf):
    return _rounded(S.best_cell(S.topk_scores(scored(spark, sf), 1)), "score_ratio")


_SPEC = """
    SELECT file, model, gencfg, count(*) AS n, count(*) FILTER (WHERE cat IS NULL) AS n_missing,
           round(sum(coalesce(cscore, 0)) / count(*), 6) AS prediction_score,
           round(sum(coalesce(cscore, 0) * specificity) / count(*), 6) AS overall_score
    FROM predictions p LEFT JOIN (SELECT sample, noun, arg_max(category, list_position(['correct_primary', 'correct_secondary', 'close_primary', 'close_secondary', 'incorrect'], category)) AS cat
                                  FROM annotations GROUP BY ALL) a ON a.sample = p.sample AND a.noun = p.pred
         LEFT JOIN cat_scores s ON s.category = a.cat JOIN specificity sp ON sp.noun = p.pred
    WHERE k = 1 GROUP BY ALL"""


@query("a09_specificity_scores", "predictions annotations specificity cat_scores", _SPEC)
def _(spark, sf):
    rows = S.specificity_scores(X.predictions(spark, sf), X.annotations(spark, sf), X.specificity(spark, sf), strict=False)
    return _rounded(rows, "prediction_score", "overall_score")


@query("r09_specificity_report", "predictions annotations specificity cat_scores", f"""
    SELECT *, printf('%.2f%%', round(100 * prediction_score, 2)) AS prediction_text, printf('%.2f%%', round(100 * overall_score, 2)) AS overall_text,
           rank() OVER (ORDER BY prediction_score DESC)::INT AS prediction_place, rank() OVER (ORDER BY overall_score DESC)::INT AS overall_place
    FROM ({_SPEC.replace(', 6)', ', 9)')})""")
def _(spark, sf):
    rows = R.specificity_report(X.predictions(spark, sf), X.annotations(spark, sf), X.specificity(spark, sf), strict=False)
    return rows.withColumns({c: F.round(c, 9) for c in ("prediction_score", "overall_score")})


@query("j08_prediction_specificity", "predictions specificity", """
    SELECT file, gencfg, sample, k, pred, specificity FROM predictions JOIN specificity ON noun = pred""")
def _(spark, sf):
    rows = S.attach_specificity(X.predictions(spark, sf), X.specificity(spark, sf), strict=True)
    return rows.select("file", "gencfg", "sample", "k", "pred", "specificity")


def results(spark, sf):
    vocab = X.vocab(spark, sf).select("id", F.col("target_noun").alias("noun"))
    correct = S.correct_set(X.annotations(spark, sf))
    return S.result_types(X.predictions(spark, sf), correct, vocab.filter("id % 2 = 0"), vocab.filter("id % 5 != 0"))


_RESULTS = """
  results AS (SELECT p.*, EXISTS (SELECT 1 FROM annotations a WHERE a.sample = p.sample AND a.noun = p.pred AND a.category IN ('correct_primary', 'correct_secondary')) AS correct,
                     noun_id % 2 = 0 AS valid_guide, noun_id % 5 <> 0 AS valid_vocab FROM predictions p),
  coded AS (SELECT *, CASE WHEN correct THEN 0 WHEN valid_guide THEN 1 WHEN valid_vocab THEN 2 ELSE 3 END AS result FROM results),
  hits AS (SELECT file, model, gencfg, sample, k, min(result) OVER w AS best, max(result) OVER w AS worst FROM coded
           WINDOW w AS (PARTITION BY file, gencfg, sample ORDER BY k ROWS UNBOUNDED PRECEDING)),
  ratios AS (SELECT file, model, gencfg, k, count(*) AS n, count(*) FILTER (WHERE best = 0) / count(*) AS topk,
                    count(*) FILTER (WHERE best <= 1) / count(*) AS topk_guide, count(*) FILTER (WHERE best <= 2) / count(*) AS topk_vocab,
                    count(*) FILTER (WHERE worst = 3) / count(*) AS topk_invalid, (count(*) - count(*) FILTER (WHERE worst = 3)) / count(*) AS topk_valid
             FROM hits GROUP BY ALL)
"""


def result_sql(body: str) -> str:
    return "WITH " + _RESULTS.strip() + "\n" + body


@query("a10_result_types", "predictions annotations", result_sql("SELECT file, gencfg, sample, k, pred, result FROM coded"))
def _(spark, sf):
    return results(spark, sf).select("file", "gencfg", "sample", "k", "pred", "result")


@query("a11_topk_hit_ratios", "predictions annotations", result_sql("SELECT * FROM ratios"))
def _(spark, sf):
    return S.topk_hit_ratios(results(spark, sf))


@query("w02_cumulative_any_hit", "predictions annotations", result_sql("SELECT file, gencfg, sample, k, best <= 1 AS any_guide FROM hits"))
def _(spark, sf):
    from ..operators.windows import cumulative_any

    rows = results(spark, sf).withColumn("hit", F.col("correct") | F.col("valid_guide"))
    hits = cumulative_any(rows, ["file", "gencfg", "sample"], "k", "hit", "any_guide")
    return hits.select("file", "gencfg", "sample", "k", "any_guide")


@query("a12_direct_guided_buckets", "predictions annotations", result_sql("""
    SELECT file, model, n, correct_correct, correct_incorrect, valid_correct, valid_incorrect, invalid_correct, invalid_incorrect,
           (correct_correct + correct_incorrect) / n AS direct_correct, (valid_correct + valid_incorrect) / n AS direct_valid,
           (invalid_correct + invalid_incorrect) / n AS direct_invalid, (correct_correct + valid_correct + invalid_correct) / n AS guided_correct,
           (correct_incorrect + valid_incorrect + invalid_incorrect) / n AS guided_incorrect
    FROM (SELECT d.file, d.model, count(*) AS n,
                 count(*) FILTER (WHERE d.correct AND g.correct) AS correct_correct, count(*) FILTER (WHERE d.correct AND NOT g.correct) AS correct_incorrect,
                 count(*) FILTER (WHERE NOT d.correct AND d.valid_vocab AND g.correct) AS valid_correct,
                 count(*) FILTER (WHERE NOT d.correct AND d.valid_vocab AND NOT g.correct) AS valid_incorrect,
                 count(*) FILTER (WHERE NOT d.correct AND NOT d.valid_vocab AND g.correct) AS invalid_correct,
                 count(*) FILTER (WHERE NOT d.correct AND NOT d.valid_vocab AND NOT g.correct) AS invalid_incorrect
          FROM results d JOIN results g ON g.file = d.file AND g.sample = d.sample AND g.k = 1 AND g.gencfg LIKE '%gp%'
          WHERE d.k = 1 AND d.gencfg LIKE '%gn%' GROUP BY ALL)"""))
def _(spark, sf):
    rows = results(spark, sf).filter("k = 1")
    return S.direct_guided_buckets(rows.filter("gencfg LIKE '%gn%'"), rows.filter("gencfg LIKE '%gp%'"))


@query("a12_unguided_buckets", "predictions annotations", result_sql("""
    SELECT file, model, count(*) AS n, count(*) FILTER (WHERE correct) AS correct_correct, count(*) FILTER (WHERE NOT correct AND valid_vocab) AS valid_incorrect,
           count(*) FILTER (WHERE NOT correct AND NOT valid_vocab) AS invalid_incorrect, count(*) FILTER (WHERE correct) / count(*) AS guided_correct
    FROM results WHERE k = 1 AND gencfg LIKE '%gn%' GROUP BY ALL"""))
def _(spark, sf):
    rows = results(spark, sf).filter("k = 1 AND gencfg LIKE '%gn%'")
    return S.direct_guided_buckets(rows).select(
        "file", "model", "n", "correct_correct", "valid_incorrect", "invalid_incorrect", "guided_correct"
    )


@query("a14_mean_over_models", "predictions annotations", result_sql("""
    SELECT gencfg, k, round(mean, 6) AS mean, mean = max(mean) OVER (PARTITION BY k) AS is_best
    FROM (SELECT g.gencfg, g.k, CASE WHEN count(r.file) = (SELECT count(DISTINCT file) FROM ratios) THEN avg(r.topk) ELSE '-inf'::DOUBLE END AS mean
          FROM (SELECT DISTINCT gencfg, u.k FROM ratios, (VALUES (1), (2), (3), (4), (5)) u(k)) g LEFT JOIN ratios r ON r.gencfg = g.gencfg AND r.k = g.k GROUP BY ALL)"""))
def _(spark, sf):
    means = S.mean_over_models(S.topk_hit_ratios(results(spark, sf)), "topk", 5)
    return means.withColumn("mean", F.when(F.col("mean") == float("-inf"), F.col("mean")).otherwise(F.round("mean", 6)))


_CUBE = """
    SELECT k, gencfg, dataset, avg(topk) AS mean, count(*) AS n, grouping(gencfg) AS g, grouping(dataset) AS d
    FROM (SELECT k, gencfg, 'set_' || (sid % 3) AS dataset, file, count(*) FILTER (WHERE best = 0) / count(*) AS topk
          FROM (SELECT *, CAST(sample[5:] AS BIGINT) AS sid FROM hits) GROUP BY ALL)
    GROUP BY ROLLUP (k, gencfg, dataset) HAVING grouping(k) = 0"""


def dataset_cube(spark, sf):
    rows = results(spark, sf).withColumn("dataset", F.concat(F.lit("set_"), (F.col("sample_id") % 3).cast("string")))
    # The dataset takes the model's place in the group, so that each set has its own ratios.
    per_set = S.topk_hit_ratios(rows.withColumn("model", F.col("dataset"))).withColumnRenamed("model", "dataset")
    return S.dataset_cube(per_set, "topk")


@query("a15_dataset_cube", "predictions annotations", result_sql(f"""
    SELECT k, gencfg, dataset, round(mean, 6) AS mean, n,
           CASE WHEN g = 0 THEN row_number() OVER (PARTITION BY g, d, k, dataset ORDER BY round(mean, 9) DESC, gencfg) END::INT AS rank,
           CASE WHEN g = 0 THEN round(mean, 9) = max(round(mean, 9)) OVER (PARTITION BY g, d, k, dataset) END AS is_best
    FROM ({_CUBE})"""))
def _(spark, sf):
    return _rounded(dataset_cube(spark, sf), "mean")


@query("a15_best_decodings", "predictions annotations", result_sql(f"""
    SELECT dataset, arg_min(gencfg, (-round(mean, 9), gencfg)) AS gencfg, round(max(mean), 6) AS mean, arg_min(n, (-round(mean, 9), gencfg)) AS n
    FROM ({_CUBE}) WHERE g = 0 AND k = 1 GROUP BY d, dataset"""))
def _(spark, sf):
    return _rounded(S.best_decodings(dataset_cube(spark, sf)), "mean")


@query("l01_ordered_report", "scored", cum_sql(1, """
    SELECT file || ' ' || gencfg AS name, round(score, 6) AS score, 'score ' || round(score_ratio * 1000) AS cell FROM topk"""))
def _(spark, sf):
    rows = S.topk_scores(scored(spark, sf), 1).select(
        F.concat_ws(" ", "file", "gencfg").alias("name"), F.round("score", 6).alias("score"),
        F.concat(F.lit("score "), F.round(F.col("score_ratio") * 1000).cast("string")).alias("cell"),
    )
    return R.order_report(rows, "-0Cell")


@query("l02_top_k", "candidates", """
    SELECT file, gencfg, sample, pred, score, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY file, gencfg, sample ORDER BY score DESC, pred) AS rank FROM candidates) WHERE rank <= 2""")
def _(spark, sf):
    return S.top_k(X.candidates(spark, sf), 2).select("file", "gencfg", "sample", "pred", "score", "rank")


@query("s05_correct_set", "annotations", """
    SELECT DISTINCT sample, noun FROM annotations WHERE category IN ('correct_primary', 'correct_secondary')""")
def _(spark, sf):
    return S.correct_set(X.annotations(spark, sf))


@query("s03_unknown_guides", "annotations vocab", """
    SELECT DISTINCT noun FROM annotations WHERE noun NOT IN (SELECT target_noun FROM vocab WHERE id % 2 = 0)""")
def _(spark, sf):
    from ..operators.setops import unknown_guides

    targets = X.vocab(spark, sf).filter("id % 2 = 0").select(F.col("target_noun").alias("noun"))
    return unknown_guides(X.annotations(spark, sf), targets)


@query("s07_all_keys", "predictions annotations", "SELECT sample FROM predictions UNION SELECT sample FROM annotations")
def _(spark, sf):
    from ..operators.setops import all_keys

    return all_keys(X.predictions(spark, sf).select("sample"), X.annotations(spark, sf).select("sample"))


@query("pf08_drop_annotated", "predictions annotations", """
    SELECT file, gencfg, sample, pred FROM predictions p WHERE NOT EXISTS (SELECT 1 FROM annotations a WHERE a.sample = p.sample AND a.noun = p.pred)""")
def _(spark, sf):
    return S.drop_annotated(X.predictions(spark, sf), X.annotations(spark, sf)).select("file", "gencfg", "sample", "pred")


@query("a26_prediction_sets", "predictions", "SELECT DISTINCT sample AS image, pred AS noun FROM predictions WHERE k <= 2 AND gencfg LIKE 'beam_k5%'")
def _(spark, sf):
    return S.prediction_sets(X.predictions(spark, sf), 2, ["beam_k5_vnone_gp_t1_a0"])


@query("r01_noun_report", "predictions annotations", result_sql("""
    SELECT file, gencfg, sample, k, pred, score, CASE WHEN correct THEN 0 ELSE result END AS code FROM coded WHERE k <= 3"""))
def _(spark, sf):
    return R.noun_report(results(spark, sf), S.correct_set(X.annotations(spark, sf)), 3)


@query("r02_topk_report", "scored", cum_sql(3, """
    SELECT gencfg, file, model, max(correct_primary) FILTER (WHERE k = 1) AS correct_primary, max(correct_secondary) FILTER (WHERE k = 1) AS correct_secondary,
           max(close_primary) FILTER (WHERE k = 1) AS close_primary, max(close_secondary) FILTER (WHERE k = 1) AS close_secondary,
           max(incorrect) FILTER (WHERE k = 1) AS incorrect, max(other) FILTER (WHERE k = 1) AS other,
           max(round(score, 6)) FILTER (WHERE k = 1) AS score_1, max(round(score, 6)) FILTER (WHERE k = 2) AS score_2, max(round(score, 6)) FILTER (WHERE k = 3) AS score_3,
           max(round(score_ratio, 6)) FILTER (WHERE k = 1) AS score_ratio_1, max(round(score_ratio, 6)) FILTER (WHERE k = 2) AS score_ratio_2,
           max(round(score_ratio, 6)) FILTER (WHERE k = 3) AS score_ratio_3
    FROM topk GROUP BY ALL"""))
def _(spark, sf):
    report = R.topk_report(X.predictions(spark, sf), X.annotations(spark, sf), 3, sort="-score_1")
    return _rounded(report, *[f"{c}_{i}" for c in ("score", "score_ratio") for i in (1, 2, 3)])


@query("r03_model_max_report", "scored", cum_sql(1, """
    SELECT file, model, gencfg, round(score, 6) AS score, n, correct_primary, correct_secondary, close_primary, close_secondary, incorrect, other,
           round(score_ratio, 6) AS score_ratio FROM topk QUALIFY row_number() OVER (PARTITION BY file ORDER BY topk.score DESC, gencfg) = 1"""))
def _(spark, sf):
    return _rounded(R.model_max_report(X.predictions(spark, sf), X.annotations(spark, sf)), "score", "score_ratio")


@query("r04_grid_report", "scored", cum_sql(2, """
    , means AS (SELECT gencfg, k, avg(score) AS score, avg(score_ratio) AS ratio FROM topk GROUP BY ALL),
      best AS (SELECT file, k, max(score) AS score, arg_max(score_ratio, (score, score_ratio)) AS ratio FROM topk GROUP BY file, k)
    SELECT file, k, round(score, 6) AS score, round(ratio, 6) AS ratio, round(score - top, 6) AS above_mean
    FROM best JOIN (SELECT k, max(score) AS top FROM means GROUP BY k) USING (k)"""))
def _(spark, sf):
    return _rounded(R.grid_report(X.predictions(spark, sf), X.annotations(spark, sf), 2), "score", "ratio", "above_mean")


_DECODINGS = """
    WITH c AS (SELECT o_orderkey, ['greedy', 'beam', 'all'][(o_orderkey % 3 + 1)::INT] AS method, (o_custkey % 9 + 1)::INT AS topk, o_orderkey % 4 > 0 AS vocab_prior,
                      o_orderkey % 4 > 0 AND o_orderkey % 2 = 0 AS vocab_per_token, CASE WHEN o_orderkey % 4 > 0 THEN (o_custkey % 8) / 4.0 ELSE 0 END::DOUBLE AS vocab_scaler,
                      o_custkey % 3 > 0 AS guided, o_custkey % 3 = 2 AS guide_renorm, ((o_orderkey % 5 + 1) / 2.0)::DOUBLE AS temperature, ((o_custkey % 3) / 8.0)::DOUBLE AS length_alpha
               FROM orders)
    SELECT *, method || '_k' || topk || '_v' || CASE WHEN vocab_prior THEN CASE WHEN vocab_per_token THEN 'tok' ELSE 'tgt' END
              || rtrim(rtrim(printf('%.3f', vocab_scaler), '0'), '.') ELSE 'none' END || '_g' || CASE WHEN NOT guided THEN 'n' WHEN guide_renorm THEN 'r' ELSE 'p' END
              || '_t' || rtrim(rtrim(printf('%.3f', temperature), '0'), '.') || '_a' || rtrim(rtrim(printf('%.3f', length_alpha), '0'), '.') AS name, true AS valid, true AS round_trip FROM c"""


def decodings(spark, sf):
    """Decoding configurations derived from orders, with their names."""
    orders = X.table(spark, sf, "orders")
    prior = F.col("o_orderkey") % 4 > 0
    cfg = F.struct(
        F.get(F.array(F.lit("greedy"), F.lit("beam"), F.lit("all")), (F.col("o_orderkey") % 3).cast("int")).alias("method"),
        (F.col("o_custkey") % 9 + 1).cast("int").alias("topk"),
        prior.alias("vocab_prior"),
        (prior & (F.col("o_orderkey") % 2 == 0)).alias("vocab_per_token"),
        F.when(prior, (F.col("o_custkey") % 8) / 4.0).otherwise(0.0).alias("vocab_scaler"),
        (F.col("o_custkey") % 3 > 0).alias("guided"),
        (F.col("o_custkey") % 3 == 2).alias("guide_renorm"),
        ((F.col("o_orderkey") % 5 + 1) / 2.0).alias("temperature"),
        ((F.col("o_custkey") % 3) / 8.0).alias("length_alpha"),
    )
    return orders.select("o_orderkey", cfg.alias("cfg")).withColumn("name", D.make_name(F.col("cfg")))


@query("f12_decoding_names", "", _DECODINGS)
def _(spark, sf):
    parsed = decodings(spark, sf).withColumn("parsed", D.parse_name(F.col("name")))
    return parsed.select("o_orderkey", "parsed.*", "name", (D.make_name(F.col("parsed")) == F.col("name")).alias("round_trip"))


@query("f12_sql_functions", "", f"SELECT * EXCLUDE (valid), topk AS sql_topk FROM ({_DECODINGS})")
def _(spark, sf):
    register_functions(spark)
    decodings(spark, sf).select("o_orderkey", "name").createOrReplaceTempView("vocabspark_decodings")
    return spark.sql("""
        SELECT o_orderkey, c.*, decoding_topk(name) AS sql_topk, name, decoding_name(c) = name AS round_trip
        FROM (SELECT o_orderkey, name, decoding_config(name) AS c FROM vocabspark_decodings)""")


@query("io05_normalised_documents", "predictions", """
    SELECT file, model, gencfg, gen_topk::INT AS gen_topk, sample, k, pred, score FROM predictions""")
def _(spark, sf):
    """Documents are built per (file, block of samples) and read back with the document reader's own flattening."""
    rows = X.predictions(spark, sf).withColumn("block", F.expr("sample_id div 64"))
    docs = J.prediction_documents(rows, ["block"])
    return J.flatten_predictions(docs).select("file", "model", "gencfg", "gen_topk", "sample", "k", "pred", "score")


@query("io07_upsert_samples", "predictions annotations", """
    SELECT sample, category, noun FROM annotations
    UNION ALL SELECT DISTINCT sample, NULL, NULL FROM predictions WHERE sample NOT IN (SELECT sample FROM annotations)""")
def _(spark, sf):
    return J.upsert_samples(X.annotations(spark, sf), X.predictions(spark, sf).select("sample"))
