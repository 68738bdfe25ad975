"""Queries on run rows, logs, documents and page images."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs as R
from ..operators import scoring as S
from ..operators import windows as W
from ..session import cut_lineage
from . import fixtures as X
from . import reports as RP
from .registry import query

PATTERNS = {
    "eval_nouns": r"nouns_v[0-9]+\.bin",
    "eval_nouns2": r"nouns2_v[0-9]+\.bin",
    "eval_captions2": r"captions2_v[0-9]+\.bin",
    "any_nouns": r"nouns[0-9]?_v[0-9]+\.bin",
}
PAIRS = {"shapes": r"shapes_valid_$TYPE_v[0-9]+\.bin"}
CLASSES = "classes1k"
_ALL = PATTERNS | {f"shapes_{kind}": PAIRS["shapes"].replace("$TYPE", kind) for kind in ("multi", "guide")}

_PICKED = """
  ev AS (SELECT model_dir, model_name, dataset, arg_min(noun_top1, (-epoch_us(created_at), run_id)) AS noun_top1, arg_min(top1, (-epoch_us(created_at), run_id)) AS top1,
                min((-epoch_us(created_at), run_id)) AS first FROM runs WHERE action = 'eval' AND dataset IS NOT NULL GROUP BY ALL),
  pats AS (SELECT * FROM (VALUES {values}) p(col, pat)),
  picked AS (SELECT model_dir, model_name, col AS "column", arg_min(noun_top1, first) AS noun_top1, arg_min(top1, first) AS top1, count(*) AS n_options
             FROM ev JOIN pats ON regexp_full_match(dataset, pat) GROUP BY ALL)""".format(
    values=", ".join(f"('{k}', '{v}')" for k, v in _ALL.items())
)
_TOP1 = ", ".join([f"max(noun_top1) FILTER (WHERE \"column\" = '{c}') AS {c}" for c in _ALL] + [f"max(top1) FILTER (WHERE \"column\" = '{c}') AS {c}_token" for c in PATTERNS])
_BOARD = f"""
  heads AS (SELECT model_dir, model_name, arg_min(tag, (-epoch_us(created_at), run_id)) AS tag, arg_min(command, (-epoch_us(created_at), run_id)) AS command,
                   count(DISTINCT tag) <= 1 AND count(DISTINCT command) <= 1 AS consistent FROM runs GROUP BY ALL),
  cls AS (SELECT model_dir, model_name, valid, direct, fixed, noun_top1 AS guided FROM runs WHERE action = 'eval_cls' AND dataset = '{CLASSES}' AND coalesce(valid, direct, fixed, noun_top1) IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY model_dir, model_name ORDER BY created_at DESC, run_id) = 1),
  tops AS (SELECT model_dir, model_name, {_TOP1} FROM picked GROUP BY ALL),
  board AS (SELECT * FROM heads LEFT JOIN tops USING (model_dir, model_name) LEFT JOIN cls USING (model_dir, model_name))"""


@query("pf10_filtered_runs", "runs", """
    SELECT run_id, action, host, model_dir FROM runs WHERE state = 'finished' AND action IN ('eval', 'infer') AND created_at > '1996-01-01' AND created_at < '2000-01-01'
    AND regexp_full_match(host, 'host-[135]|host-6') AND (model_dir || '/' || model_name IN ('dir_3/m1', 'dir_7/m0') OR model_dir IN ('dir_11', 'dir_12', 'dir_20', 'dir_30'))""")
def _(spark, sf):
    kept = R.filter_runs(
        X.runs(spark, sf), ["eval", "infer"], "1996-01-01", "2000-01-01", ["host-[135]", "host-6"],
        ["dir_3/m1", "dir_7/m0", "dir_11", "dir_12", "dir_20", "dir_30"],
    )
    return kept.select("run_id", "action", "host", "model_dir")


@query("w07_latest_per_model", "runs", """
    SELECT model_dir, model_name, run_id, noun_top1 FROM runs WHERE action = 'infer' QUALIFY row_number() OVER (PARTITION BY model_dir, model_name ORDER BY created_at DESC, run_id) = 1""")
def _(spark, sf):
    return R.latest_per_model(X.runs(spark, sf).filter("action = 'infer'"), "noun_top1").drop("created_at")


@query("a32_eval_results", "runs", f'WITH {_PICKED.strip()} SELECT model_dir, model_name, "column", noun_top1, top1, n_options FROM picked')
def _(spark, sf):
    return R.pick_by_pattern(R.eval_results(X.runs(spark, sf)), _ALL)


@query("a32_class_results", "runs", f"WITH {_PICKED.strip()}, {_BOARD.strip()} SELECT * FROM cls")
def _(spark, sf):
    return R.class_results(X.runs(spark, sf), CLASSES)


@query("r05_eval_report", "runs", f"WITH {_PICKED.strip()}, {_BOARD.strip()} SELECT * FROM board")
def _(spark, sf):
    return RP.eval_report(X.runs(spark, sf), PATTERNS, PAIRS, CLASSES)


_LOGGED = """
  said AS (SELECT run_id, created_at, model_dir, model_name, 'img_' || line || '.jpg' AS sample, arg_max(noun, (line, l_partkey)) AS pred FROM run_logs GROUP BY ALL)"""


@query("f10_parsed_logs", "run_logs", f"WITH {_LOGGED.strip()} SELECT run_id, model_dir, model_name, sample, pred FROM said")
def _(spark, sf):
    return R.parse_run_logs(X.run_logs(spark, sf)).select("run_id", "model_dir", "model_name", "sample", "pred")


_LATEST = """
  newest AS (SELECT model_dir, model_name, arg_min(run_id, (-epoch_us(created_at), run_id)) AS run_id, arg_min(tag, (-epoch_us(created_at), run_id)) AS tag, arg_min(valid, (-epoch_us(created_at), run_id)) AS valid FROM runs WHERE action = 'infer' AND run_id IN (SELECT l_orderkey FROM lineitem) GROUP BY ALL)"""


@query("r06_infer_report", "run_logs", f"""
    WITH {_LOGGED.strip()}, {_LATEST.strip()}
    SELECT n.model_dir, n.model_name, n.run_id, n.tag, n.valid, {', '.join(f"coalesce(max(pred) FILTER (WHERE sample = 'img_{i}.jpg'), '-') AS img_{i}" for i in range(1, 8))}
    FROM newest n LEFT JOIN said s ON s.run_id = n.run_id GROUP BY ALL""")
def _(spark, sf):
    return RP.infer_report(X.run_logs(spark, sf))


def annotations(spark, sf):
    """Annotations of the seven images: category by part key."""
    part = X.table(spark, sf, "part")
    code = F.col("p_partkey") % 9
    category = F.when(code < 3, "correct_primary").when(code == 3, "correct_secondary").when(code == 4, "close_primary").when(code < 7, "incorrect")
    images = F.explode(F.array(*[F.lit(f"img_{i}.jpg") for i in range(1, 8)]))
    return part.select(images.alias("sample"), category.alias("category"), X.part_noun().alias("noun")).filter("category IS NOT NULL")


_SCORES = """
  sc AS (SELECT s.model_dir, s.model_name, s.run_id, count(*) AS n, sum(CASE WHEN l % 9 < 3 THEN 10 WHEN l % 9 = 3 THEN 8 WHEN l % 9 = 4 THEN 5 ELSE 0 END)::BIGINT AS tenths
         FROM (SELECT *, regexp_extract(pred, ' ([0-9]+)$', 1)::BIGINT AS l FROM said) s JOIN newest n ON n.run_id = s.run_id GROUP BY ALL)"""


@query("r07_all_report", "run_logs", f"""
    WITH {_PICKED.strip()}, {_BOARD.strip()}, {_LOGGED.strip()}, {_LATEST.strip()}, {_SCORES.strip()},
         i AS (SELECT w.model_dir, w.model_name, w.valid AS infer_valid, sc.n, sc.tenths FROM newest w LEFT JOIN sc USING (model_dir, model_name))
    SELECT model_dir, model_name, coalesce(tag, '-') AS tag, coalesce(command, '-') AS command, eval_captions2, eval_captions2_token, valid, direct, fixed, guided, shapes_multi, shapes_guide, infer_valid,
           coalesce(n, 0) AS n, round(coalesce(tenths, 0) / 10.0, 6)::DOUBLE AS score, round(tenths / 10.0 / n, 6)::DOUBLE AS score_ratio
    FROM board FULL JOIN i USING (model_dir, model_name)""")
def _(spark, sf):
    captions = {"eval_captions2": PATTERNS["eval_captions2"]}
    report = RP.all_report(X.run_logs(spark, sf), X.runs(spark, sf), annotations(spark, sf), captions, PAIRS, CLASSES)
    shown = ["tag", "command", "eval_captions2", "eval_captions2_token", "valid", "direct", "fixed", "guided", "shapes_multi", "shapes_guide", "infer_valid", "n"]
    return report.select("model_dir", "model_name", *shown, F.round("score", 6).alias("score"), F.round("score_ratio", 6).alias("score_ratio"))


@query("j10_merged_results", "runs", """
    WITH e AS (SELECT model_dir, model_name, max(host) AS tag, max(run_id % 3)::VARCHAR AS command FROM runs WHERE action = 'eval' GROUP BY ALL),
         i AS (SELECT model_dir, model_name, max(host) AS tag, max(run_id % 3)::VARCHAR AS command FROM runs WHERE action = 'infer' GROUP BY ALL)
    SELECT model_dir, model_name, coalesce(e.tag, i.tag, '-') AS tag, coalesce(e.command, i.command, '-') AS command,
           coalesce(e.tag <> i.tag, false) OR coalesce(e.command <> i.command, false) AS mismatch FROM e FULL JOIN i USING (model_dir, model_name)""")
def _(spark, sf):
    runs = X.runs(spark, sf)
    side = lambda action: runs.filter(F.col("action") == action).groupBy("model_dir", "model_name").agg(
        F.max("host").alias("tag"), F.max(F.col("run_id") % 3).cast("string").alias("command")
    )
    return R.merge_results(side("eval"), side("infer"))


def run_documents(spark, sf):
    """Nested documents, one per run: model, a struct and a map with a key only some runs have."""
    rows = X.runs(spark, sf)
    extra = F.when(F.col("run_id") % 2 == 0, F.create_map(F.lit("host"), F.col("host"), F.lit("even"), F.lit("1"))).otherwise(
        F.create_map(F.lit("host"), F.col("host"))
    )
    return rows.select(
        F.col("model_dir").alias("grp"), F.col("run_id").alias("doc"), "action",
        F.struct(F.col("dataset").alias("dataset"), F.lit(3).alias("depth")).alias("cfg"), extra.alias("infer"),
    )


_FLAT = """
  flat AS (SELECT model_dir AS grp, run_id AS doc, unnest(['action', 'cfg.dataset', 'cfg.depth', 'infer.host']) AS key, unnest([action, dataset, '3', host]) AS value FROM runs
           UNION ALL SELECT model_dir, run_id, 'infer.even', '1' FROM runs WHERE run_id % 2 = 0),
  docs AS (SELECT model_dir AS grp, count(*) AS n_docs FROM runs GROUP BY model_dir),
  keyed AS (SELECT grp, key, count(DISTINCT value) AS n_values, count(value) AS n_present FROM flat GROUP BY grp, key),
  diff AS (SELECT grp, key, n_values, n_present, n_docs FROM keyed JOIN docs USING (grp) WHERE n_values + CASE WHEN n_present < n_docs THEN 1 ELSE 0 END > 1)"""


@query("a27_differing_fields", "runs", f"WITH {_FLAT.strip()} SELECT * FROM diff")
def _(spark, sf):
    flat = R.flatten_documents(run_documents(spark, sf), ["grp", "doc"])
    return R.differing_fields(flat, ["grp"], "doc")


@query("r08_diff_report", "runs", f"WITH {_FLAT.strip()} SELECT grp, key, doc, value FROM flat SEMI JOIN diff USING (grp, key)")
def _(spark, sf):
    return RP.diff_report(run_documents(spark, sf), ["grp"], "doc")


@query("w06_ewa_metrics", "run_metrics", """
    WITH b AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) - 1 AS batch_id FROM run_metrics),
         e AS (SELECT run_id, batch_id, sum(loss_sum * 2.0::DOUBLE ** (batch_id / 8.0::DOUBLE)) OVER w / sum(loss_basis * 2.0::DOUBLE ** (batch_id / 8.0::DOUBLE)) OVER w AS ewa_loss,
                      sum(correct * 2.0::DOUBLE ** (batch_id / 8.0::DOUBLE)) OVER w / sum(tokens * 2.0::DOUBLE ** (batch_id / 8.0::DOUBLE)) OVER w AS ewa_top1
               FROM b WINDOW w AS (PARTITION BY run_id ORDER BY batch_id))
    SELECT run_id, batch_id, round(ewa_loss, 6) AS ewa_loss, round(ewa_top1, 6) AS ewa_top1, round(max(ewa_top1) OVER (PARTITION BY run_id ORDER BY batch_id), 6) AS ewa_top1_max FROM e""")
def _(spark, sf):
    rows = cut_lineage(W.batch_positions(X.run_metrics(spark, sf)))
    # Small blocks here, so that the carries between blocks and parts take part at any scale.
    out = W.ewa_metrics(rows, halflife=8, chunk=1, block=16)
    return out.withColumns({c: F.round(c, 6) for c in ("ewa_loss", "ewa_top1", "ewa_top1_max")})


@query("w09_chunk_stats", "run_metrics", """
    WITH b AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) - 1 AS batch_id FROM run_metrics)
    SELECT run_id, batch_id // 10 AS chunk, count(*) AS n, min(loss_sum) AS low, round(avg(loss_sum), 6) AS mean, round(coalesce(stddev_samp(loss_sum), 0), 6) AS std, max(loss_sum) AS high FROM b GROUP BY ALL""")
def _(spark, sf):
    stats = W.chunk_stats(W.batch_positions(X.run_metrics(spark, sf)), 10, "loss_sum")
    return stats.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("pf09_page_images", "search_results page_images", """
    WITH t AS (SELECT noun, arg_min(title, rank) AS title FROM search_results WHERE lower(title) NOT LIKE '%disambiguation%' GROUP BY noun)
    SELECT page_id, title, width, height FROM page_images WHERE title IN (SELECT title FROM t) AND width * height BETWEEN 20000 AND 89478485
    AND NOT regexp_matches(lower(source), '\\.(svg|pdf|ogv)$')""".replace("\\\\", "\\"))
def _(spark, sf):
    titles = R.first_page_titles(X.search_results(spark, sf))
    return R.page_image_candidates(titles, X.page_images(spark, sf)).select("page_id", "title", "width", "height")


@query("a21_title_counts", "", "SELECT p_name AS title, count(*) AS n FROM part GROUP BY p_name HAVING count(*) >= 4")
def _(spark, sf):
    return R.title_counts(X.table(spark, sf, "part").select(F.col("p_name").alias("title")))
