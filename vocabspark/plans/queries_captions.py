"""Queries on captions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import captions as C
from ..operators import vocab as V
from . import fixtures as X
from .registry import query

PER_FREQ, TEMPLATES, SAMPLES = 2, 2, 3


@query("pf03_caption_errors", "faulty_captions", """
    WITH d AS (SELECT id, kind, CASE WHEN caption LIKE '%.' THEN caption ELSE caption || '.' END AS c FROM faulty_captions)
    SELECT DISTINCT id, kind, 'no_placeholder' AS rule FROM d WHERE strpos(c, '{' || kind || '}') = 0
    UNION ALL SELECT DISTINCT id, kind, 'repeated' FROM (SELECT id, kind, c FROM d GROUP BY ALL HAVING count(*) > 1)""")
def _(spark, sf):
    return C.caption_errors(X.faulty_captions(spark, sf))


_QUOTA = "quota AS (SELECT id, kind, (least(sum(freq), 10) * 2)::INT AS quota FROM vocab_nouns GROUP BY ALL)"


@query("pf04_caption_lint", "faulty_captions vocab_nouns vocab", f"""
    WITH {_QUOTA}, c AS (SELECT * FROM faulty_captions WHERE id IN (SELECT id FROM vocab)),
         f AS (SELECT *, list_distinct(regexp_extract_all(caption, '\\{{[^{{}}]*\\}}')) AS fields FROM c)
    SELECT v.id, k.kind, 'too_few' AS rule FROM vocab v, (VALUES ('singular'), ('plural')) k(kind) LEFT JOIN quota q ON q.id = v.id AND q.kind = k.kind
        LEFT JOIN (SELECT id, kind, count(*) AS n FROM c GROUP BY ALL) h ON h.id = v.id AND h.kind = k.kind WHERE coalesce(n, 0) < coalesce(quota, 0)
    UNION ALL SELECT DISTINCT id, kind, 'repeated' FROM (SELECT id, kind, caption FROM c GROUP BY ALL HAVING count(*) > 1)
    UNION ALL SELECT DISTINCT id, 'both', 'repeated' FROM (SELECT id, caption FROM c GROUP BY ALL HAVING count(*) > 1)
    UNION ALL SELECT DISTINCT id, kind, 'no_placeholder' FROM c WHERE strpos(caption, '{{' || kind || '}}') = 0
    UNION ALL SELECT DISTINCT id, kind, 'other_placeholder' FROM f WHERE fields <> ['{{' || kind || '}}']
    UNION ALL SELECT DISTINCT id, kind, 'end_punctuation' FROM c WHERE regexp_matches(caption, '[,.?!:]$')
    UNION ALL SELECT DISTINCT id, kind, 'non_ascii' FROM c WHERE replace(strip_accents(caption), 'ß', 'ss') <> caption""")
def _(spark, sf):
    vocab = X.vocab(spark, sf)
    captions = X.faulty_captions(spark, sf).join(vocab.select("id"), "id", "left_semi")
    return C.caption_lint(captions, C.caption_quotas(vocab, PER_FREQ))


@query("g14_caption_quotas", "vocab", """
    SELECT id, least(list_sum(singulars_freq), 10)::INT * 2 AS num_singular_captions, least(coalesce(list_sum(plurals_freq), 0), 10)::INT * 2 AS num_plural_captions FROM vocab""")
def _(spark, sf):
    return C.caption_quotas(X.vocab(spark, sf), PER_FREQ).select("id", "num_singular_captions", "num_plural_captions")


@query("g15_caption_requests", "caption_rows vocab vocab_nouns", f"""
    WITH {_QUOTA}, h AS (SELECT id, kind, count(*) AS n FROM caption_rows GROUP BY ALL),
         w AS (SELECT v.id, v.pretty_noun, v.plurals, v.plurals_freq, coalesce(hs.n, 0) < qs.quota AS s, coalesce(hp.n, 0) < coalesce(qp.quota, 0) AS p
               FROM vocab v LEFT JOIN quota qs ON qs.id = v.id AND qs.kind = 'singular' LEFT JOIN quota qp ON qp.id = v.id AND qp.kind = 'plural'
               LEFT JOIN h hs ON hs.id = v.id AND hs.kind = 'singular' LEFT JOIN h hp ON hp.id = v.id AND hp.kind = 'plural'),
         m AS (SELECT id, CASE WHEN s THEN 'singular' ELSE 'plural' END AS mode, CASE WHEN s THEN pretty_noun ELSE plurals[list_position(plurals_freq, list_max(plurals_freq))] END AS noun FROM w WHERE s OR p)
    SELECT id, mode, noun, printf('{C.CAPTION_REQUEST.replace("'", "''")}', 10, noun, mode) AS prompt FROM m""")
def _(spark, sf):
    vocab = X.vocab(spark, sf)
    have = X.caption_rows(spark, sf).groupBy("id").agg(
        F.count_if(F.col("kind") == "singular").alias("have_singular"), F.count_if(F.col("kind") == "plural").alias("have_plural")
    )
    rows = C.caption_quotas(vocab, PER_FREQ).join(have, "id", "left").fillna(0, ["have_singular", "have_plural"])
    return C.caption_requests(rows, 10)


@query("g16_new_vocabulary_rows", "caption_rows vocab", """
    SELECT id, target_noun, id IN (SELECT id FROM caption_rows) AS had_captions FROM vocab""")
def _(spark, sf):
    vocab = X.vocab(spark, sf)
    lists = X.caption_rows(spark, sf).groupBy("id").agg(
        F.collect_list(F.when(F.col("kind") == "singular", F.col("caption"))).alias("singular_captions"),
        F.collect_list(F.when(F.col("kind") == "plural", F.col("caption"))).alias("plural_captions"),
    )
    table = V.new_vocab_rows(vocab.join(lists, "id"), vocab)
    had = F.size("singular_captions") + F.size("plural_captions") > 0
    return table.select("id", "target_noun", had.alias("had_captions"))


@query("f05_caption_lines", "caption_lines", "SELECT id, seq, row_number() OVER (PARTITION BY seq ORDER BY pos) - 1 AS line, caption FROM caption_lines WHERE numbered")
def _(spark, sf):
    return C.parsed_captions(X.caption_answers(spark, sf))


@query("f06_caption_templates", "caption_lines vocab", r"""
    WITH c AS (SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY pos) - 1 AS line, id, noun, caption FROM caption_lines WHERE numbered)
    SELECT c.seq, c.line, CASE WHEN regexp_matches(caption, '(^|\s)(' || noun || ')(\.)?(''s?|[,.?!:])?(\s|$)', 'i')
             THEN rtrim(regexp_replace(caption, '(^|\s)(' || noun || ')(\.)?(''s?|[,.?!:])?(\s|$)', '\1{singular}\4\5', 'gi'), ',.?!:') END AS singular_template,
           CASE WHEN len(plurals) > 0 AND regexp_matches(caption, '(^|\s)(' || plurals[1] || ')(\.)?(''s?|[,.?!:])?(\s|$)', 'i')
             THEN rtrim(regexp_replace(caption, '(^|\s)(' || plurals[1] || ')(\.)?(''s?|[,.?!:])?(\s|$)', '\1{plural}\4\5', 'gi'), ',.?!:') END AS plural_template
    FROM c JOIN vocab v ON v.id = c.id""")
def _(spark, sf):
    captions = C.parsed_captions(X.caption_answers(spark, sf))
    return C.templated_captions(captions, X.vocab(spark, sf)).select("seq", "line", "singular_template", "plural_template")


_FIT = r"""list_filter(list_transform({names}, lambda n: CASE WHEN regexp_matches(caption, '(^|\s)(' || n || ')(\.)?(''s?|[,.?!:])?(\s|$)', 'i')
               THEN rtrim(regexp_replace(caption, '(^|\s)(' || n || ')(\.)?(''s?|[,.?!:])?(\s|$)', '\1{{{field}}}\4\5', 'gi'), ',.?!:') END), lambda t: t IS NOT NULL)"""
_SINGULAR = _FIT.format(names="CASE WHEN len(singulars) > 0 THEN list_prepend(pretty_noun, singulars) ELSE singulars END", field="singular")


@query("f07_collected_captions", "caption_lines vocab vocab_nouns", f"""
    WITH RECURSIVE {_QUOTA},
         w AS (SELECT v.*, coalesce(s.quota, 0) AS want_s, coalesce(p.quota, 0) AS want_p FROM vocab v LEFT JOIN quota s ON s.id = v.id AND s.kind = 'singular' LEFT JOIN quota p ON p.id = v.id AND p.kind = 'plural'),
         c AS (SELECT l.id, l.seq, l.pos, CASE WHEN numbered THEN {_SINGULAR} ELSE [] END AS s, CASE WHEN numbered THEN {_FIT.format(names="plurals", field="plural")} ELSE [] END AS p, want_s, want_p
               FROM caption_lines l JOIN w ON w.id = l.id),
         o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq, pos) AS step, pos = min(pos) OVER (PARTITION BY id, seq) AS first, pos = max(pos) OVER (PARTITION BY id, seq) AS final FROM c),
         f AS (SELECT id, 0::BIGINT AS step, []::VARCHAR[] AS hs, []::VARCHAR[] AS hp, 0 AS idle, false AS stopped, true AS live, NULL::VARCHAR AS kind, NULL::INT AS pos, NULL::VARCHAR AS caption, NULL::BIGINT AS seq
               FROM (SELECT DISTINCT id FROM o)
               UNION ALL
               SELECT id, step, CASE WHEN took = 'singular' THEN list_append(hs, pick_s) ELSE hs END, CASE WHEN took = 'plural' THEN list_append(hp, pick_p) ELSE hp END,
                      CASE WHEN took IS NULL THEN idle ELSE 0 END + CASE WHEN final AND live THEN 1 ELSE 0 END,
                      stopped OR (final AND live AND took IS NULL AND idle > 3), live, took, CASE took WHEN 'singular' THEN len(hs) WHEN 'plural' THEN len(hp) END::INT,
                      CASE took WHEN 'singular' THEN pick_s WHEN 'plural' THEN pick_p END, seq
               FROM (SELECT *, CASE WHEN NOT live THEN NULL WHEN pick_s IS NOT NULL AND pick_p IS NOT NULL THEN CASE WHEN want_s - len(hs) <= want_p - len(hp) THEN 'plural' ELSE 'singular' END
                                    WHEN pick_s IS NOT NULL THEN 'singular' WHEN pick_p IS NOT NULL THEN 'plural' END AS took
                     FROM (SELECT o.*, f.hs, f.hp, f.idle, f.stopped, CASE WHEN o.first THEN NOT f.stopped AND (len(f.hs) < want_s OR len(f.hp) < want_p) ELSE f.live END AS live,
                                  list_filter(o.s, lambda t: NOT list_contains(f.hs, t))[1] AS pick_s, list_filter(o.p, lambda t: NOT list_contains(f.hp, t))[1] AS pick_p
                           FROM f JOIN o ON o.id = f.id AND o.step = f.step + 1)))
    SELECT id, kind, pos, caption, seq FROM f WHERE kind IS NOT NULL""")
def _(spark, sf):
    vocab = C.caption_quotas(X.vocab(spark, sf), PER_FREQ)
    return C.collect_captions(X.caption_answers(spark, sf), vocab)


@query("j07_joined_captions", "caption_rows vocab", "SELECT c.id, kind, pos, caption || '.' AS caption, target_noun FROM caption_rows c JOIN vocab v ON v.id = c.id")
def _(spark, sf):
    return C.join_captions(X.caption_rows(spark, sf), X.vocab(spark, sf)).select("id", "kind", "pos", "caption", "target_noun")


@query("j07_captions_without_vocab", "caption_rows vocab", """
    SELECT kind, count(DISTINCT id) AS n_targets, count(*) AS n_captions FROM caption_rows WHERE id NOT IN (SELECT id FROM vocab) GROUP BY kind""")
def _(spark, sf):
    return C.captions_without_vocab(X.caption_rows(spark, sf), X.vocab(spark, sf))


@query("j07_vocab_without_captions", "caption_rows vocab", "SELECT id, target_noun FROM vocab WHERE id NOT IN (SELECT id FROM caption_rows)")
def _(spark, sf):
    return C.vocab_without_captions(X.caption_rows(spark, sf), X.vocab(spark, sf))


_CHOSEN = """
  sums AS (SELECT id, kind, sum(freq) AS f FROM vocab_nouns GROUP BY ALL),
  ranked AS (SELECT c.id, c.kind, c.caption || '.' AS template, s.f, row_number() OVER (PARTITION BY c.id, c.kind ORDER BY md5('7|' || c.id || '|' || c.kind || '|' || c.caption || '.'), c.caption || '.') - 1 AS tidx
             FROM caption_rows c JOIN sums s ON s.id = c.id AND s.kind = c.kind),
  chosen AS (SELECT id, kind, tidx, template FROM ranked WHERE tidx < f * 2),
  nt AS (SELECT id, kind, count(*) AS n FROM chosen GROUP BY ALL),
  units AS (SELECT n.id, n.kind, n.noun, n.target_noun, before * 3 + i AS sample FROM (SELECT *, sum(freq) OVER (PARTITION BY id, kind ORDER BY npos) - freq AS before FROM vocab_nouns) n, unnest(range(freq * 3)) r(i)),
  filled AS (SELECT u.id, u.kind, u.sample, u.sample % nt.n AS tidx, replace(replace(template, '{singular}', noun), '{plural}', noun) AS text, target_noun AS target
             FROM units u JOIN nt USING (id, kind) JOIN chosen c ON c.id = u.id AND c.kind = u.kind AND c.tidx = u.sample % nt.n)"""


def chosen(spark, sf):
    return C.choose_templates(X.caption_rows(spark, sf), X.vocab(spark, sf), TEMPLATES, SAMPLES, X.SEED)


def filled(spark, sf):
    return C.fill_captions(chosen(spark, sf), X.vocab(spark, sf), SAMPLES)


@query("g10_chosen_templates", "caption_rows vocab_nouns", f"WITH {_CHOSEN.strip()} SELECT id, kind, tidx, template FROM chosen")
def _(spark, sf):
    return chosen(spark, sf).drop("target_noun")


@query("g11_filled_captions", "caption_rows vocab_nouns", f"WITH {_CHOSEN.strip()} SELECT id, kind, sample::BIGINT AS sample, tidx::BIGINT AS tidx, text, target FROM filled")
def _(spark, sf):
    return filled(spark, sf).select("id", "kind", "sample", "tidx", "text", "target")


@query("a19_template_reuse", "caption_rows vocab_nouns", f"WITH {_CHOSEN.strip()} SELECT n_uses, count(*) AS n_templates FROM (SELECT count(*) AS n_uses FROM filled GROUP BY id, kind, tidx) GROUP BY n_uses")
def _(spark, sf):
    return C.template_reuse(filled(spark, sf))


@query("a19_sample_reuse", "caption_rows vocab_nouns", f"WITH {_CHOSEN.strip()} SELECT n_uses, count(*) AS n_samples FROM (SELECT count(*) AS n_uses FROM filled GROUP BY text, target) GROUP BY n_uses")
def _(spark, sf):
    return C.sample_reuse(filled(spark, sf))


@query("a20_caption_accounting", "caption_rows vocab vocab_nouns", """
    WITH s AS (SELECT v.id, k.kind, coalesce(sum(n.freq), 0) * 2 AS want FROM vocab v CROSS JOIN (VALUES ('singular'), ('plural')) k(kind) LEFT JOIN vocab_nouns n ON n.id = v.id AND n.kind = k.kind GROUP BY ALL),
         c AS (SELECT id, kind, count(*) AS n FROM caption_rows GROUP BY ALL)
    SELECT kind, sum(n)::BIGINT AS n_total, coalesce(sum(n) FILTER (WHERE want IS NULL), 0)::BIGINT AS n_outside, coalesce(sum(least(n, want)) FILTER (WHERE want IS NOT NULL), 0)::BIGINT AS n_used,
           coalesce(sum(n - least(n, want)) FILTER (WHERE want IS NOT NULL), 0)::BIGINT AS n_unused FROM c LEFT JOIN s USING (id, kind) GROUP BY kind""")
def _(spark, sf):
    return C.caption_accounting(X.caption_rows(spark, sf), X.vocab(spark, sf), TEMPLATES, SAMPLES)


@query("f04_filled_templates", "caption_rows vocab", "SELECT c.id, c.pos, replace(replace(caption, '{singular}', target_noun), '{plural}', target_noun) AS text FROM caption_rows c JOIN vocab v ON v.id = c.id")
def _(spark, sf):
    rows = X.caption_rows(spark, sf).join(X.vocab(spark, sf).select("id", "target_noun"), "id")
    text = T.fill_template(T.fill_template(F.col("caption"), F.col("target_noun"), "{singular}"), F.col("target_noun"), "{plural}")
    return rows.select("id", "pos", text.alias("text"))
