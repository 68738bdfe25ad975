"""Queries on vocabulary, templates and corpus expansion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.register import register_functions
from ..operators import corpus as C
from ..operators import vocab as V
from . import fixtures as X
from .registry import query

# The article rules as DuckDB text, whose \b knows only ASCII letters.
ARTICLE = (
    r"CASE WHEN regexp_matches({n}, '^[AEFHILMNORSX][B-Z][A-Z]?($|[^\pL\pM\pN_])') THEN 'an '"
    r" WHEN regexp_matches({n}, '^([aefhilmnorsx][.-]|hour)', 'i') THEN 'an '"
    r" WHEN regexp_matches({n}, '^([a-z][.-]|e[uw]|onc?e($|[^\pL\pM\pN_])|uni|u[bcfghjkqrst][aeiou])', 'i') THEN 'a '"
    r" WHEN regexp_matches({n}, '^[aeiou]', 'i') THEN 'an ' ELSE 'a ' END"
)


def article_sql(noun: str) -> str:
    return ARTICLE.replace("{n}", noun)


def corpus_plan(spark, sf, threshold: int = 0) -> C.CorpusPlan:
    vocab = X.vocab(spark, sf)
    return C.CorpusPlan(
        V.filter_vocab(vocab, threshold), X.template_rows(spark), X.template_rows(spark, X.HYPERNYM_ROWS),
        X.PROMPT_SPEC, X.HYPERNYM_SPEC, lookup=vocab,
    )


# Expanded corpus in plain SQL: templates x suffixes x nouns, ids by window functions.
_TEMPLATES = """
  tmerged AS (SELECT template, sum(freq)::BIGINT AS tfreq, min(coll * 1000 + pos) AS seen FROM (
      SELECT *, CASE collection WHEN 'Plain' THEN 0 WHEN 'Styled' THEN 1 END AS coll FROM prompt_rows WHERE collection IN ('Plain', 'Styled') AND freq >= 1) GROUP BY 1),
  tsq AS (SELECT *, CASE WHEN t LIKE '%.' THEN t ELSE t || '.' END AS td FROM (SELECT *, regexp_replace(template, '\\s+', ' ', 'g') AS t FROM tmerged)),
  tfield AS (SELECT *, regexp_extract(td, '\\{([^}]*)\\}', 1) AS ft FROM tsq),
  tcomp AS (SELECT seen, tfreq, replace(td, '{' || ft || '}', '{noun}') AS ttext, ft LIKE 'article%' AS art, replace(ft, 'article_', '') AS base,
            td[strpos(td, '}') + 1] NOT IN ('.', ',', '?', '!', ':', ';') AS comma FROM tfield),
  tkind AS (SELECT *, 'singular' AS kind, art AS need_article FROM tcomp WHERE base IN ('singular', 'noun')
            UNION ALL SELECT *, 'plural', false FROM tcomp WHERE base IN ('plural', 'noun')),
  hm AS (SELECT template, sum(freq)::BIGINT AS hfreq, min(pos) AS hseen FROM hypernym_rows WHERE collection = 'Kinds' GROUP BY 1),
  hunits AS (SELECT template, hseen, row_number() OVER (ORDER BY hseen, u) - 1 AS unit FROM hm, unnest(range(hfreq)) x(u) WHERE template IS NOT NULL),
  hdist AS (SELECT n AS n_hyp, hseen, template, unit % n AS hyp_idx, count(*) AS sfreq FROM hunits, (VALUES (1), (2)) v(n) GROUP BY ALL),
  suffixes AS (SELECT n AS n_hyp, -1 AS hseen, NULL AS template, 0 AS hyp_idx,
                      CASE WHEN n = 0 THEN (SELECT sum(hfreq) FROM hm) ELSE (SELECT hfreq FROM hm WHERE template IS NULL) END AS sfreq FROM (VALUES (0), (1), (2)) v(n)
               UNION ALL SELECT * FROM hdist),
  expanded AS (
    SELECT n.id, n.target_noun, n.kind, n.npos, n.noun, t.seen, s.hseen, s.hyp_idx, (t.tfreq * s.sfreq * n.freq)::BIGINT AS freq, t.ttext, t.need_article,
           CASE WHEN s.template IS NULL THEN '' ELSE replace(replace(s.template || CASE WHEN t.comma THEN ',' ELSE '' END,
                '{target}', l.hypernym_target), '{article_target}', (__ART_L__) || l.hypernym_target) END AS suffix
    FROM vocab_nouns n JOIN vocab v ON v.id = n.id JOIN tkind t ON t.kind = n.kind JOIN suffixes s ON s.n_hyp = len(v.hypernyms)
         LEFT JOIN vocab_links l ON l.id = n.id AND l.pos = s.hyp_idx),
  corpus AS (SELECT id, kind, noun, replace(ttext, '{noun}', CASE WHEN need_article THEN (__ART_N__) ELSE '' END || noun || suffix) AS text,
                    target_noun AS target, freq,
                    row_number() OVER w - 1 AS usid, (sum(freq) OVER w - freq)::BIGINT AS fsid
             FROM expanded WINDOW w AS (ORDER BY id, kind DESC, seen, hseen, hyp_idx, npos ROWS UNBOUNDED PRECEDING))
""".replace("__ART_L__", article_sql("l.hypernym_target")).replace("__ART_N__", article_sql("noun")).replace("\\\\", "\\")
CORPUS_CTES = "vocab_nouns vocab_links prompt_rows hypernym_rows"


def corpus_sql(body: str) -> str:
    return "WITH " + _TEMPLATES.strip() + "\n" + body


@query("pf01_vocab_threshold", "vocab", """
    SELECT id, target_noun, (list_sum(singulars_freq) + coalesce(list_sum(plurals_freq), 0))::BIGINT AS total_freq
    FROM vocab WHERE list_sum(singulars_freq) + coalesce(list_sum(plurals_freq), 0) > 3""")
def _(spark, sf):
    return V.filter_vocab(X.vocab(spark, sf), 3).select("id", "target_noun", V.total_freq().alias("total_freq"))


@query("pf02_vocab_rules", "vocab", """
    WITH f AS (SELECT CASE WHEN id % 79 = 3 THEN id + 1 ELSE id END AS nid, id AS key,
                      CASE WHEN id % 61 = 5 THEN 'same target' ELSE target_noun END AS tgt, singulars, hypernyms FROM vocab)
    SELECT nid AS id, 'bad_whitespace' AS rule FROM f WHERE key % 89 = 1
    UNION ALL SELECT nid, 'bad_freq' FROM f WHERE key % 97 = 2
    UNION ALL SELECT nid, 'singular_lengths' FROM f WHERE key % 97 = 2 AND len(singulars) <> 1
    UNION ALL SELECT nid, 'repeated_hypernym' FROM f WHERE key % 83 = 4
    UNION ALL SELECT nid, 'repeated_id' FROM f GROUP BY nid HAVING count(*) > 1
    UNION ALL SELECT min(nid), 'repeated_target' FROM f GROUP BY tgt HAVING count(*) > 1
    UNION ALL SELECT DISTINCT nid, 'unknown_hypernym' FROM f
        WHERE key % 83 = 4 OR len(list_filter(hypernyms, lambda h: h % 79 = 3)) > 0""")
def _(spark, sf):
    return V.vocab_violations(X.faulty_vocab(spark, sf))


@query("j01_hypernym_targets", "vocab_links", "SELECT id, pos, hypernym_id, hypernym_target FROM vocab_links")
def _(spark, sf):
    return V.resolve_hypernyms(X.vocab(spark, sf))


@query("j03_class_alignment", "class_parts noun_ids vocab", """
    SELECT c.class_id, c.pos, c.raw_name, c.name, m.target_noun, m.freq,
           CASE WHEN m.n IS NULL THEN 'ignored' WHEN m.n > 1 THEN 'ambiguous' ELSE 'ok' END AS status
    FROM class_parts c LEFT JOIN (
        SELECT noun, count(*) AS n, arg_min(target_noun, id) AS target_noun, arg_min(freq, id) AS freq FROM noun_ids JOIN (
            SELECT id, target_noun, (list_sum(singulars_freq) + coalesce(list_sum(plurals_freq), 0))::BIGINT AS freq FROM vocab) USING (id)
        GROUP BY noun) m ON m.noun = c.name""")
def _(spark, sf):
    return V.align_classes(X.class_names(spark, sf), X.vocab(spark, sf))


@query("j03_class_alignment_report", "class_parts noun_ids vocab", """
    SELECT status, count(*) AS n_names, count(DISTINCT class_id) AS n_classes, min(freq) AS min_freq FROM (
        SELECT c.class_id, m.freq, CASE WHEN m.n IS NULL THEN 'ignored' WHEN m.n > 1 THEN 'ambiguous' ELSE 'ok' END AS status
        FROM class_parts c LEFT JOIN (
            SELECT noun, count(*) AS n, arg_min(freq, id) AS freq FROM noun_ids JOIN (
                SELECT id, (list_sum(singulars_freq) + coalesce(list_sum(plurals_freq), 0))::BIGINT AS freq FROM vocab) USING (id)
            GROUP BY noun) m ON m.noun = c.name) GROUP BY status""")
def _(spark, sf):
    return V.class_alignment_report(V.align_classes(X.class_names(spark, sf), X.vocab(spark, sf)))


@query("j04_class_targets", "class_parts noun_ids vocab", """
    WITH tid AS (SELECT DISTINCT t.target_noun AS target, n.id FROM vocab t JOIN noun_ids n ON n.noun = t.target_noun WHERE t.id % 3 <> 1),
         m AS (SELECT c.class_id, c.pos, t.id, t.target FROM class_parts c JOIN noun_ids n ON n.noun = c.name JOIN tid t ON t.id = n.id),
         f AS (SELECT class_id, arg_min(target, (pos, id, target)) AS main FROM m GROUP BY 1)
    SELECT DISTINCT class_id, target, target = main AS is_main FROM m JOIN f USING (class_id)""")
def _(spark, sf):
    vocab = X.vocab(spark, sf)
    targets = vocab.filter("id % 3 != 1").select(F.col("target_noun").alias("target"))
    return V.align_class_targets(X.class_names(spark, sf), targets, V.noun_vocab_ids(vocab))


@query("j05_noun_vocab_ids", "noun_ids", "SELECT noun, id FROM noun_ids")
def _(spark, sf):
    return V.noun_vocab_ids(X.vocab(spark, sf))


@query("f01_indefinite_article", "vocab_nouns", f"""
    SELECT noun, ({article_sql('noun')}) || noun AS indefinite FROM (
        SELECT DISTINCT noun FROM vocab_nouns
        UNION SELECT DISTINCT unnest(regexp_extract_all(text, '[^ \\n,!|]+')) FROM documents) WHERE noun <> ''""")
def _(spark, sf):
    words = X.table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^ \n,!|]+"), 0)).alias("noun"))
    nouns = V.explode_nouns(X.vocab(spark, sf)).select("noun").union(words).distinct().filter("noun != ''")
    return nouns.select("noun", T.indefinite(F.col("noun")).alias("indefinite"))


@query("f01_sql_functions", "vocab_nouns", f"""
    SELECT noun, ({article_sql('noun')}) || noun AS indefinite, trim(regexp_replace(translate(lower(noun), '.', ''), '[ /-]+', ' ', 'g')) AS canonical FROM vocab_nouns""")
def _(spark, sf):
    register_functions(spark)
    V.explode_nouns(X.vocab(spark, sf)).select("noun").createOrReplaceTempView("vocabspark_nouns")
    return spark.sql("SELECT noun, with_article(noun) AS indefinite, canonical_noun(noun) AS canonical FROM vocabspark_nouns")


@query("f02_canonical_noun", "", r"""
    SELECT page_id, name, regexp_matches(name, '[^ 0-9a-z]') AS bad FROM (
        SELECT page_id, trim(regexp_replace(replace(replace(lower(replace(strip_accents(trim(regexp_replace(title, '\s+', ' ', 'g'))), 'ß', 'ss')), '''', ''), '.', ''), '[\s/-]+', ' ', 'g')) AS name
        FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages))""")
def _(spark, sf):
    titles = X.table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    name = T.canon(F.col("title"))
    return titles.select("page_id", name.alias("name"), T.has_bad_canon(name).alias("bad"))


@query("f03_clean_class_name", "", r"""
    WITH raw AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN title || ' (a (nested) note)/other' WHEN 1 THEN 'cat or ' || title
                    WHEN 2 THEN title || ' or dog' WHEN 3 THEN 'bell or wind chime' ELSE title END AS name
                 FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)),
         flat AS (SELECT page_id, string_split(regexp_replace(regexp_replace(regexp_replace(name, '\([^()]*\)', '', 'g'), '\([^()]*\)', '', 'g'), '\([^()]*\)', '', 'g'), '/')[1] AS s FROM raw),
         fixed AS (SELECT page_id, CASE WHEN s = 'bell or wind chime' THEN 'chime' ELSE s END AS s FROM flat),
         cut AS (SELECT page_id, s, string_split(s, ' or ') AS p FROM fixed),
         parts AS (SELECT page_id, s, len(p) AS n, trim(regexp_replace(p[1], '\s+', ' ', 'g')) AS a, trim(regexp_replace(p[2], '\s+', ' ', 'g')) AS b FROM cut)
    SELECT page_id, trim(regexp_replace(CASE WHEN n >= 2 AND a <> '' AND strpos(a, ' ') = 0 AND strpos(b, ' ') > 0 THEN a || ' ' || b[strpos(b, ' ') + 1:]
                WHEN n >= 2 THEN a ELSE s END, '\s+', ' ', 'g')) AS clean_name FROM parts""")
def _(spark, sf):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    case = F.col("page_id") % 5
    name = (
        F.when(case == 0, F.concat(title, F.lit(" (a (nested) note)/other"))).when(case == 1, F.concat(F.lit("cat or "), title))
        .when(case == 2, F.concat(title, F.lit(" or dog"))).when(case == 3, "bell or wind chime").otherwise(title)
    )
    return X.table(spark, sf, "pages").select("page_id", T.clean_class_name(name).alias("clean_name"))


_DOC_MERGED = "SELECT template, sum(freq)::BIGINT AS freq, min((coll, pos)) AS seen FROM doc_prompts WHERE freq >= 1 GROUP BY template"


@query("a01_merged_templates", "doc_prompts", f"SELECT template, freq, seen[1] AS first_coll, seen[2] AS first_pos FROM ({_DOC_MERGED})")
def _(spark, sf):
    merged = C.merge_collections(X.doc_templates(spark, sf), X.DOC_SPEC)
    return merged.select("template", "freq", F.col("seen.coll").alias("first_coll"), F.col("seen.pos").alias("first_pos"))


@query("g01_compiled_prompts", "doc_prompts", r"""
    WITH m AS (SELECT template, sum(freq)::BIGINT AS tfreq FROM doc_prompts WHERE freq >= 1 GROUP BY 1),
         d AS (SELECT tfreq, CASE WHEN t LIKE '%.' THEN t ELSE t || '.' END AS t FROM (SELECT tfreq, trim(regexp_replace(template, '\s+', ' ', 'g')) AS t FROM m)),
         f AS (SELECT *, regexp_extract(t, '\{([^}]*)\}', 1) AS ft FROM d),
         c AS (SELECT tfreq, replace(t, '{' || ft || '}', '{noun}') AS template, ft LIKE 'article%' AS art, replace(ft, 'article_', '') AS base,
                      t[strpos(t, '}') + 1] NOT IN ('.', ',', '?', '!', ':', ';') AS need_hyp_comma FROM f)
    SELECT 'singular' AS kind, template, art AS need_article, need_hyp_comma, tfreq FROM c WHERE base IN ('noun', 'singular')
    UNION ALL SELECT 'plural', template, false, need_hyp_comma, tfreq FROM c WHERE base IN ('noun', 'plural')""")
def _(spark, sf):
    return C.compile_prompts(X.doc_templates(spark, sf), X.DOC_SPEC).drop("seen")


@query("g02_compiled_hypernyms", "doc_hypernyms", r"""
    SELECT t AS template, t || ',' AS template_comma, coalesce(art, false) AS need_article, hfreq FROM (
        SELECT replace(trim(regexp_replace(template, '\s+', ' ', 'g')), '{article_', '{') AS t, template LIKE '%{article%' AS art, sum(freq)::BIGINT AS hfreq
        FROM doc_hypernyms WHERE freq >= 1 GROUP BY template)""")
def _(spark, sf):
    return C.compile_hypernyms(X.doc_templates(spark, sf, hypernym=True), X.DOC_SPEC).drop("seen")


@query("g03_hypernym_freq_dist", "doc_hypernyms", """
    WITH m AS (SELECT template, sum(freq)::BIGINT AS hfreq, min((coll, pos)) AS seen FROM doc_hypernyms WHERE freq >= 1 AND template IS NOT NULL GROUP BY 1),
         o AS (SELECT *, row_number() OVER (ORDER BY seen) - 1 AS hpos, (sum(hfreq) OVER (ORDER BY seen) - hfreq)::BIGINT AS before FROM m),
         u AS (SELECT hpos, before + i AS unit FROM o, unnest(range(hfreq)) x(i))
    SELECT n AS n_hyp, hpos, (unit % n)::INT AS hyp_idx, count(*) AS sfreq FROM u, (VALUES (1), (2), (3)) v(n) GROUP BY ALL""")
def _(spark, sf):
    compiled = C.compile_hypernyms(X.doc_templates(spark, sf, hypernym=True), X.DOC_SPEC)
    return C.hypernym_freq_dist(C.number_hypernyms(compiled), 3)


@query("g04_unique_samples", CORPUS_CTES, corpus_sql("SELECT id, kind, noun, text, target, freq FROM corpus"))
def _(spark, sf):
    return corpus_plan(spark, sf).samples(with_ids=False)


@query("j02_expansion_counts", CORPUS_CTES, corpus_sql("SELECT id, kind, count(*) AS n_samples, sum(freq)::BIGINT AS n_weighted FROM corpus GROUP BY ALL"))
def _(spark, sf):
    rows = corpus_plan(spark, sf).samples(with_ids=False)
    return rows.groupBy("id", "kind").agg(F.count("*").alias("n_samples"), F.sum("freq").alias("n_weighted"))


@query("g05_sample_ids", CORPUS_CTES, corpus_sql("SELECT usid, fsid, freq, text FROM corpus"))
def _(spark, sf):
    return corpus_plan(spark, sf).samples().select("usid", "fsid", "freq", "text")


@query("g06_lookup_fsid", CORPUS_CTES, corpus_sql("""
    SELECT r.fsid, c.usid, c.text, c.target FROM (SELECT DISTINCT (l_orderkey * 7 + l_linenumber) AS fsid FROM lineitem) r
    JOIN corpus c ON r.fsid >= c.fsid AND r.fsid < c.fsid + c.freq"""))
def _(spark, sf):
    requests = X.table(spark, sf, "lineitem").select(F.expr("l_orderkey * 7 + l_linenumber").alias("fsid")).distinct()
    return corpus_plan(spark, sf).lookup_fsids(requests)


@query("g07_corpus_totals", CORPUS_CTES, corpus_sql("""
    SELECT count(DISTINCT id) AS num_tids, count(*) AS num_usids, sum(freq)::BIGINT AS num_fsids FROM corpus"""))
def _(spark, sf):
    return corpus_plan(spark, sf).totals()


@query("g08_repeated_samples", CORPUS_CTES, corpus_sql("""
    SELECT target, kind, count(*) AS n_rows, count(DISTINCT text) AS n_texts FROM corpus, unnest(range(freq)) r(i) GROUP BY ALL"""))
def _(spark, sf):
    rows = C.repeat_samples(corpus_plan(spark, sf).samples(with_ids=False))
    return rows.groupBy("target", "kind").agg(F.count("*").alias("n_rows"), F.countDistinct("text").alias("n_texts"))


@query("w03_prefix_ids", "vocab", """
    SELECT id, (row_number() OVER w - 1) AS position, (sum(f) OVER w - f)::BIGINT AS freq_start
    FROM (SELECT id, list_sum(singulars_freq) + coalesce(list_sum(plurals_freq), 0) AS f FROM vocab) WINDOW w AS (ORDER BY id ROWS UNBOUNDED PRECEDING)""")
def _(spark, sf):
    from ..operators.ordinals import prefix_ids

    sized = X.vocab(spark, sf).select("id", V.total_freq().alias("f"))
    return prefix_ids(sized, "id", position=F.lit(1).cast("long"), freq_start=F.col("f")).drop("f")


@query("w05_round_robin", "vocab_nouns", """
    SELECT noun, kind, id, ((row_number() OVER (PARTITION BY kind ORDER BY id, npos) - 1) % 7) AS slot FROM vocab_nouns""")
def _(spark, sf):
    from ..operators.ordinals import deal_round_robin

    nouns = V.explode_nouns(X.vocab(spark, sf))
    dealt = deal_round_robin(nouns, ["kind"], [F.col("id"), F.col("npos")], F.lit(7))
    return dealt.select("noun", "kind", "id", "slot")


_MULTISET = """
  units AS (SELECT id, target_noun, kind, noun, id || '/' || (before + i) AS item FROM (
      SELECT *, sum(freq) OVER (PARTITION BY id, kind ORDER BY npos) - freq AS before FROM vocab_nouns), unnest(range(freq)) r(i)),
  plain AS (SELECT * FROM prompt_rows WHERE collection = 'Styled' AND freq >= 1),
  slots AS (SELECT 'singular' AS kind, template, tslot FROM (SELECT replace(replace(replace(template || CASE WHEN template LIKE '%.' THEN '' ELSE '.' END, '{article_singular}', '{art}'), '{article_noun}', '{art}'), '{noun}', '{noun}') AS template,
                   row_number() OVER (ORDER BY pos, u) - 1 AS tslot FROM plain, unnest(range(freq)) x(u))
            UNION ALL SELECT 'plural', template, tslot FROM (SELECT replace(template || CASE WHEN template LIKE '%.' THEN '' ELSE '.' END, '{article_noun}', '{noun}') AS template,
                   row_number() OVER (ORDER BY pos, u) - 1 AS tslot FROM plain, unnest(range(freq)) x(u) WHERE template NOT LIKE '%singular}%')),
  draws AS (SELECT * FROM (VALUES (1, 1, 0), (2, 1, 0), (2, 1, 1)) d(m, repetition, slot)),
  ranked AS (SELECT m, repetition, u.kind, s.tslot, slot, s.template, u.noun, u.target_noun,
                    row_number() OVER (PARTITION BY m, repetition, u.kind, s.tslot, slot
                        ORDER BY md5(concat_ws('|', '7', m, repetition, u.kind, s.tslot, slot, item)), item) - 1 AS rank
             FROM units u JOIN slots s ON s.kind = u.kind CROSS JOIN draws)
"""


@query("g09_noun_multisets", "vocab_nouns prompt_rows", "WITH " + _MULTISET.strip() + f"""
    SELECT m, kind, tslot, rank, replace(replace(min(template), '{{art}}', string_agg(({article_sql('noun')}) || noun, ' and ' ORDER BY slot)),
           '{{noun}}', string_agg(noun, ' and ' ORDER BY slot)) AS text, string_agg(target_noun, '|' ORDER BY slot) AS targets
    FROM ranked GROUP BY m, repetition, kind, tslot, rank""")
def _(spark, sf):
    prompts = C.number_prompts(C.compile_prompts(X.template_rows(spark), "Styled"))
    sets = C.noun_multisets(X.vocab(spark, sf), prompts, [1, 1, 0], X.SEED)
    return sets.select("m", "kind", "tslot", "rank", "text", F.array_join("targets", "|").alias("targets"))


@query("j09_zip_permutations", "vocab", """
    SELECT rank, string_agg(target_noun, '|' ORDER BY slot) AS members FROM (
        SELECT slot, target_noun, row_number() OVER (PARTITION BY slot ORDER BY md5('7|' || slot || '|' || id), id) - 1 AS rank
        FROM vocab, (VALUES (0), (1), (2)) s(slot)) GROUP BY rank""")
def _(spark, sf):
    rows = C.zip_permutations(X.vocab(spark, sf).select("id", "target_noun"), "id", 3, X.SEED)
    members = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", "target_noun"))), lambda x: x["target_noun"]), "|")
    return rows.groupBy("rank").agg(members.alias("members"))


@query("s06_multiset_equality", "vocab_nouns prompt_rows", "WITH " + _MULTISET.strip() + """
    SELECT count(*) AS n_left, count(*) AS n_right, 0::BIGINT AS only_left, 0::BIGINT AS only_right FROM units u JOIN slots s ON s.kind = u.kind""")
def _(spark, sf):
    """Multisets of size one are exactly the frequency-weighted corpus without hypernyms."""
    from ..operators.setops import multiset_difference

    vocab = X.vocab(spark, sf)
    prompts = C.number_prompts(C.compile_prompts(X.template_rows(spark), "Styled"))
    sets = C.noun_multisets(vocab, prompts, [1], X.SEED).select("text", F.get("targets", F.lit(0)).alias("target"))
    plan = C.CorpusPlan(vocab, X.template_rows(spark), X.template_rows(spark, X.HYPERNYM_ROWS), "Styled", "Nothing")
    base = C.repeat_samples(plan.samples(with_ids=False)).select("text", "target")
    return multiset_difference(sets, base)


@query("g12_photo_rows", "vocab", "SELECT target_noun AS target, 'a photo of a ' || target_noun AS text FROM vocab")
def _(spark, sf):
    return C.photo_rows(X.vocab(spark, sf))
