"""Inputs of the registered queries, derived from the given tables.

Every fixture exists twice: as a DataFrame (functions taking spark and the table folder) and as a
DuckDB CTE of the same name. Both are written by hand, so the comparison is between two independent
derivations. Sizes follow the tables: one vocabulary row per part, one prediction candidate per
lineitem, one opinion per event, one run per order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SEED = 7

# Prompt and hypernym templates in the shape of the prompt file: collection, position, frequency, template.
PROMPT_ROWS = (
    ("Plain", 0, 1, "a photo of {article_noun}"),
    ("Plain", 1, 2, "a photo of many {plural}"),
    ("Plain", 2, 1, "the  small {noun} on a table"),
    ("Plain", 3, 0, "never used {noun}"),
    ("Plain", 4, 1, "{article_noun}, close up"),
    ("Styled", 0, 1, "a sketch of {article_singular}"),
    ("Styled", 1, 3, "a photo of {article_noun}"),
    ("Styled", 2, 1, "art of the {noun}."),
)
HYPERNYM_ROWS = (
    ("Nothing", 0, 1, None),
    ("Kinds", 0, 2, None),
    ("Kinds", 1, 3, ", a type of {target}"),
    ("Kinds", 2, 2, ", an example of {article_target}"),
)
PROMPT_SPEC = "Plain | Styled"
HYPERNYM_SPEC = "Kinds"

OPINIONS_MIN, OPINIONS_MAX, CONFIDENCE = 2, 5, 0.78
MIN_NOUNS = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql_text(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(_sql_text(v) for v in row) + ")" for row in rows)


def template_rows(spark: SparkSession, rows=PROMPT_ROWS) -> DataFrame:
    """Inline templates as a local relation, so the planner knows how small they are."""
    return spark.sql(f"SELECT * FROM VALUES {_values(rows)} AS t(collection, pos, freq, template)")


# --- vocabulary -------------------------------------------------------------------------------


def part_noun(name: str = "p_name", key: str = "p_partkey") -> Column:
    return F.concat_ws(" ", F.col(name), F.col(key).cast("string"))


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and names of the parts, merged with what they are joined to.

    They grow with the tables, and their file is many times smaller than the rows that a broadcast would send to the driver.
    """
    return table(spark, sf_dir, "part").select("p_partkey", "p_name").hint("merge")


def vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vocabulary row per part; hypernyms are the parts at key/10 and key/100."""
    part = table(spark, sf_dir, "part")
    noun = part_noun()
    key, size = F.col("p_partkey"), F.col("p_size")
    one, two = F.expr("p_partkey div 10"), F.expr("p_partkey div 100")
    links = F.when(size % 3 == 0, F.array().cast("array<bigint>")).when(size % 3 == 1, F.array(one)).otherwise(F.array(one, two))
    return part.select(
        key.cast("long").alias("id"),
        noun.alias("target_noun"),
        noun.alias("pretty_noun"),
        F.when(size % 4 == 0, F.array(noun, F.concat_ws(" ", F.lower("p_type"), noun))).otherwise(F.array(noun)).alias("singulars"),
        F.when(size % 4 == 0, F.array((1 + size % 3), F.lit(1))).otherwise(F.array(1 + size % 3)).cast("array<int>").alias("singulars_freq"),
        F.when(size % 2 == 0, F.array(F.concat(noun, F.lit("s")))).otherwise(F.array().cast("array<string>")).alias("plurals"),
        F.when(size % 2 == 0, F.array(1 + size % 5)).otherwise(F.array().cast("array<int>")).cast("array<int>").alias("plurals_freq"),
        F.filter(F.array_distinct(links), lambda h: h != key).alias("hypernyms"),
    )


def faulty_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary with faults planted by key, one kind of fault per divisor."""
    base = vocab(spark, sf_dir)
    key = F.col("id")
    return base.select(
        F.when(key % 79 == 3, key + 1).otherwise(key).alias("id"),
        F.when(key % 61 == 5, F.lit("same target")).otherwise(F.col("target_noun")).alias("target_noun"),
        F.when(key % 89 == 1, F.concat(F.lit(" "), F.col("pretty_noun"))).otherwise(F.col("pretty_noun")).alias("pretty_noun"),
        "singulars",
        F.when(key % 97 == 2, F.array(F.lit(0))).otherwise(F.col("singulars_freq")).alias("singulars_freq"),
        "plurals", "plurals_freq",
        F.when(key % 83 == 4, F.array(F.lit(-5).cast("long"), F.lit(-5).cast("long"))).otherwise(F.col("hypernyms")).alias("hypernyms"),
    )


def class_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One class per order: a plural, a re-cased singular and, for some, an unknown name."""
    orders, part = table(spark, sf_dir, "orders"), part_names(spark, sf_dir)
    named = orders.join(part, F.col("o_custkey") == F.col("p_partkey")).select("o_orderkey", "o_orderstatus", part_noun().alias("noun"))
    name = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Zoo-Thing, "), F.upper(F.substring("noun", 1, 1)), F.expr("substring(noun, 2)"), F.lit("s ,"), F.col("noun"))).when(
        F.col("o_orderstatus") == "O", F.concat(F.upper(F.replace(F.col("noun"), F.lit(" "), F.lit("-"))), F.lit(", café thing"))
    ).otherwise(F.concat(F.lit("unknown "), F.col("noun")))
    return named.select(F.col("o_orderkey").alias("class_id"), name.alias("names"))


# --- predictions and annotations --------------------------------------------------------------


def _candidate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part = table(spark, sf_dir, "lineitem"), part_names(spark, sf_dir)
    rows = line.select("l_orderkey", "l_partkey", "l_suppkey", "l_linestatus", "l_extendedprice")
    keyed = rows.groupBy(
        F.expr("l_suppkey % 4").cast("int").alias("m"), (F.col("l_linestatus") == "F").alias("short"),
        F.expr("l_orderkey div 10").alias("sample_id"), F.col("l_partkey").alias("noun_id"),
    ).agg(F.max("l_extendedprice").alias("price"))
    named = keyed.join(part, F.col("noun_id") == F.col("p_partkey"))
    return named.select("m", "short", "sample_id", "noun_id", part_noun("p_name", "noun_id").alias("pred"), (F.col("price") / 100000).alias("score"))


def _candidate_names(rows: DataFrame, *extra: str) -> DataFrame:
    return rows.select(
        F.concat(F.lit("preds_m"), F.col("m"), F.lit(".json")).alias("file"),
        F.concat(F.lit("model_"), F.col("m")).alias("model"),
        F.when(F.col("short"), "beam_k3_vnone_gn_t1_a0").otherwise("beam_k5_vnone_gp_t1_a0").alias("gencfg"),
        F.when(F.col("short"), 3).otherwise(5).alias("gen_topk"),
        F.concat(F.lit("img_"), F.col("sample_id")).alias("sample"),
        "sample_id", "noun_id", "pred", "score", *extra,
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored candidate nouns per (file, decoding, sample), from lineitem."""
    return _candidate_names(_candidate_rows(spark, sf_dir))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked predictions: the best 3 or 5 candidates by decoding, k from 1."""
    order = W.partitionBy("m", "short", "sample_id").orderBy(F.desc("score"), "pred")
    ranked = _candidate_rows(spark, sf_dir).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= 5)
    return _candidate_names(ranked.filter((F.col("k") <= 3) | ~F.col("short")), "k")


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category per (sample, noun); some nouns have two, some none, some samples are left out."""
    line, part = table(spark, sf_dir, "lineitem"), part_names(spark, sf_dir)
    pairs = line.select(F.expr("l_orderkey div 10").alias("s"), "l_partkey").filter("s % 17 != 0").distinct()
    code = F.expr("(s * 7 + l_partkey) % 11")
    first = (
        F.when(code <= 1, "correct_primary").when(code == 2, "correct_secondary").when(code == 3, "close_primary")
        .when(code == 4, "close_secondary").when(code <= 7, "incorrect")
    )
    second = F.when(F.col("l_partkey") % 13 == 0, "close_primary")
    rows = pairs.select("s", "l_partkey", F.explode(F.array_distinct(F.array_compact(F.array(first, second)))).alias("category"))
    named = rows.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return named.select(
        F.concat(F.lit("img_"), F.col("s")).alias("sample"), "category", part_noun("p_name", "l_partkey").alias("noun")
    )


def specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(part_noun().alias("noun"), ((F.col("p_size") % 10 + 1) / F.lit(10.0)).alias("specificity"))


# --- captions ---------------------------------------------------------------------------------


def caption_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions (doc_id, id, kind, pos, caption) from all sentences of all documents.

    The ids run over the vocabulary's keys and a quarter more, so some captions are of no vocabulary row.
    """
    sentences = table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), r"\.")).alias("pos", "sentence")
    ).withColumn("sentence", F.trim("sentence"))
    keys = table(spark, sf_dir, "part").agg(F.max("p_partkey").cast("long").alias("n")).select(F.expr("n + n div 4")).scalar()
    kind = F.when(F.col("pos") % 3 == 2, "plural").otherwise("singular")
    return sentences.filter("sentence != ''").select(
        "doc_id", (F.pmod(F.col("doc_id") * 3, keys) + 1).alias("id"), kind.alias("kind"), "pos",
        F.concat("sentence", F.lit(" near the {"), kind, F.lit("}")).alias("caption"),
    )


def faulty_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions with planted faults: missing or wrong placeholder, end punctuation, non-ASCII."""
    rows = caption_rows(spark, sf_dir)
    code = F.expr("(id + pos) % 23")
    caption = (
        F.when(code == 1, F.replace("caption", F.lit("{"), F.lit("")))
        .when(code == 2, F.concat("caption", F.lit(" {other}")))
        .when(code == 3, F.concat("caption", F.lit(",")))
        .when(code == 4, F.concat("caption", F.lit(" café")))
        .when(code == 5, F.concat(F.lit("repeated {"), F.col("kind"), F.lit("}")))
        .otherwise(F.col("caption"))
    )
    return rows.select("doc_id", "id", "kind", "pos", caption.alias("caption"))


def caption_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One enumerated caption answer per document, eight to a noun; some lines are not numbered."""
    rows = caption_rows(spark, sf_dir).select("doc_id", "pos", F.regexp_extract("caption", r"^(.*) near the \{", 1).alias("sentence"))
    part = part_names(spark, sf_dir).select((F.col("p_partkey")).alias("id"), part_noun().alias("noun"))
    named = rows.withColumn("id", F.expr("doc_id div 8 + 1")).join(part, "id")
    noun = F.when(F.col("pos") % 3 == 2, F.concat("noun", F.lit("s"))).otherwise(F.upper("noun"))
    head = F.when(F.col("pos") % 5 == 4, F.lit("- ")).otherwise(F.concat((F.col("pos") + 1).cast("string"), F.lit(". ")))
    line = F.concat(head, F.col("sentence"), F.lit(" with "), noun, F.when(F.col("pos") % 2 == 0, F.lit(", shown.")).otherwise(F.lit(".")))
    lists = named.groupBy("id", F.col("doc_id").alias("seq")).agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("rows"))
    return lists.select("id", "seq", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("content"))


def doc_templates(spark: SparkSession, sf_dir: str, hypernym: bool = False) -> DataFrame:
    """Template rows per document source: each sentence with one field; repeated sentences merge."""
    rows = caption_rows(spark, sf_dir)
    sources = table(spark, sf_dir, "documents").select("doc_id", "source")
    names = ("target", "article_target") if hypernym else ("article_noun", "noun", "singular", "article_singular", "plural")
    field = F.get(F.array(*[F.lit(n) for n in names]), (F.col("pos") % len(names)).cast("int"))
    sentence = F.regexp_extract("caption", r"^(.*) near the \{", 1)
    tail = F.get(F.array(F.lit(""), F.lit(" shown"), F.lit(", indeed")), (F.col("pos") % 3).cast("int"))
    text = F.concat(sentence, F.lit(" {"), field, F.lit("}"), tail)
    if hypernym:
        text = F.when(F.expr("(doc_id + pos) % 19 = 0"), F.lit(None)).otherwise(text)
    return rows.join(sources, "doc_id").select(
        F.col("source").alias("collection"), (F.col("doc_id") * 10000 + F.col("pos")).alias("pos"),
        F.expr("cast((doc_id + pos) % 4 as int)").alias("freq"), text.alias("template"),
    )


DOC_SPEC = " | ".join(f"src{i}" for i in range(20))


# --- opinions ---------------------------------------------------------------------------------


def opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opinions in arrival order: image, noun, ts, event_id, opinion."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("img_"), F.col("user_id")).alias("image"),
        F.concat_ws(" ", "event_type", (F.col("event_id") % 4).cast("string")).alias("noun"),
        "ts", "event_id",
        (F.col("value") > 20).alias("opinion"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer text per four events, with planted faults by request id."""
    events = table(spark, sf_dir, "events")
    rid, n = F.expr("event_id div 4").alias("request_id"), F.expr("event_id % 4 + 1")
    noun = F.concat_ws(" ", "event_type", (F.col("event_id") % 4).cast("string"))
    word = F.when(F.col("value") > 20, "Correct").otherwise("incorrect")
    mark = F.when(F.expr("(event_id div 4) % 3 = 0"), ")").otherwise(".")
    number = F.when(F.expr("(event_id div 4) % 29 = 1"), n + 1).otherwise(n)
    said = F.when(F.expr("(event_id div 4) % 31 = 2"), F.lit("other thing")).otherwise(F.initcap(noun))
    line = F.concat(number.cast("string"), mark, F.lit("  **"), said, F.lit("**: "), word)
    grouped = events.select(rid, n.alias("n"), noun.alias("noun"), line.alias("line"), "event_id", "user_id", "ts").groupBy(
        "request_id"
    ).agg(
        F.array_sort(F.collect_list(F.struct("n", "noun", "line"))).alias("rows"),
        F.min("user_id").alias("user_id"), F.min("ts").alias("ts"),
    )
    code = F.col("request_id")
    body = F.array_join(F.transform("rows", lambda r: r["line"]), "\n")
    body = F.when(code % 37 == 3, F.concat(body, F.lit("\n9. extra line"))).otherwise(body)
    body = F.when(code % 5 == 4, F.concat(F.lit("1) a list of things\n"), body)).otherwise(body)
    content = F.concat(F.lit("The  scene of "), code.cast("string"), F.lit(".\n"), body)
    return grouped.select(
        "request_id", F.concat(F.lit("img_"), F.col("user_id")).alias("image"), "ts",
        F.transform("rows", lambda r: r["noun"]).alias("nouns"),
        F.when(code % 41 == 7, "length").otherwise("stop").alias("finish_reason"),
        F.when(code % 43 == 8, "").otherwise(content).alias("content"),
        F.length(content).cast("long").alias("prompt_tokens"),
        (F.col("request_id") % 50 + 10).cast("long").alias("completion_tokens"),
    )


# --- vectors ----------------------------------------------------------------------------------


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def multi_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding rows with up to three target ids (0 = none) and descending weights."""
    rows = table(spark, sf_dir, "embeddings")
    first = F.col("label") + 1
    second = ((F.col("label") + F.col("vec_id")) % 10 + 1).cast("int")
    third = ((F.col("label") * 3 + F.col("vec_id") + 1) % 10 + 1).cast("int")
    n = (F.col("vec_id") % 3 + 1).cast("int")
    ids = F.array(first, F.when(n >= 2, second).otherwise(0), F.when(n >= 3, third).otherwise(0)).cast("array<int>")
    weights = F.when(n == 1, F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))).when(
        n == 2, F.array(F.lit(0.75), F.lit(0.25), F.lit(0.0))
    ).otherwise(F.array(F.lit(0.5), F.lit(0.25), F.lit(0.25)))
    return rows.select(F.col("vec_id").alias("row_id"), "embedding", ids.alias("target_ids"), weights.alias("target_weights"))


def target_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target dictionary from the vocabulary: token ids are the character codes of the noun."""
    return vocab(spark, sf_dir).select(
        F.col("id").alias("target_id"), F.col("target_noun").alias("noun"),
        F.transform(F.split("target_noun", ""), lambda c: F.ascii(c)).alias("token_ids"),
    )


# --- runs -------------------------------------------------------------------------------------


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run rows from orders: action by status, model by customer, dataset by priority."""
    action = F.when(F.col("o_orderstatus") == "F", "eval").when(F.col("o_orderstatus") == "O", "eval_cls").otherwise("infer")
    key, priority, price = F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_totalprice")
    dataset = (
        F.when(F.col("o_orderstatus") == "O", F.when(key % 8 == 3, "classes22k").otherwise("classes1k"))
        .when(priority == "1-URGENT", "nouns_v6.bin").when(priority == "2-HIGH", "nouns2_v6.bin").when(priority == "3-MEDIUM", "captions2_v6.bin")
        .when(priority == "5-LOW", "shapes_valid_guide_v6.bin").when(key % 2 == 0, "shapes_valid_multi_v6.bin")
    )
    return table(spark, sf_dir, "orders").select(
        key.alias("run_id"), F.col("o_orderdate").alias("created_at"), action.alias("action"),
        F.when(key % 9 == 0, "crashed").otherwise("finished").alias("state"),
        F.concat(F.lit("host-"), (F.col("o_custkey") % 7).cast("string")).alias("host"),
        F.concat(F.lit("dir_"), (F.expr("o_custkey div 4")).cast("string")).alias("model_dir"),
        F.concat(F.lit("m"), (F.col("o_custkey") % 4).cast("string")).alias("model_name"),
        dataset.alias("dataset"),
        (price / 500000).alias("noun_top1"),
        (price / 600000).alias("top1"),
        F.when(key % 97 == 0, "tag_x").otherwise(F.concat(F.lit("tag_"), (F.col("o_custkey") % 5).cast("string"))).alias("tag"),
        F.concat(F.lit("train --size "), (F.col("o_custkey") % 3).cast("string")).alias("command"),
        F.when(F.col("o_orderstatus") != "F", price / 700000).alias("valid"),
        F.when((F.col("o_orderstatus") == "O") & (key % 4 != 0), price / 800000).alias("direct"),
        F.when(F.col("o_orderstatus") == "O", price / 900000).alias("fixed"),
    )


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training metrics per batch: run, batch order (ts), loss and token counts."""
    tokens = F.regexp_extract("props", r'"k": (\d+)', 1).cast("long") + 1
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), "ts", "event_id",
        F.col("value").alias("loss_sum"), tokens.alias("loss_basis"),
        F.pmod(F.col("event_id"), tokens).alias("correct"), tokens.alias("tokens"),
    )


def run_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Infer runs with a log text built from the order's lines; every 11th log has its markers in the wrong order."""
    lines = table(spark, sf_dir, "lineitem").join(part_names(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey"))
    said = F.concat(F.lit("[I] img_"), F.col("l_linenumber").cast("string"), F.lit(".jpg -->  "), part_noun("p_name", "l_partkey"))
    texts = lines.groupBy(F.col("l_orderkey").alias("run_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", said.alias("line")))), lambda x: x["line"]), "\n").alias("body")
    )
    rows = runs(spark, sf_dir).join(texts.hint("merge"), "run_id")
    start, end = "[I] Inferencing loaded model on the generated embeddings...\n", "\n[I] " + "-" * 50 + "\n"
    body = F.when(F.col("run_id") % 11 == 0, F.concat(F.lit(end + start), "body")).otherwise(F.concat(F.lit(start), F.col("body"), F.lit(end)))
    log = F.concat(F.lit("[I] img_0 --> before\n[I] Loading model: /data/"), F.concat_ws("/", "model_dir", "model_name"), F.lit("\n"), body, F.lit("[I] img_9 --> after"))
    return rows.withColumn("log", log).drop("body")


def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three search results per noun, from page titles."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, sf_dir, "pages").select(
        F.expr("page_id div 3").alias("noun"), (F.col("page_id") % 3).alias("rank"),
        F.when(F.col("page_id") % 4 == 0, F.concat(title, F.lit(" (Disambiguation)"))).otherwise(F.concat(title, F.lit(" "), (F.col("page_id") % 7).cast("string"))).alias("title"),
    )


def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit(" "), (F.col("page_id") % 7).cast("string"))
    tail = F.get(F.array(F.lit(".jpg"), F.lit(".SVG"), F.lit(".png"), F.lit(".pdf")), (F.col("page_id") % 4).cast("int"))
    return table(spark, sf_dir, "pages").select(
        "page_id", title.alias("title"), (F.col("page_id") * 37 % 900 + 20).alias("width"), (F.col("page_id") * 53 % 700 + 10).alias("height"),
        F.concat("url", tail).alias("source"),
    )


# --- the same fixtures as DuckDB CTEs ---------------------------------------------------------

_NOUN = "p_name || ' ' || p_partkey"

CTES: dict[str, tuple[str, str]] = {
    "prompt_rows": ("", f"SELECT * FROM (VALUES {_values(PROMPT_ROWS)}) t(collection, pos, freq, template)"),
    "hypernym_rows": ("", f"SELECT * FROM (VALUES {_values(HYPERNYM_ROWS)}) t(collection, pos, freq, template)"),
    "vocab": ("", f"""
        SELECT p_partkey::BIGINT AS id, {_NOUN} AS target_noun, {_NOUN} AS pretty_noun,
               CASE WHEN p_size % 4 = 0 THEN [{_NOUN}, lower(p_type) || ' ' || {_NOUN}] ELSE [{_NOUN}] END AS singulars,
               CASE WHEN p_size % 4 = 0 THEN [1 + p_size % 3, 1] ELSE [1 + p_size % 3] END AS singulars_freq,
               CASE WHEN p_size % 2 = 0 THEN [{_NOUN} || 's'] ELSE [] END AS plurals,
               CASE WHEN p_size % 2 = 0 THEN [1 + p_size % 5] ELSE [] END AS plurals_freq,
               list_filter(CASE WHEN p_size % 3 = 0 THEN []
                    WHEN p_size % 3 = 1 OR p_partkey // 10 = p_partkey // 100 THEN [p_partkey // 10]
                    ELSE [p_partkey // 10, p_partkey // 100] END, lambda h: h <> p_partkey) AS hypernyms
        FROM part"""),
    "vocab_nouns": ("vocab", """
        SELECT id, target_noun, 'singular' AS kind, i - 1 AS npos, singulars[i] AS noun, singulars_freq[i]::BIGINT AS freq
        FROM vocab, unnest(range(1, len(singulars) + 1)) u(i)
        UNION ALL
        SELECT id, target_noun, 'plural', i - 1, plurals[i], plurals_freq[i]::BIGINT
        FROM vocab, unnest(range(1, len(plurals) + 1)) u(i)"""),
    "vocab_links": ("vocab", """
        SELECT v.id, i - 1 AS pos, v.hypernyms[i] AS hypernym_id, h.target_noun AS hypernym_target
        FROM vocab v, unnest(range(1, len(v.hypernyms) + 1)) u(i) JOIN vocab h ON h.id = v.hypernyms[i]"""),
    "noun_ids": ("vocab_nouns", "SELECT DISTINCT noun, id FROM vocab_nouns"),
    "class_names": ("", f"""
        SELECT o_orderkey AS class_id,
               CASE o_orderstatus WHEN 'F' THEN 'Zoo-Thing, ' || upper(noun[1]) || noun[2:] || 's ,' || noun
                    WHEN 'O' THEN upper(replace(noun, ' ', '-')) || ', café thing' ELSE 'unknown ' || noun END AS names
        FROM (SELECT o_orderkey, o_orderstatus, {_NOUN} AS noun FROM orders JOIN part ON o_custkey = p_partkey)"""),
    "class_parts": ("class_names", r"""
        SELECT class_id, i - 1 AS pos, trim(parts[i]) AS raw_name,
               trim(regexp_replace(replace(replace(lower(strip_accents(trim(regexp_replace(parts[i], '\s+', ' ', 'g')))), '''', ''), '.', ''), '[\s/-]+', ' ', 'g')) AS name
        FROM (SELECT class_id, string_split(names, ',') AS parts FROM class_names), unnest(range(1, len(parts) + 1)) u(i)"""),
    "candidates": ("", f"""
        SELECT 'preds_m' || m || '.json' AS file, 'model_' || m AS model,
               CASE st WHEN 'F' THEN 'beam_k3_vnone_gn_t1_a0' ELSE 'beam_k5_vnone_gp_t1_a0' END AS gencfg,
               CASE st WHEN 'F' THEN 3 ELSE 5 END AS gen_topk, 'img_' || s AS sample, s AS sample_id,
               l_partkey AS noun_id, p_name || ' ' || l_partkey AS pred, price / 100000 AS score
        FROM (SELECT l_suppkey % 4 AS m, l_linestatus AS st, l_orderkey // 10 AS s, l_partkey, max(l_extendedprice) AS price
              FROM lineitem GROUP BY ALL) JOIN part ON p_partkey = l_partkey"""),
    "predictions": ("candidates", """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file, gencfg, sample ORDER BY score DESC, pred) AS k FROM candidates)
        WHERE k <= gen_topk"""),
    "annotations": ("pairs", """
        SELECT 'img_' || s AS sample, category, p_name || ' ' || l_partkey AS noun FROM (
            SELECT s, l_partkey, CASE WHEN code <= 1 THEN 'correct_primary' WHEN code = 2 THEN 'correct_secondary' WHEN code = 3 THEN 'close_primary'
                       WHEN code = 4 THEN 'close_secondary' WHEN code <= 7 THEN 'incorrect' END AS category FROM pairs
            UNION
            SELECT s, l_partkey, 'close_primary' FROM pairs WHERE l_partkey % 13 = 0
        ) JOIN part ON p_partkey = l_partkey WHERE category IS NOT NULL"""),
    "pairs": ("", """
        SELECT DISTINCT l_orderkey // 10 AS s, l_partkey, ((l_orderkey // 10) * 7 + l_partkey) % 11 AS code
        FROM lineitem WHERE (l_orderkey // 10) % 17 <> 0"""),
    "cat_scores": ("", """
        SELECT * FROM (VALUES ('correct_primary', 1.0::DOUBLE), ('correct_secondary', 0.8), ('close_primary', 0.5),
                       ('close_secondary', 0.4), ('incorrect', 0.0)) t(category, cscore)"""),
    "pair_category": ("annotations", "SELECT sample, noun, min(category) AS category FROM annotations GROUP BY ALL"),
    "scored": ("predictions pair_category cat_scores", """
        SELECT p.*, c.category, coalesce(s.cscore, 0.0) AS cscore
        FROM predictions p LEFT JOIN pair_category c ON c.sample = p.sample AND c.noun = p.pred
             LEFT JOIN cat_scores s ON s.category = c.category"""),
    "specificity": ("", f"SELECT {_NOUN} AS noun, (p_size % 10 + 1) / 10.0::DOUBLE AS specificity FROM part"),
    "caption_rows": ("", r"""
        SELECT doc_id, doc_id * 3 % n + 1 AS id, CASE WHEN pos % 3 = 2 THEN 'plural' ELSE 'singular' END AS kind, pos,
               sentence || ' near the {' || CASE WHEN pos % 3 = 2 THEN 'plural' ELSE 'singular' END || '}' AS caption
        FROM (SELECT doc_id, i - 1 AS pos, trim(parts[i]) AS sentence
              FROM (SELECT doc_id, string_split(replace(text, chr(10), ' '), '.') AS parts FROM documents),
                   unnest(range(1, len(parts) + 1)) u(i)), (SELECT max(p_partkey)::BIGINT + max(p_partkey)::BIGINT // 4 AS n FROM part)
        WHERE sentence <> ''"""),
    "faulty_captions": ("caption_rows", """
        SELECT doc_id, id, kind, pos, CASE (id + pos) % 23 WHEN 1 THEN replace(caption, '{', '') WHEN 2 THEN caption || ' {other}'
               WHEN 3 THEN caption || ',' WHEN 4 THEN caption || ' café' WHEN 5 THEN 'repeated {' || kind || '}' ELSE caption END AS caption
        FROM caption_rows"""),
    "doc_prompts": ("caption_rows", r"""
        SELECT CAST(source[4:] AS INT) AS coll, doc_id * 10000 + pos AS pos, (doc_id + pos) % 4 AS freq,
               sentence || ' {' || (['article_noun', 'noun', 'singular', 'article_singular', 'plural'])[pos % 5 + 1] || '}'
               || (['', ' shown', ', indeed'])[pos % 3 + 1] AS template
        FROM (SELECT *, regexp_extract(caption, '^(.*) near the \{', 1) AS sentence FROM caption_rows) JOIN documents USING (doc_id)"""),
    "doc_hypernyms": ("caption_rows", r"""
        SELECT CAST(source[4:] AS INT) AS coll, doc_id * 10000 + pos AS pos, (doc_id + pos) % 4 AS freq,
               CASE WHEN (doc_id + pos) % 19 <> 0 THEN sentence || ' {' || (['target', 'article_target'])[pos % 2 + 1] || '}'
               || (['', ' shown', ', indeed'])[pos % 3 + 1] END AS template
        FROM (SELECT *, regexp_extract(caption, '^(.*) near the \{', 1) AS sentence FROM caption_rows) JOIN documents USING (doc_id)"""),
    "caption_lines": ("caption_rows", r"""
        SELECT doc_id // 8 + 1 AS id, doc_id AS seq, pos, pos % 5 <> 4 AND length(sentence) > 0 AS numbered, p_name || ' ' || p_partkey AS noun,
               replace(strip_accents(sentence), 'ß', 'ss') || ' with ' || CASE WHEN pos % 3 = 2 THEN p_name || ' ' || p_partkey || 's' ELSE upper(p_name || ' ' || p_partkey) END || CASE WHEN pos % 2 = 0 THEN ', shown.' ELSE '.' END AS caption
        FROM (SELECT doc_id, pos, regexp_extract(caption, '^(.*) near the \{', 1) AS sentence FROM caption_rows) JOIN part ON p_partkey = doc_id // 8 + 1"""),
    "run_logs": ("runs", """
        SELECT r.*, l_linenumber AS line, l_partkey, p_name || ' ' || l_partkey AS noun FROM runs r JOIN lineitem ON l_orderkey = run_id JOIN part ON p_partkey = l_partkey
        WHERE action = 'infer' AND run_id % 11 <> 0"""),
    "search_results": ("", """
        SELECT page_id // 3 AS noun, page_id % 3 AS rank, CASE WHEN page_id % 4 = 0 THEN t || ' (Disambiguation)' ELSE t || ' ' || (page_id % 7) END AS title
        FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages)"""),
    "page_images": ("", """
        SELECT page_id, t || ' ' || (page_id % 7) AS title, page_id * 37 % 900 + 20 AS width, page_id * 53 % 700 + 10 AS height,
               url || (['.jpg', '.SVG', '.png', '.pdf'])[page_id % 4 + 1] AS source
        FROM (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages)"""),
    "opinions": ("", """
        SELECT 'img_' || user_id AS image, event_type || ' ' || (event_id % 4) AS noun, ts, event_id, value > 20 AS opinion FROM events"""),
    "opinion_pairs": ("opinions", """
        SELECT image, noun, count(*) AS n, count(*) FILTER (WHERE opinion) AS n_correct FROM opinions GROUP BY ALL"""),
    "multi_targets": ("", """
        SELECT vec_id AS row_id, embedding,
               [label + 1, CASE WHEN vec_id % 3 >= 1 THEN (label + vec_id) % 10 + 1 ELSE 0 END,
                CASE WHEN vec_id % 3 >= 2 THEN (label * 3 + vec_id + 1) % 10 + 1 ELSE 0 END]::INT[] AS target_ids,
               CASE vec_id % 3 WHEN 0 THEN [1.0, 0.0, 0.0] WHEN 1 THEN [0.75, 0.25, 0.0] ELSE [0.5, 0.25, 0.25] END::DOUBLE[] AS target_weights
        FROM embeddings"""),
    "vec_elems": ("", """
        SELECT vec_id, label, i - 1 AS pos, embedding[i]::DOUBLE AS x FROM embeddings, unnest(range(1, len(embedding) + 1)) u(i)"""),
    "proto_elems": ("vec_elems", """
        SELECT label AS class_id, pos, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS p
        FROM (SELECT label, pos, avg(x) AS m FROM vec_elems GROUP BY ALL)"""),
    "dots": ("vec_elems proto_elems", """
        SELECT vec_id, label, class_id, sum(x * p) AS dot FROM vec_elems JOIN proto_elems USING (pos) GROUP BY ALL"""),
    "target_tokens": ("vocab", """
        SELECT id AS target_id, target_noun AS noun, list_transform(string_split(target_noun, ''), lambda c: ascii(c))::INT[] AS token_ids FROM vocab"""),
    "token_elems": ("target_tokens", """
        SELECT target_id, noun, i - 1 AS pos, token_ids[i] AS token FROM target_tokens, unnest(range(1, len(token_ids) + 1)) u(i)"""),
    "runs": ("", """
        SELECT o_orderkey AS run_id, o_orderdate AS created_at,
               CASE o_orderstatus WHEN 'F' THEN 'eval' WHEN 'O' THEN 'eval_cls' ELSE 'infer' END AS action,
               CASE WHEN o_orderkey % 9 = 0 THEN 'crashed' ELSE 'finished' END AS state,
               'host-' || (o_custkey % 7) AS host, 'dir_' || (o_custkey // 4) AS model_dir, 'm' || (o_custkey % 4) AS model_name,
               CASE WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 8 = 3 THEN 'classes22k' ELSE 'classes1k' END ELSE CASE o_orderpriority WHEN '1-URGENT' THEN 'nouns_v6.bin'
                    WHEN '2-HIGH' THEN 'nouns2_v6.bin' WHEN '3-MEDIUM' THEN 'captions2_v6.bin' WHEN '5-LOW' THEN 'shapes_valid_guide_v6.bin'
                    ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'shapes_valid_multi_v6.bin' END END END AS dataset,
               o_totalprice / 500000 AS noun_top1, o_totalprice / 600000 AS top1,
               CASE WHEN o_orderkey % 97 = 0 THEN 'tag_x' ELSE 'tag_' || (o_custkey % 5) END AS tag, 'train --size ' || (o_custkey % 3) AS command,
               CASE WHEN o_orderstatus <> 'F' THEN o_totalprice / 700000 END AS valid, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 4 <> 0 THEN o_totalprice / 800000 END AS direct,
               CASE WHEN o_orderstatus = 'O' THEN o_totalprice / 900000 END AS fixed
        FROM orders"""),
    "run_metrics": ("", r"""
        SELECT user_id AS run_id, ts, event_id, value AS loss_sum, k + 1 AS loss_basis, event_id % (k + 1) AS correct, k + 1 AS tokens
        FROM (SELECT *, regexp_extract(props, '"k": (\d+)', 1)::BIGINT AS k FROM events)"""),
    "answers": ("", """
        SELECT rid AS request_id, 'img_' || user_id AS image, ts, nouns,
               CASE WHEN rid % 41 = 7 THEN 'length' ELSE 'stop' END AS finish_reason,
               CASE WHEN rid % 43 = 8 THEN '' ELSE full_text END AS content, length(full_text) AS prompt_tokens, (rid % 50 + 10) AS completion_tokens
        FROM (SELECT rid, user_id, ts, nouns, 'The  scene of ' || rid || '.' || chr(10)
                     || CASE WHEN rid % 5 = 4 THEN '1) a list of things' || chr(10) ELSE '' END || body
                     || CASE WHEN rid % 37 = 3 THEN chr(10) || '9. extra line' ELSE '' END AS full_text
              FROM (SELECT event_id // 4 AS rid, min(user_id) AS user_id, min(ts) AS ts,
                           list(event_type || ' ' || (event_id % 4) ORDER BY event_id) AS nouns,
                           string_agg((CASE WHEN (event_id // 4) % 29 = 1 THEN event_id % 4 + 2 ELSE event_id % 4 + 1 END)
                               || CASE WHEN (event_id // 4) % 3 = 0 THEN ')' ELSE '.' END || '  **'
                               || CASE WHEN (event_id // 4) % 31 = 2 THEN 'other thing' ELSE upper(event_type[1]) || event_type[2:] || ' ' || (event_id % 4) END
                               || '**: ' || CASE WHEN value > 20 THEN 'Correct' ELSE 'incorrect' END, chr(10) ORDER BY event_id) AS body
                    FROM events GROUP BY 1))"""),
}


def _closure(names: list[str], seen: dict[str, str]) -> None:
    for name in names:
        if name not in seen:
            needs, text = CTES[name]
            _closure(needs.split(), seen)
            seen[name] = text


def with_ctes(names: str, sql: str) -> str:
    """`sql` with the named fixture CTEs, and all they need, in front."""
    seen: dict[str, str] = {}
    _closure(names.split(), seen)
    body = sql.strip()
    own, start = "", "WITH "
    if body[:5].upper() == "WITH ":
        own, body = body[5:], ""
    if own[:10].upper() == "RECURSIVE ":
        own, start = own[10:], "WITH RECURSIVE "
    parts = [f"{name} AS ({text.strip()})" for name, text in seen.items()]
    if own:
        return start + ", ".join([*parts, own])
    return ("WITH " + ", ".join(parts) + "\n" + body) if parts else body
