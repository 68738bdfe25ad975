"""The registered queries of this package, with their DuckDB twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, common, html_text, innerk, lines, media, mixing, packing, periodic, pii, quality, secrets, simhash, spans

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(build):
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


@query("op1_simhash")
def _(spark, sf_dir):
    return simhash.near_duplicates(common.table(spark, sf_dir, "documents"), "doc_id", "text")


@query("op2_packing")
def _(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    pieces = packing.pack(docs, "doc_id", "text", "source", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op3_html_text")
def _(spark, sf_dir):
    return html_text.extract(common.table(spark, sf_dir, "pages"), ["page_id", "url"], "html")


@query("op4_quality")
def _(spark, sf_dir):
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = quality.train(docs, labels, "doc_id", "text", "quality")
    scored = quality.score(docs, model, ["doc_id"], "text")
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


@query("op5_secrets")
def _(spark, sf_dir):
    return secrets.scan(common.table(spark, sf_dir, "documents"), "doc_id", "text")


@query("op6_prefix_hashes")
def _(spark, sf_dir):
    return spans.fingerprints(common.table(spark, sf_dir, "documents"), "doc_id", "text")


@query("op7_line_dedup", lines.ORACLE)
def _(spark, sf_dir):
    return lines.dedup_lines(common.table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "text", "n_lines", "n_removed")


@query("op8_pii")
def _(spark, sf_dir):
    return pii.scan(common.table(spark, sf_dir, "documents"), "doc_id", "text")


@query("op9_mixing", mixing.oracle())
def _(spark, sf_dir):
    mixed = mixing.mix(common.table(spark, sf_dir, "documents"), "doc_id", "source", mixing.words(F.col("text")), keep=("doc_id",))
    return mixed.withColumn("taken", F.col("size") * F.col("copies"))


@query("op10_media")
def _(spark, sf_dir):
    stored = media.store_texts(common.table(spark, sf_dir, "documents"), ["doc_id"], "text")
    told = media.describe(stored.withColumn("media_bytes", F.octet_length("media").cast("long")), ["doc_id", "n_bytes", "media_bytes"], "media", "declared")
    feature = F.concat_ws(";", "type", "feature", F.array_join("carved", "+"))
    return told.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


@query("op11_gnat_codes", codes.oracle())
def _(spark, sf_dir):
    return codes.encode(common.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


@query("op12_inner_products", innerk.oracle())
def _(spark, sf_dir):
    return innerk.top_inner_products(common.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0)


def _made_periodic(words: list[bytes], mark: int | None) -> list[bytes]:
    """The op13 contract's words: of the texts whose mark ends in 0, those from a place on repeat a period."""
    n = len(words)
    if mark is None or mark % 10 or not n:
        return words
    g = mark // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


@query("op13_periodic_runs")
def _(spark, sf_dir):
    mark = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = periodic.detect(common.table(spark, sf_dir, "documents"), "doc_id", "text", prepare=_made_periodic, by=mark)
    return periodic.digests(found, "doc_id")
