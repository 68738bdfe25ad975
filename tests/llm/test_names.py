"""Columns of the user that are called as the operators' helper columns are."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import functions as F

from vocabspark import llm
from vocabspark.llm import html_text, lines, media, mixing, quality

HELPERS = sorted({m for p in Path(llm.__file__).parent.glob("*.py") for m in re.findall(r'"(__[a-z][a-z_]*)"', p.read_text())} - {"__all__"})


def test_user_columns_stay(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text", "source")
    clash = docs.withColumns({h: F.concat(F.lit(h), F.col("doc_id").cast("string")) for h in HELPERS})
    assert {"__id", "__text", "__source", "__digest"} <= set(HELPERS)

    def same(got, want, *own):
        assert sorted(got.columns) == sorted([*want.columns, *HELPERS])
        rows = got.select(*own, *HELPERS).collect()
        assert sorted(map(str, (tuple(r)[: len(own)] for r in rows))) == sorted(map(str, map(tuple, want.select(*own).collect())))
        assert all(r[h] == f"{h}{r.doc_id}" for r in rows for h in HELPERS)

    same(lines.dedup_lines(clash, "doc_id", "text"), lines.dedup_lines(docs, "doc_id", "text"), "doc_id", "text", "n_removed")
    mixed = mixing.mix(clash, "doc_id", "source", mixing.words(F.col("text")))
    same(mixed, mixing.mix(docs, "doc_id", "source", mixing.words(F.col("text"))), "doc_id", "size", "copies")
    assert mixing.mix(clash, "doc_id", "source", F.length("__id")).count() == docs.count()
    pages = html_text.extract(clash, ["doc_id", *HELPERS], "text")
    same(pages, html_text.extract(docs, ["doc_id"], "text"), "doc_id", "text")
    same(media.store_texts(clash, ["doc_id", *HELPERS], "text"), media.store_texts(docs, ["doc_id"], "text"), "doc_id", "n_bytes", "media")
    labels = spark.read.parquet(f"{sf_small}/labels.parquet")
    model = quality.train(docs, labels, "doc_id", "text", "quality")
    same(quality.score(clash, model, ["doc_id", *HELPERS], "text"), quality.score(docs, model, ["doc_id"], "text"), "doc_id", "score")
