"""Packing against the tokenizer itself and the rules of windows and mixture."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vocabspark.llm import packing
from vocabspark.llm.tokens import encoder

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tokenizer():
    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    return made


def test_ids_equal_the_tokenizers(tokenizer):
    encode, other = encoder(PATH, public_tokenizers.PATTERN), encoder(public_tokenizers.path("byte_bpe_50k.json"), "")
    texts = [f"a{chr(c)}b 1{chr(c)}{chr(c)} {chr(c)}  x{chr(c)}" for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    texts += ["", " ", "  \n\n a", "it's  we'll 'S <|endoftext|> x<|endoftext|>", "ééé 中文 字 \U0001f600\U0001f600", "a​ b﻿", "１２ ½ ⅷ", "　  x"]
    for text in texts:
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encode(text), "<u2").tolist() == np.frombuffer(other(text), "<u2").tolist() == want, repr(text)


def check(rows, docs, tokenizer, window, slot, ended=1):
    ids = [(d, tokenizer.encode(t or "", add_special_tokens=False).ids + [1], s) for d, t, s in docs]
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    windows = {}
    for d, own, s in ids:
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(own))
            assert np.frombuffer(r.ids, "<u4").tolist() == own[at : at + r.length]
            at += r.length
            windows.setdefault(r.sequence_id, []).append((r.offset, r.length, s))
        assert at == len(own)
    assert sorted(windows) == list(range(len(windows)))
    for w, pieces in windows.items():
        at = 0
        for offset, length, _ in sorted(pieces):
            assert offset == at
            at += length
        assert at == window or (w == len(windows) - 1 and at <= window)
    return windows


def test_whole_documents_and_proportions(spark, sf_small, tokenizer):
    df = spark.read.parquet(f"{sf_small}/documents.parquet")
    docs = [(r.doc_id, r.text, r.source) for r in df.collect()]
    rows = packing.pack(df.repartition(3, "doc_id"), "doc_id", "text", "source", PATH, public_tokenizers.PATTERN).collect()
    windows = check(rows, docs, tokenizer, 2048, 128)
    totals = {}
    for pieces in windows.values():
        for _, n, s in pieces:
            totals[s] = totals.get(s, 0) + n
    whole, taken = sum(totals.values()), dict.fromkeys(totals, 0)
    for w in range(len(windows) - 2):
        for _, n, s in windows[w]:
            taken[s] += n
        for s in totals:
            assert abs(taken[s] - (w + 1) * 2048 * totals[s] / whole) < 4 * 128


def test_weights_and_odd_rows(spark, tokenizer):
    docs = [(1, "a b " * 400, "x"), (2, "c d " * 900, "y"), (3, None, None), (4, "", "x"), (5, "e " * 700, None)]
    df = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, source string, start int, ids string")
    rows = packing.pack(df, "doc_id", "text", "source", PATH, public_tokenizers.PATTERN, window=64, slot=16, weights={"x": 2.0, "y": 1.0, None: 1.0}).collect()
    windows = check(rows, docs, tokenizer, 64, 16)
    for w in range(10):
        assert {s: sum(n for _, n, t in windows[w] if t == s) for s in ("x", "y", None)} == {"x": 32, "y": 16, None: 16}
    assert packing.pack(df.limit(0), "doc_id", "text", "source", PATH, public_tokenizers.PATTERN).count() == 0
    twice = spark.createDataFrame([(None, "same text", "x")] * 2, "doc_id long, text string, source string")
    assert packing.pack(twice, "doc_id", "text", "source", PATH, public_tokenizers.PATTERN).count() == 2
