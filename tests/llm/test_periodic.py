"""Periodic runs against brute force."""

from __future__ import annotations

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vocabspark.llm import periodic
from vocabspark.llm.queries import QUERIES, _made_periodic


def slow_runs(words, least=12):
    """All stretches of each period that nothing extends, smallest periods only."""
    n, out = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i - s + p >= 2 * p:
                out.setdefault((s, i - s + p), p)  # the smallest period comes first
    return sorted((s, length, p) for (s, length), p in out.items() if length >= max(least, 2 * p))


def text_of(rng, size, alphabet):
    words = [str(rng.randrange(alphabet)).encode() for _ in range(size)]
    for _ in range(rng.randrange(4)):
        at, p, k = rng.randrange(size + 1), rng.randrange(1, 12), rng.randrange(2, 6)
        words[at : at + p * k] = (words[at : at + p] * k)[: rng.randrange(p * k + 1)]
    return words


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**9), st.integers(0, 90), st.sampled_from([1, 2, 3, 8, 1000]), st.sampled_from([2, 3, 7, 12]))
def test_runs_are_those_of_brute_force(seed, size, alphabet, least):
    words = text_of(random.Random(seed), size, alphabet)
    want = slow_runs(words, least)
    assert periodic.find_runs(words, least) == want
    assert periodic.runs_in(periodic.numbered(words), least) == want  # without leaving stretches out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_segments_are_last_occurrences(sequence):
    """Each access meets exactly the suffixes' last ends before, longest suffix of an end first."""
    automaton = periodic.Automaton(sequence)
    forest = periodic.LinkCut([x if x > 0 else -1 for x in automaton.link])
    for i, state in enumerate(automaton.prefix):
        got = {}
        for end, node in forest.access(state, i):
            got[end] = max(got.get(end, 0), automaton.length[node])
        want = {}
        for size in range(1, i + 1):
            suffix = sequence[i + 1 - size : i + 1]
            before = [e for e in range(size - 1, i) if sequence[e + 1 - size : e + 1] == suffix]
            if before:
                want[before[-1]] = size
        assert got == want


def test_long_texts():
    """Work that does not grow with the square: one word, one long period, and a long text without runs."""
    began = time.time()
    assert periodic.find_runs([b"a"] * 100_000) == [(0, 100_000, 1)]
    unit = [str(i).encode() for i in range(20_000)]
    assert periodic.find_runs([b"x", *unit * 3, b"x"]) == [(1, 60_000, 20_000)]
    rng = np.random.default_rng(1)
    words = [str(x).encode() for x in rng.integers(0, 500, 300_000)]
    line = [str(x).encode() for x in rng.integers(0, 500, 40)]
    for at in range(0, 300_000, 3000):
        words[at : at + 40] = line  # a line that comes again and again, far apart
    assert periodic.find_runs(words) == []
    fib = [b"a", b"b"]
    while len(fib) < 20_000:
        fib = fib + fib[: len(fib) * 610 // 987]
    assert len(periodic.find_runs(fib)) > 100
    assert time.time() - began < 60


def expected(i, text):
    words = (text or "").encode().split()
    if i is not None:
        words = _made_periodic(words, zlib.crc32(str(i).encode()))
    runs = slow_runs(words)
    gone = {x for s, n, p in runs for x in range(s + p, s + n)}
    best = min(((-n, s, p) for s, n, p in runs), default=None)
    first = (len(runs), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4))
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return (i, *first, digest("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()), digest(b" ".join(w for x, w in enumerate(words) if x not in gone)))


def test_made_periodic():
    words = [str(i).encode() for i in range(50)]
    for i in range(300):
        h = zlib.crc32(str(i).encode())
        g, n = h // 10, 50
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        want = words if h % 10 else [words[x] if x < a else words[a + (x - a) % p] for x in range(n)]
        assert _made_periodic(words, h) == want


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


@pytest.mark.parametrize("some", [True, False])
def test_odd_texts(spark, some):
    rng = random.Random(4)
    rows = [(i, b" ".join(text_of(rng, rng.randrange(60), 3)).decode()) for i in range(120)]
    rows += [(None, "a b " * 9), (500, None), (501, ""), (502, " \t\n\x0b\x0c\r "), (503, " x\x1c" * 3 + " é" * 14), (504, "w " * 3000), *rows[:5]]
    df = spark.createDataFrame([(*r, 1, "own") for r in rows if some], "doc_id long, text string, start int, runs string")
    mark = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    got = periodic.digests(periodic.detect(df, "doc_id", "text", prepare=_made_periodic, by=mark), "doc_id")
    assert got.columns == ["doc_id", *COLUMNS]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((expected(*r) for r in rows if some), key=str)


def test_detect_keeps_texts_and_spans(spark):
    df = spark.createDataFrame([(1, "so  it goes " + "on and " * 8 + "ends")], "doc_id long, text string")
    row = periodic.detect(df, "doc_id", "text").first()
    assert [tuple(r) for r in row.runs] == [(3, 16, 2)] and row.text == "so it goes on and ends"


def test_query_is_brute_force(spark, sf_small):
    texts = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").filter("length(text) < 12000").collect()
    got = {r[0]: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, sf_small).collect()}
    assert len(texts) > 100 and len(got) == spark.read.parquet(f"{sf_small}/documents.parquet").count()
    for r in texts:
        assert got[r.doc_id] == expected(r.doc_id, r.text)
