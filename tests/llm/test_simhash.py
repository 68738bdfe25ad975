"""SimHash classes against brute force over all pairs."""

from __future__ import annotations

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from vocabspark.llm import simhash


def slow_fingerprint(text, words=3):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    shingles = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(fps, tau):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = list(root)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= tau:
                root[find(a)] = find(b)
    out = {}
    for f in fps:
        out.setdefault(find(f), set()).add(f)
    return {frozenset(s) for s in out.values()}


TEXTS = [None, "", " \n", "one", "One", "one two", "a b c d", "A  b\tc d", "ä ö ü ß", "x " * 3000, "a b c d e f g h", "a b c d e f g h i"]


def test_fingerprints_of_odd_texts():
    for text in TEXTS:
        assert simhash.fingerprint(text) % (1 << 64) == slow_fingerprint(text)


def test_documents(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, "doc_id", "text").collect()}
    fps = {d: slow_fingerprint(t) for d, t in rows}
    assert {d: f"{f:016x}" for d, f in fps.items()} == {d: g[0] for d, g in got.items()}
    for group in slow_classes(set(fps.values()), 2):
        own = [d for d, f in fps.items() if f in group]
        assert {got[d][1] for d in own} == {min(own)}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize(("tau", "segments"), [(2, 7), (2, 5), (6, 7), (3, 4)])
def test_links_join_what_all_pairs_join(spark, monkeypatch, tau, segments):
    """Random centres with neighbours at 0 to tau + 2 bits, and dense groups beyond the block size."""
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = random.Random(tau)
    fps = set()
    for _ in range(60):
        centre = rng.getrandbits(64)
        for _ in range(rng.randint(1, 30)):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, tau + 2)):
                x ^= 1 << b
            fps.add(x)
    df = spark.createDataFrame([(signed(f), signed(f), b"") for f in fps], "node long, fp long, check binary")
    from vocabspark.llm.components import connected_components

    roots = {r.node: r.root for r in connected_components(simhash.near_links(df, tau, segments)).collect()}
    got = {}
    for f in fps:
        got.setdefault(roots.get(signed(f), signed(f)), set()).add(f)
    assert {frozenset(g) for g in got.values()} == slow_classes(fps, tau)


def test_lengthened_keys_find_the_same_links(spark, monkeypatch):
    """As for more nodes than the exact openings have bits for."""
    rng = random.Random(8)
    fps = {rng.getrandbits(64) for _ in range(30)}
    fps |= {f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in list(fps) for _ in range(4)}
    df = spark.createDataFrame([(signed(f), signed(f), b"") for f in fps], "node long, fp long, check binary")
    pairs = lambda: {frozenset((r.u, r.v)) for r in simhash.near_links(df).collect()}
    plain = pairs()
    monkeypatch.setattr(simhash, "LEAST_BITS", 40)
    assert plain == pairs() and plain


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (None, None), (7, "q r s t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit(1), "label": F.lit("x"), "n": F.lit(None).cast("int")})
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(docs, "doc_id", "text").collect())
    assert got == [(False, 1, 1), (False, 2, 1), (False, 3, 3), (False, 3, 3), (False, 7, 7), (True, 0, 1), (True, 0, 3)]
    assert simhash.near_duplicates(docs.limit(0), "doc_id", "text").count() == 0


def test_long_fingerprints_must_agree_too(spark):
    """Texts with the same words in another order share the first fingerprint, not the second."""
    rng = random.Random(9)
    words = [f"word{rng.getrandbits(40)}" for _ in range(300)]
    near = words.copy()
    near[150] = "changed"
    other = sorted(words)
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(other)), (4, " ".join(words)), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, "doc_id", "text", 1, True, 6, 7, least_chars=5, check_words=5).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5}
    assert simhash.most_apart(0.8, 4) == 45 and simhash.most_apart(1.0, 4) == 0


def test_near_keys_are_all_flips_in_a_small_plan(spark):
    """The driver holds, prints and compiles the plan of the keys: it must not have a column for each of them."""
    ring, rng = simhash.Ring(2, 7), random.Random(8)
    fps = [0, -1, 1 << 62, -(1 << 63), *(rng.getrandbits(64) - (1 << 63) for _ in range(20))]
    df = spark.createDataFrame([(x,) for x in fps], "fp long").repartition(2)
    for length in (ring.near, ring.m):
        keyed = df.select("fp", F.explode(ring.near_keys(F.col("fp"), length)).alias("k")).select("fp", "k.i", "k.key")
        expected = set()
        for fp in fps:
            for i in range(ring.m):
                bits, at = ring.bits(i, length), ring.bounds[i]
                turned = (fp % (1 << 64) >> at | fp % (1 << 64) << 64 - at) % (1 << bits)
                for key in [turned, *(turned ^ 1 << b for b in range(ring.bits(i, ring.exact), bits))]:
                    expected.add((fp, i, key - (1 << 64) if key >> 63 else key))
        got = [tuple(r) for r in keyed.collect()]
        assert len(got) == len(expected) and set(got) == expected
        assert len(keyed._jdf.queryExecution().optimizedPlan().toJSON()) < 100_000
