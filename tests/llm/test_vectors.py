"""Codes and inner products against brute force."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tools.check_oracle import connect, rows_of
from vocabspark.llm import codes, innerk
from vocabspark.llm.gnat import Gnat, root_ceil, root_floor
from vocabspark.llm.queries import ORACLES, QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, code string"


@given(st.lists(st.integers(0, 2**60), min_size=1, max_size=50))
def test_roots(values):
    squares = np.array(values, dtype=np.int64)
    for s, low, high in zip(values, root_floor(squares).tolist(), root_ceil(squares).tolist()):
        assert low * low <= s < (low + 1) ** 2 and (high - 1) ** 2 < s <= high * high or s == low == high == 0


def brute_nearest(entries, queries):
    apart = ((queries[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(axis=2)
    return [min(range(len(entries)), key=lambda i: (row[i], i)) for row in apart], [min(row) for row in apart]


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 40), st.integers(1, 5), st.sampled_from([1, 3, 60, 5000, 1 << 26]), st.integers(2, 5), st.integers(0, 10**6))
def test_gnat_is_exact(n, d, spread, arity, seed):
    """Small spreads give ties and repeated entries."""
    rng = np.random.default_rng(seed)
    entries, queries = rng.integers(-spread, spread + 1, (n, d)), rng.integers(-spread, spread + 1, (30, d))
    index, apart = Gnat(entries, arity).nearest(queries)
    assert (index.tolist(), apart.tolist()) == brute_nearest(entries, queries)


def test_gnat_leaves_subtrees_out():
    rng = np.random.default_rng(1)
    entries = (rng.integers(-40_000, 40_000, (16, 4))[:, None] + rng.integers(-300, 300, (16, 16, 4))).reshape(-1, 4)
    tree = Gnat(entries)
    queries = entries[rng.integers(0, len(entries), 2000)] + rng.integers(-50, 50, (2000, 4))
    index, apart = tree.nearest(queries)
    assert (index.tolist(), apart.tolist()) == brute_nearest(entries, queries)
    assert tree.measured < 0.25 * len(entries) * len(queries)


def slow_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, [int(np.floor(scale * np.float64(np.float32(x)))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) and abs(x) < 2**15 for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    kept = [(i, v + [0] * (width - len(v)), label) for i, v, label in kept]
    step = width // parts
    seeds = [v for _, v in sorted([(i is None, i or 0), v] for i, v, _ in kept)][:entries]
    books = [[s[p * step : (p + 1) * step] for s in seeds] for p in range(parts)]

    def assign(v):
        out = []
        for p, book in enumerate(books):
            own = v[p * step : (p + 1) * step]
            out.append(min((sum((a - b) ** 2 for a, b in zip(own, e)), j) for j, e in enumerate(book)))
        return out

    for _ in range(rounds):
        given_ = [assign(v) for _, v, _ in kept]
        for p in range(parts):
            for j in range(len(books[p])):
                own = [v[p * step : (p + 1) * step] for (_, v, _), a in zip(kept, given_) if a[p][1] == j]
                if own:
                    books[p][j] = [sum(c) // len(own) for c in zip(*own)] if step else []
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, sums = [], {}
    for i, v, label in kept:
        a = assign(v)
        sums[label] = sums.get(label, 0) + sum(x for x, _ in a)
        out.append((i, "".join(f"{j:02x}" for _, j in a), sum(x for x, _ in a), label))
    return sorted(((i, c, e, sums[label], digest) for i, c, e, label in out), key=str)


def odd_rows(n=70, d=16, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=d)], int(i) % 3 if i % 5 else None) for i in rng.permutation(n)]
    rows += rows[:7]  # repeated rows
    rows += [(n + i, rows[0][1], 1) for i in range(40)]  # one vector many times
    rows += [(None, rows[3][1], None), (900, None, 1), (901, [1.0, None] * 8, 1), (902, [float("nan")] * d, 2), (903, [float("inf")] * d, 2), (904, [1e30] * d, 2), (-50, [0.5] * 3, 0), (950, [], 0)]
    return rows


@pytest.mark.parametrize("rows", [odd_rows(), odd_rows(9, 5), [(1, [], None), (2, [], 4)], [(None, [1.0], 1)], [(3, None, 1)], []])
def test_codes_of_odd_rows(spark, rows):
    df = spark.createDataFrame([(*r, "user's own") for r in rows], SCHEMA)
    got = codes.encode(df, "vec_id", "embedding", "label")
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == slow_codes(rows)


def slow_top(rows, k=5, scale=256, divisor=50):
    kept = [(i, [int(np.floor(scale * np.float64(np.float32(x)))) for x in v]) for i, v, _ in rows if v is not None and all(x is not None and np.isfinite(x) and abs(x) < 2**15 for x in v)]
    out = []
    for at, (i, v) in enumerate(kept):
        if i is not None and i % divisor == 0:
            others = [(-sum(a * b for a, b in zip(v, w)), j is None, j or 0, j) for b, (j, w) in enumerate(kept) if b != at]
            out += [(i, r + 1, j, -s) for r, (s, _, _, j) in enumerate(sorted(others)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [dict(), dict(cell=20, block=2)])
@pytest.mark.parametrize("rows", [odd_rows(230), odd_rows(9, 5), [(50, [], None), (2, [], 4)], [(None, [1.0], 1)], [(50, [1.0], 1)], []])
def test_top_of_odd_rows(spark, rows, sizes):
    df = spark.createDataFrame([(*r, "user's own") for r in rows], SCHEMA)
    got = innerk.top_inner_products(df, "vec_id", "embedding", df.vec_id % 50 == 0, **sizes)
    assert sorted(map(tuple, got.collect()), key=str) == slow_top(rows)


def test_top_over_bands_of_length(spark):
    """Lengths that differ by orders of magnitude; cells beyond a query's reach are not met."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8) * 10.0 ** rng.integers(-3, 2)], 0) for i in range(600)]
    df = spark.createDataFrame([(*r, "") for r in rows], SCHEMA)
    got = innerk.top_inner_products(df, "vec_id", "embedding", df.vec_id % 50 == 0, cell=40, block=3)
    assert sorted(map(tuple, got.collect()), key=str) == slow_top(rows)


def test_plans_of_many_bands_stay_small(spark, monkeypatch):
    """The cells of 64 bands were nested choices over nested sums in each plan; at such plans the driver's heap ran out."""
    rng = np.random.default_rng(7)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4) * (1 + i / 100)], 0) for i in range(700)]
    df = spark.createDataFrame([(*r, "") for r in rows], SCHEMA)
    plans, write = [], innerk.cut_lineage

    def noted(table):
        plans.append(len(table._jdf.queryExecution().optimizedPlan().toString()))
        return write(table)

    monkeypatch.setattr(innerk, "cut_lineage", noted)
    longest = {}
    for bands in (4, 16, 64):
        monkeypatch.setattr(innerk, "BANDS", bands)
        plans.clear()
        got = innerk.top_inner_products(df, "vec_id", "embedding", df.vec_id % 50 == 0, cell=10, block=5)
        longest[bands] = max(*plans, len(got._jdf.queryExecution().optimizedPlan().toString()))
    assert longest[64] < 20_000 and longest[64] - longest[16] < 8 * (longest[16] - longest[4]) + 2000
    assert sorted(map(tuple, got.collect()), key=str) == slow_top(rows)


@pytest.mark.parametrize("sizes", [dict(), dict(CHUNK=64, PART=128, SLICE=16)])
@pytest.mark.parametrize("n", [3000, 300])
def test_cell_of_equal_scores(monkeypatch, n, sizes):
    """Zero queries and a vector that is there many times score the same with rows of many chunks: the first by place stay."""
    for name, size in sizes.items():
        monkeypatch.setattr(innerk, name, size)
    rng = np.random.default_rng(11)
    cell = rng.integers(-50, 50, (n, 8))
    cell[rng.random(n) < 0.6] = cell[0]
    queries, place = np.concatenate([np.zeros((30, 8), dtype=np.int64), cell[:40]]), rng.permutation(n)
    turn = np.linalg.svd(cell.astype(float), full_matrices=False)[2].T
    least = np.full(len(queries), innerk._NONE)
    least[::3] = 1000
    best, _ = innerk.best_of_cell(queries, least, cell, place, turn, 6)
    for q, products in enumerate(queries @ cell.T):
        want = sorted((-s, p, c) for c, (s, p) in enumerate(zip(products.tolist(), place.tolist())) if s >= least[q])[:6]
        assert [(-s, c) for s, c in zip(best.s[best.q == q].tolist(), best.c[best.q == q].tolist())] == [(s, c) for s, _, c in want]


@pytest.mark.parametrize("decay", [1.0, 0.8])
@pytest.mark.parametrize("large", [False, True])
def test_cell_prunes_exactly(decay, large):
    rng = np.random.default_rng(2)
    cell = np.floor(rng.normal(size=(5000, 32)) * decay ** np.arange(32) * (2.0**23 if large else 300)).astype(np.int64)
    cell[100:400] = cell[7]
    queries = cell[:100]
    turn = np.linalg.svd(cell.astype(float), full_matrices=False)[2].T
    best, scored = innerk.best_of_cell(queries, np.full(100, innerk._NONE), cell, np.arange(5000), turn, 6)
    products = queries @ cell.T
    for q in range(100):
        want = sorted((-s, c) for c, s in enumerate(products[q].tolist()))[:6]
        assert [(-s, c) for s, c in zip(best.s[best.q == q].tolist(), best.c[best.q == q].tolist())] == want
    if decay < 1:
        assert scored < 0.5 * products.size


@pytest.mark.parametrize("name", ["op11_gnat_codes", "op12_inner_products"])
def test_sql_twins(spark, sf_small, name):
    df = QUERIES[name](spark, sf_small)
    cur = connect(sf_small).execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert rows_of([tuple(r) for r in df.collect()], df.columns) == rows_of(cur.fetchall(), names)
