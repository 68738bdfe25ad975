"""Line dedup and mixing against brute force and DuckDB."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from tools.check_oracle import connect, rows_of
from vocabspark.llm import lines, mixing, queries


@pytest.mark.parametrize("name", ["op7_line_dedup", "op9_mixing"])
def test_oracle(spark, sf_small, name):
    con = connect(sf_small)
    df = queries.QUERIES[name](spark, sf_small)
    cur = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of([tuple(r) for r in df.collect()], df.columns) == rows_of(cur.fetchall(), names)


def slow_dedup(docs, width=3):
    seen, out = set(), []
    for i, text in docs:
        parts = (text or "").split("\n")
        own = [k for k, x in enumerate(parts) if x.strip(" \t\r")]
        gone = set()
        for k in range(len(own) - width + 1):
            key = tuple(parts[own[k + j]].strip(" \t\r") for j in range(width))
            if key in seen:
                gone.update(own[k : k + width])
            seen.add(key)
        out.append((i, text if not gone else "\n".join(x for k, x in enumerate(parts) if k not in gone), len(own), len(gone)))
    return out


def test_dedup_lines(spark):
    docs = [
        (1, "a\nb\nc\nd"), (2, "x\n\na \n b\n\nc\ny"), (3, "a\nb"), (4, None), (5, ""), (6, "q\nq\nq\nq\nq"), (7, "a\nb\nc\nd"), (8, "\n\n"),
        (9, "p\nb\nc\nd\nz\na\nb\nc"), (10, "l\n" * 5000 + "end"), (11, "\n".join(f"u{i % 7}" for i in range(400))),
    ]
    df = spark.createDataFrame([(*d, 9, "k", "w") for d in docs], "id long, body string, n_lines int, d string, t string").repartition(3)
    got = sorted(tuple(r) for r in lines.dedup_lines(df, "id", "body").select("id", "body", "n_lines", "n_removed").collect())
    assert got == slow_dedup(docs)
    assert lines.dedup_lines(df, "id", "body").columns == ["id", "body", "d", "t", "n_lines", "n_removed"]
    assert lines.dedup_lines(df.limit(0), "id", "body").count() == 0


def test_equal_rows_and_null_ids_are_one_document(spark):
    df = spark.createDataFrame([(None, "a\nb\nc"), (1, "a\nb\nc"), (1, "a\nb\nc")], "id long, body string")
    got = sorted(((r.id is not None, r.body) for r in lines.dedup_lines(df, "id", "body").collect()))
    assert got == [(False, "a\nb\nc"), (True, ""), (True, "")]


def test_targets_are_reshared():
    assert mixing.targets([("a", 10), ("b", 10), (None, 10)]) == {"a": 5.0, "b": 10.0, None: 15.0}
    assert mixing.targets([("a", 100), ("b", 10), ("c", 10)]) == {"a": 60.0, "b": 30.0, "c": 30.0}
    assert mixing.targets([("a", 0), ("b", 0)]) == {"a": 0.0, "b": 0.0}
    assert mixing.targets([]) == {}
    many = mixing.targets([(f"s{i:02d}", 1 + i * i) for i in range(40)])
    assert abs(sum(many.values()) - sum(1 + i * i for i in range(40))) < 1e-6


def test_mix_takes_close_to_the_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 16)
    rows = [(i, ["a", "b", None][i % 3] if i % 2 else "a", " ".join("w" * (i % 50)), i) for i in range(3000)] + [(5000 + i, "hot", "same text here", i) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, size long")
    first = sorted(tuple(r) for r in mixing.mix(df, "doc_id", "source", mixing.words(F.col("text"))).drop("text").collect())
    again = mixing.mix(df.repartition(7), "doc_id", "source", mixing.words(F.col("text"))).drop("text").collect()
    assert first == sorted(tuple(r) for r in again) if all(r[1] is not None for r in first) else len(first) == len(again)
    assert {(r[0], r[5]) for r in first} == {(r.doc_id, r.copies) for r in again}
    taken = {}
    for doc_id, source, size, source_size, target, copies in first:
        assert 0 <= copies <= 3
        have = taken.setdefault(source, [0, target, source_size])
        have[0] += size * copies
    for got, target, source_size in taken.values():
        assert abs(got - target) < 0.02 * source_size and target <= 3 * source_size


def test_mix_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None), (None, "a", "x y"), (None, "a", "x y"), (2, "", ""), (3, "b", "z")], "doc_id long, source string, text string")
    got = mixing.mix(df, "doc_id", "source", mixing.words(F.col("text"))).collect()
    assert len(got) == 5 and {r.size for r in got if r.source is None} == {0}
    assert mixing.mix(df.limit(0), "doc_id", "source", mixing.words(F.col("text"))).count() == 0
