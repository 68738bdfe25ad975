"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a few numbers. Cyclic boosting goes round the features, each time adding a shallow tree on one
feature's bins to that feature's lookup table; then round the pairs of features that explain most of what is
left, adding trees of one cut on either axis to the pair's table. A score is the logistic function of the sum of the looked-up values, so
texts are scored by adding arrays. Fitting uses a bounded sample of labelled rows on the driver; scoring runs in the tasks.
"""

from __future__ import annotations

import math
import operator
import string
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE

#: Labelled rows that are fitted at most: those with the smallest digests of their ids.
SAMPLE = 20_000
THRESHOLD = 0.3

FEATURES = (
    "log_words", "distinct_words", "distinct_pairs", "repeated_next", "word_length", "upper", "digits", "symbols", "bars",
    "exclamations", "stops", "distinct_lines", "line_words", "not_ascii",
)
_UPPER, _LETTERS, _DIGITS = string.ascii_uppercase.encode(), string.ascii_letters.encode(), string.digits.encode()
_SYMBOLS = b"#$%&*@^~`<>{}[]\\/_+="


def features(text: str | None) -> tuple[float, ...]:
    """The numbers of FEATURES; all 0 but for distinct shares (1) where there is nothing to count."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words, n = data.split(), max(len(data), 1)
    count, after = len(words), words[1:]
    some = max(count, 1)
    share = lambda chars, whole: (len(data) - len(data.translate(None, chars))) / whole
    letters = len(data) - len(data.translate(None, _LETTERS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (
        math.log1p(count),
        len(set(words)) / some if count else 1.0,
        len(set(zip(words, after))) / len(after) if after else 1.0,
        sum(map(operator.eq, words, after)) / some,
        sum(map(len, words)) / some,
        share(_UPPER, max(letters, 1)),
        share(_DIGITS, n),
        share(_SYMBOLS, n),
        data.count(b"|") / some,
        data.count(b"!") / some,
        (data.count(b".") + data.count(b"?")) / some,
        len(set(lines)) / len(lines) if lines else 1.0,
        count / max(len(lines), 1),
        (len(data) - len(text or "")) / n,
    )


@dataclass
class Model:
    """Bin edges and lookup tables; `pairs` by two feature numbers, on coarser bins."""

    base: float
    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[f], x[:, f], side="right")]
        for (f, g), table in self.pairs.items():
            total += table[np.searchsorted(self.coarse[f], x[:, f], side="right"), np.searchsorted(self.coarse[g], x[:, g], side="right")]
        return 1 / (1 + np.exp(-total))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins))


def _gain(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g * g / (h + ridge)


def _cut(g: np.ndarray, h: np.ndarray, low: int, high: int, ridge: float, least: float) -> tuple[float, int]:
    """The best cut of bins low to high: (gain, first bin of the right side); gain 0 if there is none."""
    if high - low < 2:
        return 0.0, low
    a, b = np.cumsum(g[low:high])[:-1], np.cumsum(h[low:high])[:-1]
    whole_g, whole_h = g[low:high].sum(), h[low:high].sum()
    gains = _gain(a, b, ridge) + _gain(whole_g - a, whole_h - b, ridge) - _gain(whole_g, whole_h, ridge)
    gains = np.where((b < least) | (whole_h - b < least), 0.0, gains)
    at = int(gains.argmax())
    return float(gains[at]), low + at + 1


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float, least: float) -> np.ndarray:
    """Values by bin of a tree that grows where the gain is largest."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        gain, at, part = max(((*_cut(g, h, *p, ridge, least), p) for p in parts), key=lambda c: c[0])
        if gain <= 0:
            break
        parts.remove(part)
        parts += [(part[0], at), (at, part[1])]
    values = np.zeros(len(g))
    for low, high in parts:
        values[low:high] = g[low:high].sum() / (h[low:high].sum() + ridge)
    return values


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best pair of cuts of a two-way histogram: (gain, values by bins)."""
    best, values = 0.0, np.zeros(g.shape)
    sums = [x.cumsum(0).cumsum(1) for x in (g, h)]
    for i in range(g.shape[0] - 1):
        for j in range(g.shape[1] - 1):
            quarters = []
            for s in sums:
                a, b, c, d = s[i, j], s[i, -1], s[-1, j], s[-1, -1]
                quarters.append(np.array([[a, b - a], [c - a, d - b - c + a]]))
            gain = float(_gain(*quarters, ridge).sum() - _gain(sums[0][-1, -1], sums[1][-1, -1], ridge))
            if gain > best:
                leaf = quarters[0] / (quarters[1] + ridge)
                best, values = gain, leaf[(np.arange(g.shape[0]) > i).astype(int)][:, (np.arange(g.shape[1]) > j).astype(int)]
    return best, values


def fit(
    x: np.ndarray, y: np.ndarray, bins: int = 32, coarse: int = 8, rounds: int = 120, leaves: int = 4, pairs: int = 4, pair_rounds: int = 30,
    rate: float = 0.1, ridge: float = 1.0, least: float = 1.0,
) -> Model:
    """Fit on rows of features and labels 0/1. No rows: every score is 1/2; one label only: scores lean to it."""
    k = x.shape[1]
    if not len(x):
        return Model(0.0, [np.empty(0)] * k, [np.empty(0)] * k, [np.zeros(1)] * k)
    mean = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(math.log(mean / (1 - mean)), [_edges(x[:, f], bins) for f in range(k)], [_edges(x[:, f], coarse) for f in range(k)], [])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    at = [np.searchsorted(model.edges[f], x[:, f], side="right") for f in range(k)]
    total = np.full(len(x), model.base)

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f in range(k):
            g, h = residual()
            sums = [np.bincount(at[f], w, minlength=len(model.tables[f])) for w in (g, h)]
            step = rate * _tree(*sums, leaves, ridge, least)
            model.tables[f] += step
            total += step[at[f]]
    near = [np.searchsorted(model.coarse[f], x[:, f], side="right") for f in range(k)]
    shape = lambda f, g: (len(model.coarse[f]) + 1, len(model.coarse[g]) + 1)

    def two_way(f: int, g: int) -> list[np.ndarray]:
        rows, cols = shape(f, g)
        return [np.bincount(near[f] * cols + near[g], w, minlength=rows * cols).reshape(rows, cols) for w in residual()]

    gains = sorted(((_quadrants(*two_way(f, g), ridge)[0], f, g) for f in range(k) for g in range(f + 1, k)), reverse=True)
    model.pairs = {(f, g): np.zeros(shape(f, g)) for gain, f, g in gains[:pairs] if gain > 0}
    for _ in range(pair_rounds):
        for f, g in model.pairs:
            step = rate * _quadrants(*two_way(f, g), ridge)[1]
            model.pairs[f, g] += step
            total += step[near[f], near[g]]
    return model


def held_out(id_col: str):
    """Rows whose labels are never learnt: the CRC-32 of the id as text is a multiple of 5. Null ids are not held out; they have no labels."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most `most` labelled rows that are not held out, by the digests of their ids.

    Null labels are left out; of several labels of an id the least counts. Only the chosen ids, a bounded table, are
    broadcast, and only features come to the driver.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    chosen = known.groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("__y")).orderBy(F.xxhash64("__id"), "__id").limit(most)
    rows = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("__id")).select(F.col("__id"), F.col("__y").cast("double").alias("__y"), F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                made = [list(map(float, features(t))) for t in part.column("__text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("__id"), part.column("__y"), pa.array(made, pa.list_(pa.float64()))], names=["__id", "__y", "x"])

    schema = T.StructType([rows.schema[0], rows.schema[1], T.StructField("x", T.ArrayType(T.DoubleType()))])
    found = rows.mapInArrow(run, schema).orderBy("__id", "x").limit(2 * most).collect()  # ids may repeat among the texts
    return np.array([r.x for r in found], dtype=float).reshape(-1, len(FEATURES)), np.array([r["__y"] for r in found], dtype=float)


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int = SAMPLE) -> Model:
    return fit(*training_rows(docs, labels, id_col, text_col, label_col, most))


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str, out: str = "score") -> DataFrame:
    """`keep` columns and the score of every row, 0 to 1; a null text is scored as an empty one.

    Only the text goes into the score. Repeated rows have equal scores; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                x = np.array([features(t) for t in part.column(len(keep)).to_pylist()], dtype=float)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(model.score(x))], names=[*keep, out])

    free = "__text"
    while free in keep:
        free += "_"
    rows = docs.select(*keep, F.col(text_col).cast("string").alias(free))
    return rows.mapInArrow(run, T.StructType([*(docs.schema[c] for c in keep), T.StructField(out, T.DoubleType())]))
