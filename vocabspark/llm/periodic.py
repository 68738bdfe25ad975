"""Periodic runs of words, found with a suffix automaton and a link-cut forest over its suffix links.

The forest's solid paths are the stretches of suffix lengths that last ended at the same place. When a word is appended, the
access of its prefix's state walks over the segments of its root path, each with the end `e` of its last occurrence
and the length of its longest suffix, and colours them all with the new end `i`. A suffix at least as long as i - e
that stands at both ends is a square of period i - e. A run's first square shows at its own end with the run's smallest
period, as no nearer occurrence of a primitive root can exist, and is then extended to the run; later squares of a run
are known from its end.

Before that, stretches of a text in which no run can lie are left out: in a run of `least` words or more, every word is in a
group of `least // 2` words that comes again within the run, at most half the run away.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows

_FACTOR = 0x9E3779B97F4A7C15


class Automaton:
    """Suffix automaton of a sequence of numbers >= 0. A state's first transition is held apart, most have no other."""

    def __init__(self, sequence: list[int]) -> None:
        self.length, self.link = [0], [-1]
        self._word, self._to, self._more = [-1], [-1], {}
        #: The state of each prefix.
        self.prefix: list[int] = []
        last = 0
        for word in sequence:
            last = self._append(last, word)
            self.prefix.append(last)

    def _state(self, length: int, word: int = -1, to: int = -1) -> int:
        self.length.append(length)
        self.link.append(0)
        self._word.append(word)
        self._to.append(to)
        return len(self.length) - 1

    def _append(self, last: int, word: int) -> int:
        length, link, words, to, more = self.length, self.link, self._word, self._to, self._more
        new, p, q = self._state(length[last] + 1), last, -1
        while p >= 0:
            if words[p] == word:
                q = to[p]
                break
            if words[p] < 0:
                words[p], to[p] = word, new
            else:
                others = more.setdefault(p, {})
                if word in others:
                    q = others[word]
                    break
                others[word] = new
            p = link[p]
        if q < 0:
            return new
        if length[q] == length[p] + 1:
            link[new] = q
            return new
        twin = self._state(length[p] + 1, words[q], to[q])
        if q in more:
            more[twin] = dict(more[q])
        link[twin], link[q], link[new] = link[q], twin, twin
        while p >= 0:
            if words[p] == word:
                if to[p] != q:
                    break
                to[p] = twin
            elif more.get(p, {}).get(word) == q:
                more[p][word] = twin
            else:
                break
            p = link[p]
        return new


class LinkCut:
    """Solid paths of a forest, each a splay tree by depth; a path's colour is kept at its tree's root."""

    def __init__(self, parent: list[int]) -> None:
        self.up = parent
        n = len(parent)
        self.left, self.right, self.colour = [-1] * n, [-1] * n, [-1] * n

    def _splay(self, x: int) -> None:
        up, left, right, colour = self.up, self.left, self.right, self.colour
        while True:
            y = up[x]
            if y < 0 or (left[y] != x and right[y] != x):
                return
            z = up[y]
            inner = z >= 0 and (left[z] == y or right[z] == y)
            if inner and (left[y] == x) == (left[z] == y):
                self._turn(y)
            elif inner:
                self._turn(x)
            else:
                colour[x] = colour[y]
            self._turn(x)
            if inner and ((w := up[x]) < 0 or (left[w] != x and right[w] != x)):
                colour[x] = colour[z]

    def _turn(self, x: int) -> None:
        """Rotate x above its parent in the splay tree."""
        up, left, right = self.up, self.left, self.right
        y = up[x]
        z = up[y]
        if z >= 0:
            if left[z] == y:
                left[z] = x
            elif right[z] == y:
                right[z] = x
        if left[y] == x:
            child, left[y], right[x] = right[x], right[x], y
        else:
            child, right[y], left[x] = left[x], left[x], y
        if child >= 0:
            up[child] = y
        up[y], up[x] = x, z

    def access(self, x: int, colour: int) -> list[tuple[int, int]]:
        """Make the path from `x` to its root one path of this colour; (old colour, deepest node) of the segments it had, from below."""
        up, right, colours, met, below = self.up, self.right, self.colour, [], -1
        while x >= 0:
            self._splay(x)
            if right[x] >= 0:
                colours[right[x]] = colours[x]
            if colours[x] >= 0:
                met.append((colours[x], x))
            right[x] = below
            below, x = x, up[x]
        colours[below] = colour
        return met


def _agreement(sequence: np.ndarray, at: int, period: int) -> int:
    """The first place from `at` on whose word differs from that a period before."""
    step = 16
    while at < len(sequence):
        apart = np.flatnonzero(sequence[at : at + step] != sequence[at - period : at - period + len(sequence[at : at + step])])
        if len(apart):
            return at + int(apart[0])
        at, step = at + step, 2 * step
    return len(sequence)


def runs_in(sequence: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs with length >= max(least, 2 * period), by start and period."""
    automaton = Automaton(sequence.tolist())
    # The root, whose suffix is empty, stays out: its children are roots of the forest.
    forest, lengths = LinkCut([x if x > 0 else -1 for x in automaton.link]), automaton.length
    ends: dict[int, int] = {}  # of the last run of each period
    found = []
    for i, state in enumerate(automaton.prefix):
        for end, node in forest.access(state, i):
            period = i - end
            if period <= lengths[node] and ends.get(period, 0) <= i:
                start, ends[period] = i - 2 * period + 1, _agreement(sequence, i + 1, period)
                while start > 0 and sequence[start - 1] == sequence[start - 1 + period]:
                    start -= 1
                if ends[period] - start >= max(least, 2 * period):
                    found.append((start, ends[period] - start, period))
    return sorted((s, n, p) for s, n, p in found)


def stretches(sequence: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(begin, end) of stretches that hold all runs of `least` words or more, apart from each other."""
    n, group = len(sequence), max(1, least // 2)
    if n < max(2, least):
        return []
    marks = np.zeros(n - group + 1, dtype=np.uint64)
    for j in range(group):
        marks = marks * np.uint64(_FACTOR) + sequence[j : n - group + 1 + j].astype(np.uint64) + np.uint64(1)
    order = np.argsort(marks, kind="stable")
    again = np.flatnonzero(marks[order[1:]] == marks[order[:-1]])
    if not len(again):
        return []
    one, two = order[again], order[again + 1]  # neighbours among equal groups, two after one
    near = np.full(len(marks), n)
    near[one] = two - one
    near[two] = np.minimum(near[two], two - one)
    places = np.flatnonzero(near < n)
    while len(places):
        first = np.flatnonzero(np.diff(places, prepend=-n) > group)
        begin, end = places[first], places[np.append(first[1:], len(places)) - 1] + group
        size = np.repeat(end - begin, np.diff(np.append(first, len(places))))
        keep = (2 * near[places] <= size) & (size >= least)
        if keep.all():
            return list(zip(begin.tolist(), end.tolist()))
        places = places[keep]
    return []


def numbered(words: list[bytes]) -> np.ndarray:
    """Words as numbers, equal words as equal ones."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))


def find_runs(words: list[bytes], least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a text's words: stretches with smallest period `period` and at least `least`
    words and two periods, that no neighbouring word extends; by start and period."""
    sequence = numbered(words)
    return [(begin + s, n, p) for begin, end in stretches(sequence, least) for s, n, p in runs_in(sequence[begin:end], least)]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words less those that some run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [w for w, k in zip(words, keep.tolist()) if k]


def detect(docs: DataFrame, id_col: str, text_col: str, least: int = 12, prepare: Callable[[list[bytes], Any], list[bytes]] | None = None, by: Column | None = None) -> DataFrame:
    """(id_col, runs, text): the periodic runs of each text's words and the text with each run cut to its first period.

    Words are separated by ASCII white space; runs are structs of start (word number), length and period, by start and
    period; `text` has the words left, one space apart. `prepare(words, value of by)` may give other words first. Null and
    empty texts have no run and an empty text; null and repeated ids each keep their row. A text is worked on whole, in memory that grows with it. An
    empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"), (F.lit(None) if by is None else by).alias("__by"))

    def start():
        def one(text, value):
            words = (text or "").encode().split()
            words = prepare(words, value) if prepare else words
            runs = find_runs(words, least)
            return *([r[i] for r in runs] for i in range(3)), b" ".join(collapsed(words, runs)).decode()

        return one

    longs = T.ArrayType(T.LongType())
    made = map_rows(rows, ["__id"], start, [("start", longs), ("length", longs), ("period", longs), ("__left", T.StringType())])
    return made.select(F.col("__id").alias(id_col), F.arrays_zip("start", "length", "period").alias("runs"), F.col("__left").alias("text"))


def digests(found: DataFrame, id_col: str) -> DataFrame:
    """One row a text of `detect`: number of runs, the longest (smallest start, then period, at equal length), and digests of the runs and the text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    best = found.withColumn("__best", longest)
    length, period = F.col("__best.length"), -F.col("__best.short")
    return best.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), (-F.col("__best.back")).alias("start"), length.alias("length"), period.alias("period"),
        F.expr("(1000 * __best.length) div (-__best.short)").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("runs", line)).cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    )
