"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text has, for every n, the sum of its first n code points, each times a power of the base, modulo a
prime. Two such arrays with primes near 2^31 give the hash of any span by one difference, so any
two spans can be held equal, and the longest common extension of two positions is found by binary search. A
fingerprint is made of hashes of whole prefixes and whole suffixes at steps of a power of two, some tens each, with the
length and the hash of all, and of the spans between cuts that the text itself sets (where the hash of the eight code points before has enough
zeros), which cover all of it. The likeness of two texts is found on these alone: binary search for the longest common prefix, then for the longest
common suffix of the rest, or the spans that both have, whichever is the larger share of the longer text; so agreement is taken up again after
each difference.
"""

from __future__ import annotations

import hashlib
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE

PRIMES = (2147483647, 2147483629)
BASES = (1000003, 69069069)
#: The bases, then their inverses.
_FACTORS = [*BASES, *(pow(b, -1, p) for b, p in zip(BASES, PRIMES))]
#: Code points that decide on a cut, and the length of a span, about, at least.
WINDOW, SPAN = 8, 16
_SPAN = np.dtype([("length", ">u4"), ("level", "u1"), ("h0", ">u4"), ("h1", ">u4")])
#: Steps of a fingerprint at least and twice as many at most, unless the text is shorter.
STEPS = 32

_powers = [np.ones(1, dtype=np.uint64) for _ in _FACTORS]


def powers(k: int, n: int) -> np.ndarray:
    """The first n powers of factor k, by doubling; kept for the next text."""
    while len(_powers[k]) < n:
        have, p = _powers[k], np.uint64(PRIMES[k % 2])
        top = np.uint64(int(have[-1]) * _FACTORS[k] % PRIMES[k % 2])
        _powers[k] = np.concatenate([have, have * top % p])
    return _powers[k][:n]


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


class Prefixes:
    """The prefix arrays of a text."""

    def __init__(self, points: np.ndarray, begun: list[np.ndarray] | None = None) -> None:
        """`begun`: prefix arrays of another text with which this one starts, to be continued."""
        self.n, self.sums = len(points), []
        for k, prime in enumerate(PRIMES):
            p, have = np.uint64(prime), np.zeros(1, dtype=np.uint64) if begun is None else begun[k]
            done = len(have) - 1
            more = (points[done:] + np.uint64(1)) * powers(k, self.n)[done:] % p
            more = (np.cumsum(more, dtype=np.uint64) + have[-1]) % p  # below 2^31 terms of below 2^31
            self.sums.append(np.concatenate([have, more]))

    def span(self, i: int, j: int) -> tuple[int, ...]:
        """The hash of code points i to j, times the base to the power i."""
        return tuple((int(s[j]) - int(s[i])) % p for s, p in zip(self.sums, PRIMES))

    def equal(self, i: int, other: Prefixes, j: int, length: int) -> bool:
        """Whether the spans of this length at i here and at j there are equal, up to a collision."""
        if i + length > self.n or j + length > other.n:
            return False
        low, high = (self, i, other, j) if i <= j else (other, j, self, i), abs(i - j)
        a, at, b, bt = low
        return all(
            (int(s[at + length]) - int(s[at])) * pow(base, high, p) % p == (int(t[bt + length]) - int(t[bt])) % p
            for s, t, base, p in zip(a.sums, b.sums, BASES, PRIMES)
        )

    def extension(self, i: int, other: Prefixes, j: int) -> int:
        """The length of the longest equal spans that start at i here and at j there."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.equal(i, other, j, middle) else (low, middle - 1)
        return low

    def fingerprint(self) -> str:
        """Hexadecimal: length, hash of all, then a mixed hash of each step's prefix and of each step's suffix."""
        step = step_of(self.n)
        at = np.arange(step, self.n, step)
        ahead = (self.sums[0][at] << np.uint64(31)) ^ self.sums[1][at]
        behind = np.zeros(len(at), dtype=np.uint64)
        for k, prime in enumerate(PRIMES):  # a suffix's hash, free of its place: times the base to minus its start
            p, s = np.uint64(prime), self.sums[k]
            back = np.uint64(pow(pow(BASES[k], self.n, prime), -1, prime))
            free = (s[self.n] + p - s[self.n - at]) % p * (powers(k, self.n)[at] * back % p) % p
            behind ^= free << np.uint64(31 * (1 - k))
        mixed = [((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(">u4").tobytes() for x in (ahead, behind)]
        return (struct.pack(">QII", self.n, int(self.sums[0][-1]), int(self.sums[1][-1])) + mixed[0] + mixed[1] + self.own_spans(max(step, SPAN)).tobytes()).hex()

    def free(self, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """The hashes of spans, free of their places."""
        out = []
        for k, prime in enumerate(PRIMES):
            p, s = np.uint64(prime), self.sums[k]
            out.append((s[ends] + p - s[starts]) % p * powers(2 + k, self.n + 1)[starts] % p)
        return out

    def own_spans(self, step: int) -> np.ndarray:
        """The spans between the text's own cuts, about `step` long each and a quarter of it at least; a span's level is that of its end."""
        if not self.n:
            return np.empty(0, dtype=_SPAN)
        ends = np.arange(min(WINDOW, self.n), self.n, dtype=np.int64)
        x = self.free(ends - min(WINDOW, self.n), ends)
        mixed = ((x[0] << np.uint64(31)) ^ x[1]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
        some = np.flatnonzero(mixed & np.uint64(step - 1) == 0)
        cuts, levels, least = [0], [], max(1, step // 4)
        for at, m in zip(ends[some].tolist(), mixed[some].tolist()):
            if at - cuts[-1] >= least:
                cuts.append(at)
                levels.append((m & -m).bit_length() if m else 33)
        cuts, made = np.array([*cuts, self.n]), np.empty(len(cuts), dtype=_SPAN)
        made["length"], made["level"] = np.diff(cuts), [*levels, 255]
        made["h0"], made["h1"] = self.free(cuts[:-1], cuts[1:])
        return made


def step_of(n: int) -> int:
    return 1 << max(0, (max(n, 1) // STEPS).bit_length() - 1)


def _longest(a: np.ndarray, b: np.ndarray) -> int:
    """How many steps agree from the first on, by binary search: where a longer prefix is equal, so is a shorter."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[middle - 1] == b[middle - 1] else (low, middle - 1)
    return low


def _coarser(spans: np.ndarray, step: int) -> Counter:
    """Spans joined where their ends are no cuts for `step`, as (hashes, length) with the number of each.

    The hash of two spans in a row is that of the first and, moved by its length, that of the second.
    """
    out, held, length = Counter(), [0, 0], 0
    for n, level, *hashes in spans.tolist():
        held = [(h + x * pow(b, length, p)) % p for h, x, b, p in zip(held, hashes, BASES, PRIMES)]
        length += n
        if level >= step.bit_length():
            out[(*held, length)] += 1
            held, length = [0, 0], 0
    return out


def likeness(one: str, two: str) -> float:
    """0 to 1, from two fingerprints: the share of the longer text in the common prefix and, after it, suffix, or in spans of both; 1 if equal."""
    if one == two:
        return 1.0
    parts, lengths, own = [], [], []
    for fingerprint in (one, two):
        raw = bytes.fromhex(fingerprint)
        n = struct.unpack(">Q", raw[:8])[0]
        at = 16 + 8 * len(range(step_of(n), n, step_of(n)))
        lengths.append(n)
        parts.append(np.frombuffer(raw[16:at], dtype=">u4").reshape(2, -1))
        own.append(np.frombuffer(raw[at:], dtype=_SPAN))
    steps = [step_of(n) for n in lengths]
    step = max(steps)
    grids = [p[:, step // s - 1 :: step // s] for p, s in zip(parts, steps)]
    longest = max(lengths)
    ahead = _longest(grids[0][0], grids[1][0]) * step
    behind = _longest(grids[0][1], grids[1][1]) * step
    both = _coarser(own[0], max(step, SPAN)) & _coarser(own[1], max(step, SPAN))
    shared = sum(span[2] * n for span, n in both.items())
    return min(max(ahead + behind, shared), min(lengths)) / longest if longest else 1.0


_COLUMNS = [("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()), ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType())]


def _deal(bounds: list[int]):
    """For batches of (id, key, text): each row with its range; a row at the beginning of a range also as a guest of the range before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.array(bounds, dtype=np.int64)
        for batch in batches:
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            at = np.searchsorted(marks, keys, side="right") - 1
            first = np.flatnonzero(marks[at] == keys)
            for rows, place, guest in ((batch, at, False), (batch.take(pa.array(first)), (at[first] - 1) % len(marks), True)):
                if rows.num_rows:
                    more = [pa.array(place, pa.int32()), pa.array([guest] * rows.num_rows, pa.bool_())]
                    yield pa.RecordBatch.from_arrays([*rows.columns, *more], names=[*batch.schema.names, "__range", "__guest"])

    return run


def _edited(own: tuple, following: str) -> tuple:
    text, points, prefixes = own
    cut = len(points) // 4
    keep = len(points) - cut
    made = Prefixes(np.concatenate([points[:keep], codes(following[:cut])]), [s[: keep + 1] for s in prefixes.sums])
    return hashlib.sha256((text[:keep] + following[:cut]).encode("utf-8", "surrogatepass")).hexdigest(), made.fingerprint()


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the rows of each range in order, then its guest: each row against the one that follows."""
    held = None  # range, whether a guest, id, fingerprint, (text, code points, prefix arrays)
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            rows = []
            for name, _, text, place, guest in zip(*(c.to_pylist() for c in batch.slice(at, SLICE).columns)):
                points = codes(text)
                prefixes = Prefixes(points)
                now = (place, guest, name, prefixes.fingerprint(), (text, points, prefixes))
                if held is not None and held[0] == place and not held[1]:
                    digest, edited = _edited(held[4], text)
                    rows.append((held[2], len(held[4][1]), digest, held[3], edited, likeness(held[3], edited), likeness(held[3], now[3])))
                held = now
            if rows:
                kinds = [batch.schema.field(0).type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), kinds)], names=[batch.schema.names[0], *[n for n, _ in _COLUMNS]])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, parts: int | None = None) -> DataFrame:
    """Per row: id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Rows are in ascending order of the integer id (null first, equal ids by text); the row after the last is the first. The
    edited text has its last quarter replaced by the beginning of the next row's text, as far as there is one. Null
    texts count as empty; two empty texts are alike (1). A single row follows itself. An empty table gives an empty result; other
    columns are ignored.

    The rows are dealt once, by ranges of the id that begin at ids found as quantiles; the first row of a
    range also goes to the range before. So the texts are shuffled once, and a task holds a text and its follower at a time.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    plain = docs.select(F.col(id_col), key.alias("__key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    shares = [i / (4 * parts) for i in range(4 * parts)]
    low, cuts = plain.agg(F.min("__key"), F.percentile_approx("__key", shares, 40 * parts)).first()
    own = docs.schema[id_col]
    bounds = sorted({low, *cuts}) if low is not None else [0]
    dealt = plain.mapInArrow(_deal(bounds), T.StructType([own, T.StructField("__key", T.LongType()), T.StructField("__text", T.StringType()), T.StructField("__range", T.IntegerType()), T.StructField("__guest", T.BooleanType())]))
    ordered = dealt.repartition(parts, "__range").sortWithinPartitions("__range", "__guest", "__key", "__text")
    return ordered.mapInArrow(_compare, T.StructType([own, *[T.StructField(n, t) for n, t in _COLUMNS]]))
