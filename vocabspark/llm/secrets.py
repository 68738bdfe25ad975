"""Secret scans: fixed patterns, and a battery of randomness tests for other strings.

Long strings of key characters, cut at base spans and at inner `=`, get an encoding by their characters (digits, hexadecimal,
letters of one case, base 32 and 36 in either case, letters and digits, base 64). Strings with `+`, `/`, `-` or `_` are tested whole, as base 64 may have
them, and so are the parts between them, as they may also be separators; both are reported where both pass. Against independent uniform symbols of that encoding the battery tests the symbols' chi-squared, the runs
about the middle symbol, and the lag-1 serial correlation; Fisher's rule combines the three. A high combined value means that the
string may well be random. Short ordinary strings pass by chance, so each string has a decoy of
its length and encoding made from ordinary characters around it, and in each stratum of encoding and length the cut is the lowest at which
decoys are at most `rate` of what passes: a false-discovery rate that is held at each length. The counts by stratum and
value are of a fixed size, whatever the corpus.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, map_rows

# The base patterns.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")

_ASSIGN = re.compile(ASSIGN, re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # the pattern's greedy runs of 20 characters and more
_HEX = re.compile(r"[0-9a-f]{24,}")
_LONG = re.compile(r"[A-Za-z0-9+/_-]{16,}=*")
#: What a string is tested as: whole, in either base 64, and between all separators.
_PARTS = tuple(re.compile(p) for p in (r"[A-Za-z0-9+/]{16,}=*", r"[A-Za-z0-9_-]{16,}=*", r"[A-Za-z0-9]{16,}=*"))
_ORDINARY = re.compile(r"[A-Za-z0-9]+")

_ALPHABETS = (
    ("digits", "0123456789"), ("hex", "0123456789abcdef"), ("hex", "0123456789ABCDEF"),
    ("letters", "abcdefghijklmnopqrstuvwxyz"), ("letters", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "abcdefghijklmnopqrstuvwxyz234567"), ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"), ("base36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("alnum", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
_TABLES = [(name, frozenset(chars), {c: i for i, c in enumerate(chars)}) for name, chars in _ALPHABETS]
BINS = 200


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds, by start, then kind."""
    spans = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(spans)


def infer(string: str) -> tuple[str, list[int], int] | None:
    """(encoding, symbols, size of the alphabet), padding left off; None where no alphabet has all characters."""
    core = string.rstrip("=")
    for name, chars, index in _TABLES:
        if chars.issuperset(core):
            return name, [index[c] for c in core], len(index)
    return None


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(symbols: list[int], size: int) -> float:
    """Combined probability that uniform independent symbols look as uneven as these; 0 for fewer than 8."""
    n = len(symbols)
    if n < 8:
        return 0.0
    x = np.array(symbols)
    counts = np.bincount(x, minlength=size)
    chi = float(((counts - n / size) ** 2).sum() * size / n)
    z = (chi - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n)
    p = [0.5 * math.erfc(z / math.sqrt(2))]
    high = x >= size // 2
    a = int(high.sum())
    b = n - a
    if a and b:
        runs, mean = 1 + int((high[1:] != high[:-1]).sum()), 1 + 2 * a * b / n
        spread = (mean - 1) * (mean - 2) / (n - 1)
        p.append(_two_sided((runs - mean) / math.sqrt(spread)) if spread > 0 else 1.0)
    else:
        p.append(2.0 ** (1 - n))
    d = x - x.mean()
    whole = float((d * d).sum())
    serial = float((d[1:] * d[:-1]).sum()) / whole if whole else 1.0
    p.append(_two_sided((serial + 1 / n) * math.sqrt(n)))
    half = -sum(math.log(max(q, 1e-300)) for q in p)
    return math.exp(-half) * (1 + half + half * half / 2)


def _strings(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The places of long strings and their parts outside the base spans, each once, by start, then end."""
    places, at = set(), 0
    for start, _, end in [*taken, (len(text), 3, len(text))]:
        for m in _LONG.finditer(text, at, max(at, start)):
            for part in _PARTS:
                places.update(x.span() for x in part.finditer(text, m.start(), m.end()))
        at = max(at, end)
    return sorted(places)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, str, float, float]]:
    """(start, end, stratum, value, decoy's value) of long strings and their parts outside the base spans."""
    found = []
    for start, end in _strings(text, taken):
        name, symbols, size = infer(text[start:end])
        n = len(symbols)
        window = text[max(0, start - 4 * n) : start] + " " + text[end : end + 4 * n]
        around = [ord(c) % size for c in "".join(_ORDINARY.findall(window))][:n]
        decoy = battery(around, size) if len(around) == n else 0.0
        found.append((start, end, f"{name}:{min(n, 128) // 8}", battery(symbols, size), decoy))
    return found


def _scan(text: str | None) -> tuple:
    text = text or ""
    base = base_spans(text)
    counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
    own = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
    more = candidates(text, base)
    columns = [list(c) for c in zip(*more)] if more else [[], [], [], [], []]
    return (*counts, hashlib.sha256(own.encode()).hexdigest(), [s for s, _, _ in base], [k for _, k, _ in base], [e for _, _, e in base], *columns)


_FIELDS = [
    ("n_assign", T.LongType()), ("n_access", T.LongType()), ("n_hex", T.LongType()), ("base_sha256", T.StringType()),
    ("__s", T.ArrayType(T.LongType())), ("__k", T.ArrayType(T.LongType())), ("__e", T.ArrayType(T.LongType())),
    ("__cs", T.ArrayType(T.LongType())), ("__ce", T.ArrayType(T.LongType())), ("__stratum", T.ArrayType(T.StringType())),
    ("__p", T.ArrayType(T.DoubleType())), ("__decoy", T.ArrayType(T.DoubleType())),
]


def cuts(found: DataFrame, rate: float) -> dict[str, float]:
    """The lowest value of each stratum from which on decoys are at most `rate` of the strings that pass."""
    pairs = found.select(F.explode(F.arrays_zip("__stratum", "__p", "__decoy")).alias("c")).select("c.*")
    bins = pairs.select(
        F.col("__stratum").alias("s"),
        F.explode(F.array(F.struct(F.lit(1).alias("t"), F.col("__p").alias("v")), F.struct(F.lit(0).alias("t"), F.col("__decoy").alias("v")))).alias("x"),
    ).groupBy("s", F.floor(F.col("x.v") * BINS).cast("int").alias("bin")).agg(F.sum("x.t").alias("t"), F.sum(1 - F.col("x.t")).alias("d"))
    by: dict[str, dict[int, tuple[int, int]]] = {}
    for r in bins.collect():  # at most strata x bins rows
        by.setdefault(r.s, {})[r.bin] = (r.t, r.d)
    out = {}
    for stratum, counts in by.items():
        t = d = 0
        for b in range(BINS, 0, -1):
            t, d = t + counts.get(b, (0, 0))[0], d + counts.get(b, (0, 0))[1]
            if t and d <= rate * t:
                out[stratum] = b / BINS
    return out


def scan(docs: DataFrame, id_col: str, text_col: str, rate: float = 0.05) -> DataFrame:
    """id_col, n_assign, n_access, n_hex, base_sha256, spans of every row; null texts count as empty.

    `spans` has the base kinds and `random`, as kind:start:end by start, then kind; code points, ends exclusive. Spans of
    `random` may lie in each other.
    Repeated rows have equal results; an empty table has an empty one; other columns are ignored. The scan is
    written once; only the counts by stratum come to the driver.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    found = cut_lineage(map_rows(rows, [id_col], lambda: _scan, _FIELDS))
    limit = cuts(found, rate)
    cut = F.create_map(*[F.lit(x) for pair in limit.items() for x in pair]) if limit else F.create_map().cast("map<string,double>")
    base = F.transform(F.arrays_zip("__s", "__k", "__e"), lambda x: F.struct(x["__s"].alias("s"), x["__k"].alias("k"), x["__e"].alias("e")))
    passed = F.filter(F.arrays_zip("__cs", "__ce", "__stratum", "__p"), lambda x: x["__p"] >= F.coalesce(F.element_at(cut, x["__stratum"]), F.lit(2.0)))
    more = F.transform(passed, lambda x: F.struct(x["__cs"].alias("s"), F.lit(3).cast("long").alias("k"), x["__ce"].alias("e")))
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.transform(F.array_sort(F.concat(base, more)), lambda x: F.concat_ws(":", F.element_at(names, (x["k"] + 1).cast("int")), x["s"], x["e"]))
    return found.select(id_col, "n_assign", "n_access", "n_hex", "base_sha256", F.concat_ws(",", spans).alias("spans"))


def redact(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str, mask: str = "[SECRET]") -> DataFrame:
    """`docs` (ids unique) with the spans of `scan` masked, overlapping ones as one; rows without spans stay as they are."""

    def start():
        def masked(text, listed):
            if text is None or not listed:
                return (text,)
            parts, at = [], 0
            for s, e in sorted(tuple(map(int, x.split(":")[1:])) for x in listed.split(",")):
                if e > at:
                    parts += [text[at:s], mask] if s >= at else []
                    at = e
            return ("".join([*parts, text[at:]]),)

        return masked

    named = spans.select(F.col(id_col).alias("__id"), F.col("spans").alias("__spans"))
    joined = docs.join(named, F.col(id_col) == F.col("__id"), "left").withColumnRenamed(text_col, "__old").drop("__id")
    keep = [c for c in docs.columns if c != text_col]
    return map_rows(joined, keep, start, [(text_col, T.StringType())]).select(*docs.columns)
