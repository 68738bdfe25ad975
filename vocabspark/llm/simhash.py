"""SimHash near-duplicates with pigeonring filtering.

A fingerprint is a ring of segments. With `tau` differing bits in all over m segments, some segment
starts a chain whose first l segments differ in at most floor(l * tau / m) bits, for every l. The chain's
opening, in which nothing may differ, is an exact key; where that key is too short, it is
lengthened by the next segments, in which up to two bits may differ: two values at most two bits apart
have a common neighbour one bit away, so each value is filed under itself and its neighbours.
Pairs that share a key are held against the whole chain's budgets, and only then is the full
Hamming distance checked.

Hot keys: where an exact opening is shared by very many fingerprints, and tau is at most 2, they are filed again under
the neighbours over the whole ring; at most 65 fingerprints can share one of these, so
the work is linear. For a larger tau they are dealt to pairs of blocks, one task each, which give links
that span what they join, never all pairs. Nothing is capped.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, map_rows
from .components import connected_components

#: Fingerprints that one task compares with each other at a time.
BLOCK = 1024
#: Shingles hashed at a time.
CHUNK = 50_000
#: Bits of a key at least, unless no longer key has few enough neighbours.
LEAST_BITS = 20


def _hashes(text: str | None, words: int, distinct: bool, least_chars: int, seed: int) -> np.ndarray:
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if least_chars:
        found = [w for w in found if len(w) >= least_chars] or found
    if not found:
        return np.empty(0, dtype="<u8")
    shingles = [b" ".join(found)] if len(found) < words else map(b" ".join, zip(*(found[i:] for i in range(words))))
    shingles = list(dict.fromkeys(shingles)) if distinct else list(shingles)
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype="<u8", count=len(shingles))


def _majority(hashes: np.ndarray) -> np.ndarray:
    """Eight bytes: a bit is 1 if set in over half the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little")


def fingerprint(text: str | None, words: int = 3, distinct: bool = False, seed: int = 42, least_chars: int = 0) -> int:
    """64-bit SimHash of a text's word shingles, as a signed integer. No words: 0.

    A-Z are lower-cased, words are separated by ASCII white space; a text of fewer words is one shingle. `least_chars`
    leaves out words of fewer bytes, unless all are.
    """
    return int(_majority(_hashes(text, words, distinct, least_chars, seed)).view("<i8")[0])


def long_fingerprint(text: str | None, words: int = 5, lanes: int = 4, seed: int = 42) -> bytes:
    """SimHash of 64 bits a lane over the distinct shingles; each lane mixes the shingles' hashes anew."""
    hashes, made = _hashes(text, words, True, 0, seed), []
    for lane in range(lanes):
        x = hashes + np.uint64(lane * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        made.append(_majority(x ^ (x >> np.uint64(31))))
    return np.concatenate(made).tobytes()


def most_apart(similarity: float, lanes: int) -> int:
    """The bits in which long fingerprints of sets of this Jaccard similarity differ: the mean and a standard deviation."""
    bits, share = 64 * lanes, math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return round(bits * share + math.sqrt(bits * share * (1 - share)))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = 3, distinct: bool = False, least_chars: int = 0, check_words: int = 0) -> DataFrame:
    """(id_col, node, fp, check): one row for each row of `docs`, null texts counting as empty.

    `check` is the long fingerprint of shingles of `check_words` words, empty where that is 0; `node` stands for both.
    """

    def start():
        return lambda text: (fingerprint(text, words, distinct, 42, least_chars), long_fingerprint(text, check_words) if check_words else b"")

    rows = docs.select(id_col, F.col(text_col).cast("string").alias("__text"))
    made = map_rows(rows, [id_col], start, [("fp", T.LongType()), ("check", T.BinaryType())])
    return made.withColumn("node", F.xxhash64("fp", "check") if check_words else F.col("fp"))


class Ring:
    """Bounds and budgets of the segments."""

    def __init__(self, tau: int, segments: int) -> None:
        self.tau, self.m = tau, segments
        self.bounds = [round(i * 64 / segments) for i in range(segments + 1)]
        self.budget = [length * tau // segments for length in range(segments + 1)]
        self.exact = max(n for n in range(1, segments + 1) if self.budget[n] == 0)
        self.near = max(n for n in range(1, segments + 1) if self.budget[n] <= 2)

    def bits(self, start: int, length: int) -> int:
        return sum(self.bounds[(start + i) % self.m + 1] - self.bounds[(start + i) % self.m] for i in range(length))

    def turned(self, fp: Column, start: int) -> Column:
        """The ring turned so that segment `start` comes first, at the low bits."""
        at = self.bounds[start]
        return fp if at == 0 else F.shiftrightunsigned(fp, at).bitwiseOR(F.shiftleft(fp, 64 - at))

    def key(self, fp: Column, start: int, length: int) -> Column:
        bits = self.bits(start, length)
        turned = self.turned(fp, start)
        return turned if bits == 64 else turned.bitwiseAND(F.lit((1 << bits) - 1))

    def exact_keys(self, fp: Column) -> Column:
        return F.array(*[F.struct(F.lit(i).alias("i"), self.key(fp, i, self.exact).alias("key")) for i in range(self.m)])

    def near_keys(self, fp: Column, length: int) -> Column:
        """Under each start the chain's bits, and these with one bit flipped beyond the exact opening.

        The flips are an array that one function goes over: a column for each of them, hundreds in all, is a plan that the
        driver takes hundreds of megabytes to make and compile.
        """
        made = []
        for i in range(self.m):
            key, low, high = self.key(fp, i, length), self.bits(i, self.exact), self.bits(i, length)
            flips = F.array(*(F.lit(x).cast("long") for x in [0, *((1 << b) - (1 << 64 if b == 63 else 0) for b in range(low, high))]))
            made.append(F.transform(flips, lambda flip: F.struct(F.lit(i).alias("i"), key.bitwiseXOR(flip).alias("key"))))  # noqa: B023
        return F.flatten(F.array(*made))


def _viable(ring: Ring, x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which differences `x` keep to every budget of the chain that starts at `start`, the last being tau."""
    ok = np.ones(len(x), dtype=bool)
    for s in range(ring.m):
        own = np.flatnonzero(start == s)
        if not len(own):
            continue
        at = np.uint64(ring.bounds[s])
        turned = x[own] if s == 0 else (x[own] >> at) | (x[own] << np.uint64(64 - int(at)))
        left = np.arange(len(own))
        for length in range(ring.exact, ring.m + 1):
            bits = ring.bits(s, length)
            mask = np.uint64((1 << bits) - 1)
            passed = np.bitwise_count(turned[left] & mask) <= ring.budget[length]
            left = left[passed]
        keep = np.zeros(len(own), dtype=bool)
        keep[left] = True
        ok[own] = keep
    return ok


def _linked(ring: Ring, most: int, a: tuple, b: tuple, start: np.ndarray) -> np.ndarray:
    """Which pairs of members (node, fp, check) keep to the chain's budgets, and to `most` bits in the long fingerprint."""
    ok = _viable(ring, a[1] ^ b[1], start)
    if a[2].shape[1]:
        some = np.flatnonzero(ok)
        ok[some] = np.bitwise_count(a[2][some] ^ b[2][some]).sum(axis=1, dtype=np.int64) <= most
    return ok


def _spanning(ring: Ring, most: int, members: tuple, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the links among the members join: each to its part's least member."""
    node, fp, check = members
    n, label = len(fp), np.arange(len(fp))
    rows, cols = [], []
    for at in range(0, n, 128):
        r, c = np.nonzero(np.bitwise_count(fp[at : at + 128, None] ^ fp[None, :]) <= ring.tau)
        r = r + at
        r, c = r[c > r], c[c > r]
        ok = _linked(ring, most, (node[r], fp[r], check[r]), (node[c], fp[c], check[c]), np.full(len(r), start))
        rows.append(r[ok])
        cols.append(c[ok])
    r, c = np.concatenate(rows), np.concatenate(cols)
    while True:
        low = np.minimum(label[r], label[c])
        new = label.copy()
        np.minimum.at(new, r, low)
        np.minimum.at(new, c, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(n))
    return node[moved], node[label[moved]]


def _checks(column) -> np.ndarray:
    """Long fingerprints as a row of 64-bit words each; no columns where there are none."""
    values = column.to_pylist()
    width = len(values[0]) // 8 if values else 0
    return np.frombuffer(b"".join(values), dtype="<u8").reshape(len(values), width)


def _bucket_links(ring: Ring, most: int):
    """For batches of (i, members): links (u, v)."""

    def links(batches):
        for batch in batches:
            starts = batch.column("i").to_numpy(zero_copy_only=False)
            lists = batch.column("members")
            flat = lists.flatten()
            node, fp = (flat.field(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in ("node", "fp"))
            check = _checks(flat.field("check"))
            offsets = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            sizes = np.diff(offsets)
            u, v = [], []
            for n in range(2, 9):  # small buckets: all of a size at once
                own = np.flatnonzero(sizes == n)
                if len(own):
                    a, b = np.triu_indices(n, 1)
                    x, y = ((offsets[own][:, None] + k).ravel() for k in (a, b))
                    ok = _linked(ring, most, (node[x], fp[x], check[x]), (node[y], fp[y], check[y]), np.repeat(starts[own], len(a)))
                    u.append(node[x[ok]])
                    v.append(node[y[ok]])
            for k in np.flatnonzero(sizes > 8):
                at = slice(offsets[k], offsets[k + 1])
                x, y = _spanning(ring, most, (node[at], fp[at], check[at]), int(starts[k]))
                u.append(x)
                v.append(y)
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z).view(np.int64)) for z in (u, v)], names=["u", "v"])

    return links


def _tile_links(ring: Ring, most: int):
    """For the two blocks of one tile: links (u, v)."""

    def links(key, group):
        members = (*(group.column(k).to_numpy().view(np.uint64) for k in ("node", "fp")), _checks(group.column("check")))
        u, v = _spanning(ring, most, members, key[0].as_py())
        return pa.table({"u": pa.array(u.view(np.int64)), "v": pa.array(v.view(np.int64))})

    return links


def near_links(nodes: DataFrame, tau: int = 2, segments: int = 7, most: int = 0) -> DataFrame:
    """(u, v): links between the distinct `nodes` (node, fp, check) whose fp are at most `tau` bits apart.

    Where there are long fingerprints, these must also be at most `most` bits apart. The links join
    exactly those nodes that all such pairs join; within larger buckets they span them. The exact openings are the keys
    while they have as many bits as the number of nodes, so that unrelated nodes seldom share one; else the lengthened ones.
    """
    ring = Ring(tau, segments)
    exact = ring.bits(0, ring.exact) >= max(LEAST_BITS, nodes.count().bit_length())
    keys = ring.exact_keys(F.col("fp")) if exact else ring.near_keys(F.col("fp"), ring.near)
    keyed = nodes.select("node", F.explode(keys).alias("k")).select("k.i", "k.key", "node")
    sizes = keyed.groupBy("i", "key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = cut_lineage(keyed.join(sizes, ["i", "key"]).join(nodes, "node"))
    member = F.struct("node", "fp", "check")
    lists = lambda df: df.groupBy("i", "key").agg(F.collect_list(member).alias("members")).filter("size(members) > 1").select("i", "members")
    links = lists(shared.filter(F.col("n") <= BLOCK)).mapInArrow(_bucket_links(ring, most), "u long, v long")
    hot = shared.filter(F.col("n") > BLOCK)
    if exact and tau <= 2:
        hubs = hot.select("node", "fp", "check", F.col("i").alias("j"), F.explode(ring.near_keys(F.col("fp"), ring.m)).alias("k")).filter("k.i = j")
        more = lists(hubs.select("k.i", "k.key", "node", "fp", "check")).mapInArrow(_bucket_links(ring, most), "u long, v long")
    else:
        placed = hot.withColumn("b", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("b")).cast("int"))
        spread = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
        tiles = spread.select("i", "key", F.least("own", "o").alias("p"), F.greatest("own", "o").alias("q"), "node", "fp", "check")
        more = tiles.groupBy("i", "key", "p", "q").applyInArrow(_tile_links(ring, most), "u long, v long")
    return links.unionByName(more).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str, text_col: str, words: int = 3, distinct: bool = False, tau: int = 2, segments: int = 7,
    least_chars: int = 0, check_words: int = 0, similarity: float = 0.8,
) -> DataFrame:
    """(id_col, fingerprint, component_id): near-duplicate classes of all rows of `docs`.

    Fingerprints of the shingles of `words` words link at `tau` or fewer differing bits; with `check_words`, the long
    fingerprints of shingles of that many words must also be as close as those of sets of this similarity are.
    component_id is the smallest id among the documents that links reach; null ids
    have a fingerprint and a component but never name one. Rows without words have the fingerprint zero
    and are linked like any other. Repeated rows are kept, each with its class. An empty table gives an
    empty result. Other columns of `docs` are ignored.
    """
    marks = cut_lineage(fingerprints(docs, id_col, text_col, words, distinct, least_chars, check_words))
    nodes = marks.groupBy("node", "fp", "check").agg(F.min(id_col).alias("least"))
    links = near_links(nodes.select("node", "fp", "check"), tau, segments, most_apart(similarity, 4))
    roots = connected_components(links).withColumnRenamed("node", "__node")
    labelled = nodes.join(roots, F.col("node") == F.col("__node"), "left").select("node", F.coalesce("root", "node").alias("label"), "least")
    names = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = labelled.select("node", "label").join(names, "label").select("node", "component_id")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return marks.join(classes, "node").select(id_col, text, "component_id")
