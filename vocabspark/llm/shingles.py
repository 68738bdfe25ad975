"""Near-duplicates by the exact Jaccard similarity of word shingles.

Keys of MinHash bands propose the pairs: a band of five 64-bit values is shared by unrelated texts practically never, however many there
are, and by sets of similarity 0.8 in one of the 24 bands with probability 0.99993. Every link is held against the
sets themselves. Of keys with the same members one stands for all. The members of a key are first compared with a hub, in
`ROUNDS` rounds; what these links join needs no more comparing. Keys whose members are not all joined then are cut into
tiles of two blocks, and each tile's sets are compared by products of matrices, which give links that span what
they join. No pair of members is ever a row, and nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, discard, map_rows
from .components import connected_components
from .simhash import _hashes

BANDS, ROWS = 24, 5
#: Rounds with hubs.
ROUNDS = 2
#: Members of a tile's block, bytes of their sets, and shingles that are compared at a time.
BLOCK, BYTES, SHINGLES = 512, 4 << 20, 1024
#: Pairs of sets that a Python worker gets at a time: sets of long texts are large.
PAIRS = 128
#: Shingles that are mixed at a time.
CHUNK = 512

_rng = np.random.default_rng(42)
_FACTORS = _rng.integers(0, 1 << 64, size=(BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)
_OFFSETS = _rng.integers(0, 1 << 64, size=(BANDS * ROWS, 1), dtype=np.uint64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes; a text of fewer words is one shingle, one of none has none."""
    return np.unique(_hashes(text, words, True, 0, 42))


def band_keys(hashes: np.ndarray) -> list[int]:
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for at in range(0, len(hashes), CHUNK):
        least = np.minimum(least, (hashes[None, at : at + CHUNK] * _FACTORS + _OFFSETS).min(axis=1))
    return [_signed(xxhash.xxh64_intdigest(band.tobytes(), i)) for i, band in enumerate(least.reshape(BANDS, ROWS))]


def _alike(similarity: float):
    """For batches of (u, v, own, other): the links whose sets have this Jaccard similarity or more."""

    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(s.as_buffer(), dtype="<u8") for s in (a, b))
                both = len(x) + len(y) - len(np.union1d(x, y)) if min(len(x), len(y)) >= similarity * max(len(x), len(y)) else 0
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays(list(batch.select([0, 1]).filter(pa.array(keep, pa.bool_())).columns), names=["u", "v"])

    return run


@contextmanager
def _small_batches(spark) -> Iterator[None]:
    """What runs inside hands `PAIRS` rows at a time to Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(PAIRS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _held(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    own = sets.select(F.col("node").alias("u"), F.col("hashes").alias("own"))
    other = sets.select(F.col("node").alias("v"), F.col("hashes").alias("other"))
    with _small_batches(pairs.sparkSession):
        return cut_lineage(pairs.join(own, "u").join(other, "v").select("u", "v", "own", "other").mapInArrow(_alike(similarity), "u long, v long"))


def _tile_links(similarity: float):
    """For the members (node, label, hashes) of one tile: links (u, v) between labels, that span what all links of the tile join."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        node = group.column("node").to_numpy()
        _, label = np.unique(group.column("label").to_numpy(), return_inverse=True)
        sets = [np.frombuffer(s.as_buffer(), dtype="<u8") for s in group.column("hashes")]
        size = np.array([len(s) for s in sets])
        _, shingle, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count > 1
        place, owner = np.cumsum(shared)[shingle] - 1, np.repeat(np.arange(len(sets)), size)
        place, owner = place[shared[shingle]], owner[shared[shingle]]
        order = np.argsort(place, kind="stable")
        place, owner, both = place[order], owner[order], np.zeros((len(sets), len(sets)), dtype=np.float32)
        for at in range(0, int(shared.sum()), SHINGLES):
            own = slice(*np.searchsorted(place, [at, at + SHINGLES]))
            marks = np.zeros((len(sets), SHINGLES), dtype=np.float32)
            marks[owner[own], place[own] - at] = 1
            both += marks @ marks.T
        u, v = np.nonzero((both >= similarity * (size[:, None] + size[None, :] - both) - 1e-4) & (label[:, None] < label[None, :]))
        exact = both[u, v].astype(np.float64)
        held = exact >= similarity * (size[u] + size[v] - exact) - 1e-9
        links, root = [], list(range(label.max() + 1))

        def top(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for a, b in zip(u[held].tolist(), v[held].tolist()):
            x, y = top(label[a]), top(label[b])
            if x != y:
                root[x] = y
                links.append((a, b))
        a, b = (node[[pair[i] for pair in links]] if links else node[:0] for i in range(2))
        return pa.table({"u": pa.array(np.minimum(a, b)), "v": pa.array(np.maximum(a, b))})

    return run


def near_links(nodes: DataFrame, sets_of, similarity: float) -> DataFrame:
    """(u, v): links of this similarity that join what all such proposed pairs of `nodes` (node, keys) join.

    `sets_of` gives (node, hashes) for a table of nodes; it is called for those that share a key.
    """
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    marks = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"m{i}") for i in range(2)]
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), *marks).filter("n > 1").groupBy("n", "m0", "m1").agg(F.min("key").alias("key"))
    member = cut_lineage(keyed.join(shared.select("key"), "key").select("key", "node", F.col("node").alias("label")))
    sets, found = cut_lineage(sets_of(member.select("node").distinct())), []
    for turn in range(ROUNDS):
        hubs = member.groupBy("key").agg(F.min_by(F.struct("node", "label"), F.xxhash64("node", F.lit(turn))).alias("h"))
        apart = member.join(hubs, "key").filter(F.col("label") != F.col("h.label")).select("node", "label", F.col("h.node").alias("other"), F.col("h.label").alias("its"))
        pairs = cut_lineage(apart.select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v"), F.least("label", "its").alias("a"), F.greatest("label", "its").alias("b")).distinct())
        found.append(_held(pairs.select("u", "v"), sets, similarity))
        edges = cut_lineage(pairs.join(found[-1], ["u", "v"]).select(F.col("a").alias("u"), F.col("b").alias("v")))
        roots = connected_components(edges).select(F.col("node").alias("__label"), "root")
        named = member.join(roots, F.col("label") == F.col("__label"), "left").select("key", "node", F.coalesce("root", "label").alias("label"))
        unsettled = named.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b").select("key")
        left = cut_lineage(named.join(unsettled, "key"))
        discard(member, pairs)
        member = left
    blocks = F.greatest(F.ceil(F.col("n") / F.lit(BLOCK)), F.ceil(F.col("bytes") / F.lit(BYTES))).cast("int")
    weighed = member.join(sets.select("node", F.octet_length("hashes").alias("size")), "node")
    sizes = weighed.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    placed = member.join(sizes, "key").withColumn("b", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("b")).cast("int"))
    spread = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
    tiles = spread.select("key", F.least("own", "o").alias("p"), F.greatest("own", "o").alias("q"), "node", "label").join(sets, "node")
    found.append(cut_lineage(tiles.groupBy("key", "p", "q").applyInArrow(_tile_links(similarity), "u long, v long")))
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    links = cut_lineage(links.distinct())
    discard(member, sets, *found)
    return links


def near_duplicates(docs: DataFrame, id_col: str, text_col: str, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id_col, component_id): near-duplicate classes of the rows of `docs`, whose ids are unique and never null.

    Texts are linked whose sets of shingles (A-Z lower-cased, words separated by ASCII white space) have this Jaccard similarity or
    more; component_id is the smallest id that links reach. Texts without words, null ones too, are one class. An empty
    table gives an empty result.
    """
    texts = docs.select(id_col, F.col(text_col).cast("string").alias("__text"))

    def start():
        def one(text):
            hashes = shingle_set(text, words)
            return _signed(xxhash.xxh64_intdigest(hashes.tobytes())), band_keys(hashes)

        return one

    marks = cut_lineage(map_rows(texts, [id_col], start, [("node", T.LongType()), ("keys", T.ArrayType(T.LongType()))]))
    nodes = cut_lineage(marks.groupBy("node").agg(F.min(id_col).alias("least"), F.first("keys").alias("keys")))

    def sets_of(wanted):
        named = nodes.join(wanted, "node").select("node", F.col("least").alias("__least"))
        own = texts.join(named, F.col(id_col) == F.col("__least")).select("node", "__text")
        return map_rows(own, ["node"], lambda: lambda text: (shingle_set(text, words).tobytes(),), [("hashes", T.BinaryType())])

    roots = connected_components(near_links(nodes.select("node", "keys"), sets_of, similarity)).withColumnRenamed("node", "__node")
    labelled = nodes.join(roots, F.col("node") == F.col("__node"), "left").select("node", F.coalesce("root", "node").alias("label"), "least")
    names = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = labelled.select("node", "label").join(names, "label").select("node", "component_id")
    return marks.select(id_col, "node").join(classes, "node").select(id_col, "component_id")
