"""Geometric near-neighbour access tree over a list of integer vectors.

A node has split points and hands every other entry to the child of its nearest split point. For each pair of a split
point and a child the node stores the range of distances between them. A query measures its distances to the split
points, and a child is left out when one of these shows that nothing in it can be as near as the best entry so far. Distances are
roots of integers: they are rounded so that no child is left out wrongly, and a child is left out only if all of it is
strictly farther, so entries at equal distance are all measured and the lower index wins.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def root_floor(squares: np.ndarray) -> np.ndarray:
    """Largest integers whose squares are at most these (below 2**61)."""
    root = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    root -= root * root > squares
    root += (root + 1) * (root + 1) <= squares
    return root


def root_ceil(squares: np.ndarray) -> np.ndarray:
    low = root_floor(squares)
    return low + (low * low < squares)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of `a` to all rows of `b`."""
    apart = a[:, None, :] - b[None, :, :]
    return np.einsum("ijk,ijk->ij", apart, apart)


@dataclass
class Node:
    splits: np.ndarray
    children: dict[int, "Node"] = field(default_factory=dict)  # by the place of the split point
    low: np.ndarray | None = None  # [split point, child's split point]: least distance, rounded down
    high: np.ndarray | None = None  # greatest distance, rounded up


class Gnat:
    def __init__(self, entries: np.ndarray, arity: int = 4) -> None:
        self.entries = np.asarray(entries, dtype=np.int64)
        self.arity = max(2, arity)
        #: Distances measured by all searches so far.
        self.measured = 0
        self.root = self._node(np.arange(len(self.entries))) if len(self.entries) else None

    def _node(self, members: np.ndarray) -> Node:
        splits = self._spread(members)
        rest = members[~np.isin(members, splits)]
        node = Node(splits)
        if len(rest):
            apart = squared(self.entries[splits], self.entries[rest])
            owner = apart.argmin(axis=0)
            node.low, node.high = (np.zeros((len(splits), len(splits)), dtype=np.int64) for _ in range(2))
            for j in np.unique(owner):
                own = owner == j
                node.low[:, j], node.high[:, j] = root_floor(apart[:, own].min(axis=1)), root_ceil(apart[:, own].max(axis=1))
                node.children[int(j)] = self._node(rest[own])
        return node

    def _spread(self, members: np.ndarray) -> np.ndarray:
        """Split points: the first member, then again and again the one farthest from those chosen."""
        chosen = [0]
        least = squared(self.entries[members], self.entries[members[:1]])[:, 0]
        while len(chosen) < min(self.arity, len(members)):
            least[chosen] = -1
            chosen.append(int(least.argmax()))
            least = np.minimum(least, squared(self.entries[members], self.entries[members[chosen[-1:]]])[:, 0])
        return members[sorted(chosen)]

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each query, the lower index at equal distance."""
        queries = np.asarray(queries, dtype=np.int64)
        index = np.full(len(queries), len(self.entries), dtype=np.int64)
        best = np.full(len(queries), np.iinfo(np.int64).max, dtype=np.int64)
        if len(queries) and self.root:
            self._visit(self.root, np.arange(len(queries)), queries, index, best)
        return index, best

    def _visit(self, node: Node, rows: np.ndarray, queries: np.ndarray, index: np.ndarray, best: np.ndarray) -> None:
        apart = squared(queries[rows], self.entries[node.splits])
        self.measured += apart.size
        for column, entry in zip(apart.T, node.splits):
            better = (column < best[rows]) | ((column == best[rows]) & (entry < index[rows]))
            best[rows[better]], index[rows[better]] = column[better], entry
        if not node.children:
            return
        low, high = root_floor(apart), root_ceil(apart)
        places = np.array(list(node.children))
        first = places[apart[:, places].argmin(axis=1)]
        for nearest_child in (True, False):
            for j, child in node.children.items():
                some = np.flatnonzero((first == j) == nearest_child)
                reach = root_ceil(best[rows[some]])[:, None]
                out = ((low[some] - reach > node.high[:, j]) | (high[some] + reach < node.low[:, j])).any(axis=1)
                if not out.all():
                    self._visit(child, rows[some[~out]], queries, index, best)
