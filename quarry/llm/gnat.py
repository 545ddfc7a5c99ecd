"""A multiway hyperplane tree over integer vectors, with the distance ranges that let a search pass over siblings.

Each inner node has up to FAN split points; a vector goes to the nearest one. For split points i and j, the node
knows between which distances from i all vectors of j's subtree lie, and which norms they have. Small helpers in
numpy, run inside Spark tasks and once on the bounded sample that the tree is fitted on.
"""

from __future__ import annotations

import numpy as np

#: Split points of a node, candidates looked at for each of them, and sample rows below which a node isn't split.
FAN, CANDIDATES, LEAST = 16, 3, 32
#: What rounding may take from a distance, relative to the lengths involved.
SLACK = 1e-9


class Node:
    """Inner node: split points, their squared norms, and for each child a Node or the number of a leaf."""

    def __init__(self, splits: np.ndarray):
        self.splits, self.squares = splits, (splits * splits).sum(1)
        self.children: list[Node | int] = []
        k = len(splits)
        self.low, self.high = np.full((k, k), np.inf), np.full((k, k), -np.inf)  # [split point i, child j]
        self.norms = np.stack([np.full(k, np.inf), np.full(k, -np.inf)])


def squared_distances(rows: np.ndarray, node: Node) -> np.ndarray:
    return np.maximum((rows * rows).sum(1)[:, None] + node.squares[None] - 2 * (rows @ node.splits.T), 0)


class Tree:
    """Fitted on `sample` (distinct rows, any order that doesn't depend on the values) for some `leaves` leaves."""

    def __init__(self, sample: np.ndarray, leaves: float):
        self.leaves = 0
        self.paths: list[list[tuple[Node, int]]] = []  # of each leaf: the nodes over it and which child leads on
        self.root = self._grow(sample.astype(float), leaves, [])

    def _grow(self, rows: np.ndarray, leaves: float, path: list[tuple[Node, int]]) -> Node | int:
        k = int(min(FAN, np.ceil(leaves), len(rows) // (LEAST // 2)))
        if k < 2 or len(rows) < LEAST:
            self.paths.append(path)
            self.leaves += 1
            return self.leaves - 1
        # greedily, of some candidates, the one farthest from those taken
        pool = rows[: k * CANDIDATES]
        taken, gap = [0], ((pool - pool[0]) ** 2).sum(1)
        while len(taken) < k and gap.max() > 0:
            taken.append(int(gap.argmax()))
            gap = np.minimum(gap, ((pool - pool[taken[-1]]) ** 2).sum(1))
        node = Node(pool[taken])
        nearest = squared_distances(rows, node).argmin(1)
        for j in range(len(taken)):
            own = rows[nearest == j]
            node.children.append(self._grow(own, leaves * len(own) / len(rows), [*path, (node, j)]))
        return node

    def leaf_of(self, rows: np.ndarray) -> np.ndarray:
        """The leaf that each vector goes to."""
        out, rows = np.zeros(len(rows), np.int64), rows.astype(float)
        waiting = [(self.root, np.arange(len(rows)))]
        while waiting:
            at, which = waiting.pop()
            if isinstance(at, int):
                out[which] = at
            elif len(which):
                nearest = squared_distances(rows[which], at).argmin(1)
                waiting += [(child, which[nearest == j]) for j, child in enumerate(at.children)]
        return out

    def ranges(self, rows: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest norm of vectors of one leaf, then distance from each split point over it."""
        rows = rows.astype(float)
        each = [np.sqrt((rows * rows).sum(1))[:, None], *[np.sqrt(squared_distances(rows, node)) for node, _ in self.paths[leaf]]]
        told = np.concatenate(each, axis=1)
        return told.min(0), told.max(0)

    def widen(self, leaf: int, low: np.ndarray, high: np.ndarray) -> None:
        """Takes in what `ranges` says of a leaf."""
        at = 1
        for node, j in self.paths[leaf]:
            k = len(node.splits)
            node.low[:, j] = np.minimum(node.low[:, j], low[at : at + k])
            node.high[:, j] = np.maximum(node.high[:, j], high[at : at + k])
            node.norms[0, j], node.norms[1, j] = min(node.norms[0, j], low[0]), max(node.norms[1, j], high[0])
            at += k

    def reached(self, rows: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """rows x leaves: whether a leaf may hold a vector whose inner product with the row lies in [least, most].

        A child j is passed over if for some split point i no distance from the row fits both the range of j
        around i, by the triangle inequality, and the annulus of distances that the window of products allows.
        """
        rows = rows.astype(float)
        square = (rows * rows).sum(1)
        out = np.zeros((len(rows), self.leaves), bool)
        waiting = [(self.root, np.flatnonzero(least <= most))]
        while waiting:
            at, which = waiting.pop()
            if isinstance(at, int):
                out[which, at] = True
                continue
            if not len(which):
                continue
            away = np.sqrt(squared_distances(rows[which], at))[:, :, None]  # row, i, 1
            nearest = np.maximum(np.maximum(at.low[None] - away, away - at.high[None]), 0).max(1)  # row, j
            farthest = (at.high[None] + away).min(1)
            inner = square[which, None] + at.norms[0][None] ** 2 - 2 * most[which, None]
            outer = square[which, None] + at.norms[1][None] ** 2 - 2 * least[which, None]
            slack = SLACK * (1 + square[which, None] + at.norms[1][None] ** 2)
            alive = (nearest**2 <= outer + slack) & (farthest**2 >= inner - slack) & (at.norms[1] >= at.norms[0])[None]
            waiting += [(child, which[alive[:, j]]) for j, child in enumerate(at.children)]
        return out
