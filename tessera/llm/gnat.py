"""Nearest entries of a small list by a geometric near-neighbour access tree.

A node has some split points, entries far from each other; every other entry
belongs to the split point nearest to it. For each pair of a split point and a
child the node stores how near and how far the child's entries are from the split
point. A query at distance d from the split point can't be within r of a child
whose entries all lie nearer than d - r or farther than d + r, so the whole child is
left out. Coordinates are whole numbers: squared distances are exact, their roots
are rounded down or up, whichever keeps a child, and only strictly worse children
go, so that of equally near entries the one with the lowest number is found.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Split points of a node, and entries that need no node.
DEGREE, LEAF = 4, 2
#: Coordinates below this in size: squared distances of 16 coordinates and more fit into 64 bits.
MOST = 1 << 28


def root_down(squared: np.ndarray) -> np.ndarray:
    """Largest whole numbers whose squares aren't above these (below 2^62)."""
    root = np.sqrt(squared.astype(np.float64)).astype(np.int64)
    root -= root * root > squared
    return root + ((root + 1) * (root + 1) <= squared)


def root_up(squared: np.ndarray) -> np.ndarray:
    root = root_down(squared)
    return root + (root * root < squared)


def squares(points: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Squared distances of points (rows of whole numbers) from one entry."""
    away = points - entry
    return np.einsum("ij,ij->i", away, away)


@dataclass
class Node:
    """Numbers of the split points, or of a leaf's entries; children with [split point, child] distance ranges."""

    entries: list[int]
    children: list[Node | None] = field(default_factory=list)
    near: np.ndarray | None = None
    far: np.ndarray | None = None


class Tree:
    """The tree over entries (rows of 64-bit whole numbers below MOST in size)."""

    def __init__(self, entries: np.ndarray):
        self.entries = np.ascontiguousarray(entries, np.int64)
        if self.entries.size and np.abs(self.entries).max() > MOST:
            raise ValueError(f"coordinates are beyond {MOST}")
        self.root = self._node(list(range(len(self.entries))))
        #: Distances computed by the last search.
        self.compared = 0

    def _node(self, numbers: list[int]) -> Node:
        if len(numbers) <= max(LEAF, DEGREE):
            return Node(numbers)
        some = self.entries[numbers]
        splits, reach = [0], squares(some, some[0])
        while len(splits) < DEGREE:  # the farthest from all so far
            far = int(reach.argmax())
            if not reach[far]:
                break
            splits.append(far)
            reach = np.minimum(reach, squares(some, some[far]))
        if len(splits) == 1:  # all are equal: the first is nearest to any query
            return Node([numbers[0]])
        distances = np.stack([squares(some, some[i]) for i in splits])
        owner = distances.argmin(axis=0)
        children, near, far = [], np.zeros((len(splits), len(splits)), np.int64), np.zeros((len(splits), len(splits)), np.int64)
        for child in range(len(splits)):
            inside = np.array([i for i in np.flatnonzero(owner == child) if i not in splits], np.int64)
            children.append(self._node([numbers[i] for i in inside]) if len(inside) else None)
            if len(inside):
                near[:, child] = root_down(distances[:, inside].min(axis=1))
                far[:, child] = root_up(distances[:, inside].max(axis=1))
        return Node([numbers[i] for i in splits], children, near, far)

    def search(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of each point's nearest entry, the lowest number of equally near ones."""
        number = np.full(len(points), -1, np.int64)
        least = np.full(len(points), np.iinfo(np.int64).max, np.int64)
        self.compared = 0
        self._search(self.root, points, np.arange(len(points)), number, least)
        return number, least

    def _search(self, node: Node, points: np.ndarray, here: np.ndarray, number: np.ndarray, least: np.ndarray) -> None:
        found = np.empty((len(node.entries), len(here)), np.int64)
        some = points[here]
        for row, entry in enumerate(node.entries):
            found[row] = distance = squares(some, self.entries[entry])
            best = least[here]
            better = (distance < best) | ((distance == best) & (entry < number[here]))
            least[here[better]], number[here[better]] = distance[better], entry
        self.compared += found.size
        if not node.children or not len(here):
            return
        down, up, home = root_down(found), root_up(found), found.argmin(axis=0)
        for at_home in (True, False):  # the child of the nearest split point first: it makes the radius small
            for child, below in enumerate(node.children):
                if below is None:
                    continue
                mine = np.flatnonzero((home == child) == at_home)
                radius = root_up(least[here[mine]])
                out = (down[:, mine] - radius > node.far[:, child, None]) | (node.near[:, child, None] - up[:, mine] > radius)
                mine = mine[~out.any(axis=0)]
                if len(mine):
                    self._search(below, points, here[mine], number, least)
