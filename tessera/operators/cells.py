"""Sums of distances between the points of two blocks, by cells of neighbouring points.

The points of a block are halved along their longest axis again and again. Seen from
FAR times a cell's radius, the distance to a place in it is nearly a polynomial of DEGREE
in that place: with r the radius and d the distance from its middle, what is left out of
the series of the distance is below d * (r / d) ** (DEGREE + 1) / 30, or 1e-9 of it. The
nodes' polynomials could magnify that at each end (39 times in two, 133 in three, 657 in
four dimensions), which is no useful bound; measured between cells as close as allowed, no
distance is off by more than 6e-11, 2e-10 and 7e-10 of itself. Tests hold sums to 1e-8.

So weighted nodes stand in for a cell's points, at both ends of the distances, and every
point counts with its own place. Close cells are halved on, and at last their distances
are computed point by point; so are all, if the points are few or fill so many dimensions
that nodes aren't fewer. The nodes lie along a cell's principal axes; the shorter an axis,
the fewer it needs.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
from numpy.polynomial import chebyshev

#: Places this far from a cell's middle, in its radius, see its points as nodes, and the degree of the nodes' polynomials.
FAR, DEGREE = 5.0, 10
#: Points of a cell that isn't halved, and distances that are computed at a time.
LEAF, TILE = 128, 1 << 16
#: Squared distances below this share of the squared norms are computed from differences.
NEAR = 1e-6


@cache
def _template(steps: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers by axis of total degree DEGREE, where an axis counts so much more the shorter it is; as many nodes, and the inverse of the polynomials at them."""
    most = [int(DEGREE / s + 1e-9) for s in steps]
    powers = np.array([p for p in np.ndindex(*[m + 1 for m in most]) if sum(i * s for i, s in zip(p, steps)) <= DEGREE + 1e-9])
    # nodes of a set of powers that has all smaller ones are as many, and the polynomials through them are unique
    nodes = _leja(DEGREE + 1)[powers]
    return powers, nodes, np.linalg.inv(_polynomials(nodes, powers))


@cache
def _leja(count: int) -> np.ndarray:
    """0, and Chebyshev's extreme points, each as far as possible from those before it, by the product of the distances."""
    left, chosen = sorted(np.cos(np.arange(count) * np.pi / (count - 1)).tolist(), key=abs), []
    chosen.append(0.0)
    left.pop(0)
    while left:
        chosen.append(max(left, key=lambda x: math.prod(abs(x - c) for c in chosen)))
        left.remove(chosen[-1])
    return np.array(chosen)


def _polynomials(places: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Products of Chebyshev polynomials of the coordinates, a column for each row of powers."""
    whole = np.ones((len(places), len(powers)))
    for axis in range(places.shape[1]):
        most = int(powers[:, axis].max())
        if most:
            whole *= chebyshev.chebvander(places[:, axis], most)[:, powers[:, axis]]
    return whole


class Points:
    """Places with weights by cluster, the sums of distances to them so far, and what a product of distances needs."""

    def __init__(self, places: np.ndarray, weights: np.ndarray, sums: np.ndarray, origin: np.ndarray):
        self.places, self.weights, self.sums = places, weights, sums
        held = np.flatnonzero(weights.any(axis=0))
        self.columns = slice(int(held[0]), int(held[-1]) + 1)
        moved = places - origin
        self.norms = np.square(moved).sum(axis=1)
        ones = np.ones(len(places))
        # one product of these two gives the squared distances: |a|^2 + |b|^2 - 2ab
        self.wide = np.column_stack([moved, self.norms, ones])
        self.tall = np.ascontiguousarray(np.column_stack([-2 * moved, ones, self.norms]).T)
        self.largest = self.norms.max()


def _distances(a: Points, rows: slice, b: Points) -> np.ndarray:
    squared = a.wide[rows] @ b.tall
    bound = NEAR * (a.largest + b.largest)
    if squared.min() <= bound:  # the product has lost too many digits
        i, j = np.nonzero(squared <= bound)
        squared[i, j] = np.square(a.places[rows][i] - b.places[j]).sum(axis=1)
    return np.sqrt(squared, out=squared)


def _meet(a: Points, others: list[Points]) -> None:
    """Adds the distances between all of a and all of the others to the sums of both; if one is a itself, once."""
    for columns in {(o.columns.start, o.columns.stop) for o in others}:
        some, width = [], 0
        for o in others:
            if (o.columns.start, o.columns.stop) == columns:
                some.append(o)
                width += len(o.places)
                if width * len(a.places) >= TILE:
                    _tiles(a, some)
                    some, width = [], 0
        if some:
            _tiles(a, some)


def _tiles(a: Points, some: list[Points]) -> None:
    if a in some:
        a.sums[:, a.columns] += _distances(a, slice(None), a) @ a.weights[:, a.columns]
        some = [o for o in some if o is not a]
        if not some:
            return
    b = some[0] if len(some) == 1 else _Joined(some)
    rows = max(1, TILE // len(b.places))
    back = 0.0
    for first in range(0, len(a.places), rows):
        part = slice(first, first + rows)
        distances = _distances(a, part, b)
        a.sums[part, b.columns] += distances @ b.weights[:, b.columns]
        back = back + distances.T @ a.weights[part, a.columns]
    start = 0
    for o in some:
        o.sums[:, a.columns] += back[start : start + len(o.places)]
        start += len(o.places)


class _Joined:
    """Several sets of points with the same clusters as one."""

    def __init__(self, some: list[Points]):
        self.columns, self.largest = some[0].columns, max(o.largest for o in some)
        self.places, self.weights = np.concatenate([o.places for o in some]), np.concatenate([o.weights for o in some])
        self.tall = np.concatenate([o.tall for o in some], axis=1)


class Cell:
    """Neighbouring points first to last of a block; nodes and halves are made when they are asked for."""

    def __init__(self, block: Block, first: int, last: int):
        self.block, self.first, self.last, self.size = block, first, last, last - first
        places = block.places[first:last]
        mean = places.mean(axis=0)
        moved = places - mean
        _, self.axes = np.linalg.eigh(moved.T @ moved)
        along = moved @ self.axes
        low, high = along.min(axis=0), along.max(axis=0)
        self.half = (high - low) / 2
        self.middle = mean + self.axes @ ((low + high) / 2)
        self.longest, self.radius = float(self.half.max()), float(np.sqrt(np.square(self.half).sum()))
        self.half[self.half == 0] = 1.0
        # the share of an axis in the radius, in powers of FAR: so many steps of degree one along it count for
        steps = [1 + math.floor(2 * math.log(self.radius / h) / math.log(FAR)) / 2 if w else DEGREE + 1.0 for h, w in zip(self.half, high > low)]
        self.powers, self.nodes, self.turn = _template(tuple(min(s, DEGREE + 1.0) for s in steps))
        self.fewer = len(self.powers) < self.size
        self._nodes = self._points = self._halves = None

    def points(self) -> Points:
        if self._points is None:
            rows, block = slice(self.first, self.last), self.block
            self._points = Points(block.places[rows], block.weights[rows], block.sums[rows], block.origin)
        return self._points

    def stand_in(self) -> Points:
        """The nodes with the points' weights, or the points if these are fewer."""
        if not self.fewer:
            return self.points()
        if self._nodes is None:
            places = self.middle + (self.nodes * self.half) @ self.axes.T
            moments = sum(values.T @ self.block.weights[rows] for rows, values in self._values())
            self._nodes = Points(places, self.turn.T @ moments, np.zeros(moments.shape), self.block.origin)
            self.block.used.append(self)
        return self._nodes

    def _values(self):
        """The polynomials at the points, some rows at a time."""
        for first in range(self.first, self.last, 2048):
            rows = slice(first, min(first + 2048, self.last))
            yield rows, _polynomials((self.block.places[rows] - self.middle) @ self.axes / self.half, self.powers)

    def spread(self) -> None:
        """Gives the points what the nodes have got."""
        got = self.turn @ self._nodes.sums
        for rows, values in self._values():
            self.block.sums[rows] += values @ got

    def halves(self) -> tuple[Cell, Cell]:
        if self._halves is None:
            axis = self.axes[:, -1]
            middle = (self.first + self.last) // 2
            self.block.order(self.first, self.last, self.block.places[self.first : self.last] @ axis, middle - self.first)
            self._halves = Cell(self.block, self.first, middle), Cell(self.block, middle, self.last)
        return self._halves


class Block:
    """Finite points, each with a weight in one cluster's column, and their sums of distances by cluster."""

    def __init__(self, places: np.ndarray, weights: np.ndarray, origin: np.ndarray):
        self.places, self.weights, self.origin = places.copy(), weights.copy(), origin
        self.sums, self.place = np.zeros(weights.shape), np.arange(len(places))
        self.used: list[Cell] = []
        self.root = Cell(self, 0, len(places))

    def order(self, first: int, last: int, key: np.ndarray, middle: int) -> None:
        """Sorts a cell's points by half. Its own nodes keep their sums; no point of it may have been met alone."""
        order = first + np.argpartition(key, middle)
        for column in (self.places, self.weights, self.sums, self.place):
            column[first:last] = column[order]

    def result(self) -> np.ndarray:
        for cell in self.used:
            cell.spread()
        whole = np.empty_like(self.sums)
        whole[self.place] = self.sums
        return whole


def meet(a: Block, b: Block) -> None:
    """Adds the distances between all points of two blocks, or of one to itself, to the sums of both."""
    pairs: dict[Points, list[Points]] = {}
    stack = [(a.root, b.root)]
    while stack:
        x, y = stack.pop()
        if x is y:
            if x.size <= LEAF:
                pairs.setdefault(x.points(), []).append(x.points())
            else:
                low, high = x.halves()
                stack += [(low, low), (high, high), (low, high)]
            continue
        between = math.dist(x.middle, y.middle)
        far_x, far_y = between - y.radius >= FAR * x.radius, between - x.radius >= FAR * y.radius
        small_x, small_y = x.size <= LEAF, y.size <= LEAF
        if (far_x and (x.fewer or small_x) or small_x) and (far_y and (y.fewer or small_y) or small_y):
            one, other = x.stand_in() if far_x else x.points(), y.stand_in() if far_y else y.points()
            pairs.setdefault(one, []).append(other)
        elif small_y or (not small_x and x.radius >= y.radius):
            stack += [(half, y) for half in x.halves()]
        else:
            stack += [(x, half) for half in y.halves()]
    for one, others in pairs.items():
        _meet(one, others)
