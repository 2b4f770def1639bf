"""Weighted finite-state transducers: arcs, composition and best paths, in max-plus weights."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

Arc = tuple[object, str, float]


@dataclass
class Transducer:
    """From symbols to symbols. A symbol without an arc in a state is copied and the state kept."""

    start: object
    arcs: dict[tuple[object, str], list[Arc]] = field(default_factory=dict)

    def add(self, state: object, symbols: Iterable[str], to: object, out: str | None = None, weight: float = 0.0) -> None:
        """An arc for each of the symbols; out None copies the symbol."""
        for symbol in symbols:
            self.arcs.setdefault((state, symbol), []).append((to, symbol if out is None else out, weight))

    def step(self, state: object, symbol: str) -> list[Arc]:
        return self.arcs.get((state, symbol)) or [(state, symbol, 0.0)]

    def compose(self, then: Transducer, symbols: Sequence[str]) -> Transducer:
        """This transducer followed by another, over the symbols that may come in."""
        both = Transducer((self.start, then.start))
        todo, seen = [both.start], {both.start}
        while todo:
            mine, other = state = todo.pop()
            for symbol in symbols:
                for to, out, weight in self.step(mine, symbol):
                    for end, last, more in then.step(other, out):
                        both.add(state, [symbol], (to, end), last, weight + more)
                        if (to, end) not in seen:
                            seen.add((to, end))
                            todo.append((to, end))
        return both

    def best(self, symbols: Sequence[str]) -> tuple[list[str], float]:
        """Output of the path with the largest weight; of equal ones the first found."""
        paths: dict[object, tuple[float, tuple | None]] = {self.start: (0.0, None)}
        for symbol in symbols:
            after: dict[object, tuple[float, tuple | None]] = {}
            for state, (total, back) in paths.items():
                for to, out, weight in self.step(state, symbol):
                    if to not in after or after[to][0] < total + weight:
                        after[to] = (total + weight, (out, back))
            paths = after
        total, back = max(paths.values(), key=lambda path: path[0])
        outputs = []
        while back is not None:
            out, back = back
            outputs.append(out)
        return outputs[::-1], total
