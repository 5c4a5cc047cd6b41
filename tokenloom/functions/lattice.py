"""All ways to cut many units into pieces at once, as arrays of spans; runs inside Arrow batches.

A unit of ``k`` characters has ``k + 1`` nodes, those of a batch lie one behind the other, and a span
is a piece that stands between two nodes. Spans are followed level by level, a level being the distance
of a node from its unit's end or start.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_BITS = 21
_AT_ONCE = 1 << 17  # characters


def codes_of(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts one behind the other, and how many each has."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), sizes


def runs(units: Sequence[str]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of units with a bounded number of characters, or one unit."""
    lo, held = 0, 0
    for i, unit in enumerate(units):
        if held and held + len(unit) > _AT_ONCE:
            yield lo, i
            lo, held = i, 0
        held += len(unit)
    if lo < len(units):
        yield lo, len(units)


def _log_sums(values: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """The logarithm of the sum of each stretch, from logarithms."""
    top = np.maximum.reduceat(values, opens)
    base = np.where(np.isfinite(top), top, 0.0)
    sizes = np.diff(opens, append=len(values))
    with np.errstate(divide="ignore"):
        return base + np.log(np.add.reduceat(np.exp(values - np.repeat(base, sizes)), opens))


class _Spans:
    """What stands in units: nodes ``begin`` and ``end``, ``unit`` and ``piece`` (-1: none) of each span. Of
    spans with one end, the longest comes first."""

    def __init__(self, sizes: np.ndarray, found: list[tuple[np.ndarray, int, np.ndarray]]):
        unit_of = np.repeat(np.arange(len(sizes)), sizes)
        at = np.concatenate([f[0] for f in found[::-1]])
        length = np.repeat([f[1] for f in found[::-1]], [len(f[0]) for f in found[::-1]])
        self.piece = np.concatenate([f[2] for f in found[::-1]])
        self.unit = unit_of[at]
        self.begin = at + self.unit
        self.end = self.begin + length
        self.last = np.cumsum(sizes + 1) - 1
        self.first = self.last - sizes
        self.nodes = int(self.last[-1]) + 1 if len(sizes) else 0

    def levels(self, ahead: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The spans that reach each level, from the units' starts or back from their ends, by the node they
        reach, and where a node's spans open."""
        node = self.end if ahead else self.begin
        level = node - self.first[self.unit] if ahead else self.last[self.unit] - node
        order = np.argsort(level * self.nodes + node, kind="stable")
        level, node = level[order], node[order]
        cuts = np.flatnonzero(np.diff(level, prepend=-1))
        for lo, hi in zip(cuts, [*cuts[1:], len(order)]):
            yield order[lo:hi], np.flatnonzero(np.diff(node[lo:hi], prepend=-1))

    def sums(self, value: np.ndarray, ahead: bool) -> np.ndarray:
        """For each node the summed likelihood of all cuts up to it, as a logarithm."""
        total = np.full(self.nodes, -np.inf)
        total[self.first if ahead else self.last] = 0.0
        come, reach = (self.begin, self.end) if ahead else (self.end, self.begin)
        for spans, opens in self.levels(ahead):
            total[reach[spans[opens]]] = _log_sums(total[come[spans]] + value[spans], opens)
        return total


class Lattice:
    """Finds pieces in units."""

    def __init__(self, pieces: Sequence[str]):
        codes, sizes = codes_of(pieces)
        starts, node, held = np.cumsum(sizes) - sizes, np.zeros(len(sizes), np.int64), 1
        edges = [np.zeros(0, np.int64)]
        for k in range(int(sizes.max(initial=0))):
            live = np.flatnonzero(sizes > k)
            keys, which = np.unique(node[live] << _BITS | codes[starts[live] + k], return_inverse=True)
            node[live] = held + which
            edges.append(keys)
            held += len(keys)
        self.edges = np.concatenate(edges)  # ascending, as later nodes have larger numbers
        self.piece = np.full(held, -1, np.int64)
        self.piece[node] = np.arange(len(sizes))
        self.size = len(sizes)

    def spans(self, units: Sequence[str], every: bool = False) -> _Spans:
        """All pieces in ``units``; with ``every``, characters that are no piece as well."""
        codes, sizes = codes_of(units)
        room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))
        at, node, length = np.arange(len(codes)), np.zeros(len(codes), np.int64), 0
        found = []
        while len(at) and len(self.edges):
            keys = node << _BITS | codes[at + length]
            place = np.minimum(np.searchsorted(self.edges, keys), len(self.edges) - 1)
            hit = self.edges[place] == keys
            at, node, length = at[hit], place[hit] + 1, length + 1
            piece = self.piece[node]
            held = piece >= 0
            found.append((at[held], length, piece[held]))
            more = room[at] > length
            at, node = at[more], node[more]
        if every:
            alone = np.ones(len(codes), bool)
            if found:
                alone[found[0][0]] = False
            at = np.flatnonzero(alone)
            found.insert(0, (at, 1, np.full(len(at), -1)))
        none = (np.zeros(0, np.int64), 1, np.zeros(0, np.int64))
        return _Spans(sizes, found or [none])

    def expected(self, units: Sequence[str], n: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each piece is expected over all cuts of all units, weighted by their likelihood and
        ``n``, and whether it stands in a unit that can be cut."""
        counts, met = np.zeros(self.size), np.zeros(self.size, bool)
        for lo, hi in runs(units):
            spans = self.spans(units[lo:hi])
            value = score[spans.piece]
            before, behind = spans.sums(value, True), spans.sums(value, False)
            whole = before[spans.last[spans.unit]]
            held = np.isfinite(whole)
            piece, unit = spans.piece[held], spans.unit[held]
            weight = np.exp((before[spans.begin] + value + behind[spans.end])[held] - whole[held])
            counts += np.bincount(piece, weight * n[lo:hi][unit], self.size)
            met[piece] = True
        return counts, met

    def best(self, units: Sequence[str], score: np.ndarray, unknown: float) -> Iterator[list[tuple[int, int, int]]]:
        """The cut of each unit with the highest summed score, as pieces (-1: none) with their bounds; a
        character with no piece scores ``unknown``. Of equal ones, the longest last piece is taken."""
        for lo, hi in runs(units):
            spans = self.spans(units[lo:hi], every=True)
            value = np.where(spans.piece >= 0, score[spans.piece] if self.size else unknown, unknown)
            best, chosen = np.full(spans.nodes, -np.inf), np.full(spans.nodes, -1, np.int64)
            best[spans.first] = 0.0
            for some, opens in spans.levels(True):
                reached = best[spans.begin[some]] + value[some]
                top = np.maximum.reduceat(reached, opens)
                which = np.repeat(np.arange(len(opens)), np.diff(opens, append=len(some)))
                equal = np.flatnonzero(reached == top[which])
                equal = equal[np.flatnonzero(np.diff(which[equal], prepend=-1))]
                node = spans.end[some[opens]]
                best[node], chosen[node] = top, some[equal]
            on, node = np.zeros(spans.nodes, bool), spans.last[spans.last > spans.first]
            while len(node):
                on[node] = True
                node = spans.begin[chosen[node]]
                node = node[chosen[node] >= 0]
            taken = chosen[on]
            unit = spans.unit[taken]
            start = spans.first[unit]
            rows = list(zip(spans.piece[taken].tolist(), (spans.begin[taken] - start).tolist(), (spans.end[taken] - start).tolist()))
            bounds = np.searchsorted(unit, np.arange(hi - lo + 1)).tolist()
            for a, b in zip(bounds, bounds[1:]):
                yield rows[a:b]
