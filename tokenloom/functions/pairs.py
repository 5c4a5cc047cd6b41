"""Neighbouring symbols in Arrow columns: joining pairs and adding up how often they occur.

A symbol is a number: a character's code point, or ``MERGED`` and the place of the merge that made
it. A pair is its two symbols in one 64-bit number. Units travel in blocks of bounded size: a row holds
the symbols of many units, each with ``_END`` behind it, and their counts, as 32- and 64-bit numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

MERGED = 0x110000
BLOCKS = "symbols binary, n binary"
_BITS = 21
_MASK = (1 << _BITS) - 1
_END = _MASK  # no symbol is that large
_BLOCK_SYMBOLS = 1 << 18

Batch = tuple[np.ndarray, np.ndarray]  # sorted pairs and the symbols they become


def pair_of(left: int, right: int) -> int:
    return left << _BITS | right


def symbols_of(pair: int) -> tuple[int, int]:
    return pair >> _BITS, pair & _MASK


def neighbours(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a unit has a symbol and one after it, and the pair there."""
    inside = symbols != _END
    at = np.flatnonzero(inside[:-1] & inside[1:])
    return at, symbols[at].astype(np.int64) << _BITS | symbols[at + 1]


class Joiner:
    """Joins the pairs of a batch. No two of them overlap, except one of equal symbols with itself: of its
    run, every second place is joined, from the left."""

    def __init__(self, batch: Batch):
        self.pairs, self.made = batch
        self.role = np.zeros(1 << _BITS, np.uint8)  # of a symbol: 1 starts a pair, 2 ends one, 3 does both
        self.role[self.pairs >> _BITS] = 1
        self.role[self.pairs & _MASK] |= 2

    def __call__(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols after the pairs are joined, and the places where they were before."""
        role = self.role.take(symbols)
        at = np.flatnonzero((role[:-1] & (role[1:] >> 1)).view(bool))
        found = symbols[at].astype(np.int64) << _BITS | symbols[at + 1]
        place = np.minimum(np.searchsorted(self.pairs, found), len(self.pairs) - 1)
        hit = self.pairs[place] == found
        at, place = at[hit], place[hit]
        if not len(at):
            return symbols, at
        first = np.concatenate([[True], np.diff(at) != 1])
        in_run = at - at[first][np.cumsum(first) - 1]
        at, place = at[in_run % 2 == 0], place[in_run % 2 == 0]
        symbols = symbols.copy()
        symbols[at] = self.made[place]
        stays = np.ones(len(symbols), bool)
        stays[at + 1] = False
        return symbols[stays], at


def summed(pairs: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs and their summed weights, without those of sum zero."""
    if not len(pairs):
        return pairs, weights
    order = np.argsort(pairs, kind="stable")
    pairs, weights = pairs[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    totals = np.add.reduceat(weights, first)
    return pairs[first][totals != 0], totals[totals != 0]


def _counts(pairs: np.ndarray, weights: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(pairs, pa.int64()), pa.array(weights, pa.int64())], ["pair", "d"])


def _block(symbols: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    held = [pa.array([x.tobytes()], pa.binary()) for x in (symbols.astype(np.int32), n.astype(np.int64))]
    return pa.record_batch(held, ["symbols", "n"])


def _blocks(tables: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for table in tables:
        for symbols, n in zip(table.column("symbols"), table.column("n")):
            yield np.frombuffer(symbols.as_buffer(), np.int32), np.frombuffer(n.as_buffer(), np.int64)


def _units(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each unit starts and where its end stands."""
    ends = np.flatnonzero(symbols == _END)
    return np.concatenate([[0], ends[:-1] + 1]).astype(np.int64), ends


def _take(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The symbols of some units with their ends."""
    sizes = ends - starts + 1
    return symbols[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]


def packer(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``symbols``, a list, and ``n`` as blocks."""
    held, waiting = [], 0

    def out() -> pa.RecordBatch:
        return _block(*map(np.concatenate, zip(*held)))

    for table in tables:
        sizes = table.column("symbols").value_lengths().to_numpy(zero_copy_only=False)
        flat = table.column("symbols").flatten().to_numpy(zero_copy_only=False)
        n = table.column("n").to_numpy(zero_copy_only=False)
        lo, ends = 0, np.cumsum(sizes)
        while lo < len(sizes):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - sizes[lo] + _BLOCK_SYMBOLS)))
            of = flat[ends[lo] - sizes[lo] : ends[hi - 1]]
            held.append((np.insert(of, np.cumsum(sizes[lo:hi]), _END), n[lo:hi]))
            waiting += len(held[-1][0])
            lo = hi
            if waiting >= _BLOCK_SYMBOLS:
                yield out()
                held, waiting = [], 0
    if held:
        yield out()


def rewriter(batches: Sequence[Batch]):
    """Units after all ``batches``; those of one symbol, which have no pair any more, go."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joiners = [Joiner(b) for b in batches]
        held, waiting = [], 0
        for symbols, n in _blocks(tables):
            for join in joiners:
                symbols, _ = join(symbols)
            starts, ends = _units(symbols)
            live = np.flatnonzero(ends - starts > 1)
            if not len(live):
                continue
            held.append((_take(symbols, starts[live], ends[live]), n[live]))
            waiting += len(held[-1][0])
            if waiting >= _BLOCK_SYMBOLS // 2:
                yield _block(*map(np.concatenate, zip(*held)))
                held, waiting = [], 0
        if held:
            yield _block(*map(np.concatenate, zip(*held)))

    return run


def counter(batches: Sequence[Batch]):
    """How often each pair occurs after all ``batches``."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joiners = [Joiner(b) for b in batches]
        for symbols, n in _blocks(tables):
            for join in joiners:
                symbols, _ = join(symbols)
            at, found = neighbours(symbols)
            yield _counts(*summed(found, n[np.searchsorted(_units(symbols)[1], at)]))

    return run


def change_counter(batches: Sequence[Batch], watched: np.ndarray):
    """What the last batch adds to and takes from the counts of ``watched`` pairs (sorted) and of
    pairs with a symbol it makes. Only units that it changes are looked at."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        newest = batches[-1][1].min()
        joiners = [Joiner(b) for b in batches]
        for symbols, n in _blocks(tables):
            for join in joiners[:-1]:
                symbols, _ = join(symbols)
            at = joiners[-1](symbols)[1]
            if not len(at):
                continue
            starts, ends = _units(symbols)
            changed = np.unique(np.searchsorted(ends, at))
            before = _take(symbols, starts[changed], ends[changed])
            parts, weights = [], []
            for sign, some in ((-1, before), (1, joiners[-1](before)[0])):
                at, found = neighbours(some)
                parts.append(found)
                weights.append(sign * n[changed[np.searchsorted(_units(some)[1], at)]])
            found, total = summed(np.concatenate(parts), np.concatenate(weights))
            place = np.minimum(np.searchsorted(watched, found), max(len(watched) - 1, 0))
            known = watched[place] == found if len(watched) else np.zeros(len(found), bool)
            kept = known | (found >> _BITS >= newest) | (found & _MASK >= newest)
            yield _counts(found[kept], total[kept])

    return run
