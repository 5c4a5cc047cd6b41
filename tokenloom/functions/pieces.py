"""Cutting one unit into vocabulary pieces; runs inside Arrow batches on the executors."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tokenloom.functions.lattice import Lattice
from tokenloom.functions.tables import BYTE_BASE

_MEMO_LIMIT = 200_000  # units of each of the two generations that are remembered
_UNITS_AT_ONCE = 1 << 18
_UNKNOWN_PENALTY = 10.0


def merge_pieces(unit: str, score: dict[str, float]) -> list[str]:
    """Join neighbours while their text is a piece, best score first and leftmost on ties."""
    parts: list[str | None] = list(unit)
    after = list(range(1, len(parts) + 1))
    before = list(range(-1, len(parts) - 1))
    agenda: list[tuple[float, int, int, str]] = []

    def offer(left: int, right: int) -> None:
        if left >= 0 and right < len(parts):
            text = parts[left] + parts[right]
            if text in score:
                heapq.heappush(agenda, (-score[text], left, right, text))

    for i in range(len(parts) - 1):
        offer(i, i + 1)
    while agenda:
        _, left, right, text = heapq.heappop(agenda)
        if parts[left] is None or parts[right] is None or parts[left] + parts[right] != text:
            continue
        parts[left], parts[right] = text, None
        after[left] = after[right]
        if after[left] < len(parts):
            before[after[left]] = left
        offer(before[left], left)
        offer(left, after[left])
    return [p for p in parts if p is not None]


def unknown_score(score: dict[str, float]) -> float:
    return min(score.values(), default=0.0) - _UNKNOWN_PENALTY


def best_path(unit: str, score: dict[str, float], longest: int, without: str | None = None) -> tuple[list[str], float]:
    """The cut with the highest summed score; a character with no piece costs extra."""
    unknown = unknown_score(score)
    best = [0.0] + [-math.inf] * len(unit)
    start = [0] * (len(unit) + 1)
    for end in range(1, len(unit) + 1):
        for at in range(max(0, end - longest), end):
            text = unit[at:end]
            value = None if text == without else score.get(text)
            if value is None:
                if end - at > 1:
                    continue
                value = unknown
            if best[at] + value > best[end]:
                best[end], start[end] = best[at] + value, at
    cut, end = [], len(unit)
    while end > 0:
        cut.append(unit[start[end] : end])
        end = start[end]
    return cut[::-1], best[len(unit)]


def _log_add(a: float, b: float) -> float:
    low, high = (a, b) if a < b else (b, a)
    return high if low == -math.inf else high + math.log1p(math.exp(low - high))


def expected_pieces(unit: str, score: dict[str, float], longest: int) -> dict[str, float]:
    """How often each piece is expected over all cuts of the unit, weighted by their likelihood."""
    size = len(unit)
    spans = [
        (at, end, score[unit[at:end]])
        for end in range(1, size + 1)
        for at in range(max(0, end - longest), end)
        if unit[at:end] in score
    ]
    forward = [0.0] + [-math.inf] * size
    for at, end, value in spans:
        forward[end] = _log_add(forward[end], forward[at] + value)
    if forward[size] == -math.inf:
        return {}
    backward = [-math.inf] * size + [0.0]
    for at, end, value in sorted(spans, key=lambda s: -s[0]):
        backward[at] = _log_add(backward[at], backward[end] + value)
    expected: dict[str, float] = {}
    for at, end, value in spans:
        weight = math.exp(forward[at] + value + backward[end] - forward[size])
        text = unit[at:end]
        expected[text] = expected.get(text, 0.0) + weight
    return expected


class UnitEncoder:
    """Ids of an Arrow column of unit lists. Each distinct unit of a run of ``_UNITS_AT_ONCE`` is looked up
    once, so what is held beside a batch and its ids does not grow with the batch. Whole words are looked up
    in arrays; only the other models keep what they have cut."""

    def __init__(self, pieces: dict[str, tuple[int, float]], model: str, whole: frozenset[str]):
        self.ids = {text: i for text, (i, _) in pieces.items()}
        self.score = {text: s for text, (_, s) in pieces.items()}
        self.model = model
        self.whole = whole
        self.longest = max(map(len, pieces), default=1)
        self.memo: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}  # the memo before; what is asked for again comes back
        self.lattice: Lattice | None = None
        self.texts: pa.Array | None = None

    def cut(self, unit: str) -> list[str]:
        if unit in self.whole or (self.model == "word" and unit in self.ids):
            return [unit]
        if self.model == "bpe":
            return merge_pieces(unit, self.score)
        if self.model == "unigram":
            return best_path(unit, self.score, self.longest)[0]
        return list(unit) if self.model == "char" else [unit]

    def known(self, unit: str) -> list[int] | None:
        found = self.memo.get(unit)
        if found is None:
            found = self.older.get(unit)
            if found is not None:
                self.keep(unit, found)
        return found

    def keep(self, unit: str, ids: list[int]) -> list[int]:
        if len(self.memo) >= _MEMO_LIMIT:
            self.older, self.memo = self.memo, {}
        self.memo[unit] = ids
        return ids

    def text_ids(self, text: str) -> list[int]:
        known = self.ids.get(text)
        return [known] if known is not None else [BYTE_BASE + b for b in text.encode()]

    def unit_ids(self, unit: str) -> list[int]:
        found = self.known(unit)
        return self.keep(unit, [i for text in self.cut(unit) for i in self.text_ids(text)]) if found is None else found

    def all_ids(self, units: list[str]) -> list[list[int]]:
        """The ids of each of the distinct ``units``; those of the unigram model are cut together."""
        if self.model != "unigram":
            return [self.unit_ids(u) for u in units]
        made = [self.unit_ids(u) if u in self.whole else self.known(u) for u in units]
        new = [i for i, ids in enumerate(made) if ids is None]
        if self.lattice is None:
            self.lattice = Lattice(list(self.score))
        values = np.array(list(self.score.values()))
        numbers = list(self.ids.values())
        texts = [units[i] for i in new]
        for i, text, cut in zip(new, texts, self.lattice.best(texts, values, unknown_score(self.score))):
            ids = [j for p, a, b in cut for j in ([numbers[p]] if p >= 0 else self.text_ids(text[a:b]))]
            made[i] = self.keep(text, ids)
        return made

    def word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one behind the other, and how many each has: its own, or those of its bytes."""
        if self.texts is None:
            self.texts = pa.array(self.ids.keys(), words.type)
            self.numbers = np.fromiter(self.ids.values(), np.int32, len(self.ids))
        at = pc.fill_null(pc.index_in(words, value_set=self.texts), -1).to_numpy(zero_copy_only=False)
        known = at >= 0
        sizes = np.where(known, 1, pc.binary_length(words).to_numpy(zero_copy_only=False)).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        flat = np.empty(int(sizes.sum()), np.int32)
        flat[starts[known]] = self.numbers[at[known]]
        data = b"".join(words.filter(pa.array(~known)).cast(pa.large_binary()).to_pylist())
        flat[np.repeat(~known, sizes)] = np.frombuffer(data, np.uint8).astype(np.int32) + BYTE_BASE
        return flat, sizes

    def run_ids(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units one behind the other, and where those of each unit end."""
        coded = units.dictionary_encode()
        if self.model == "word":
            flat, sizes = self.word_ids(coded.dictionary)
        else:
            cuts = self.all_ids(coded.dictionary.to_pylist())
            sizes = np.fromiter((len(c) for c in cuts), np.int64, len(cuts))
            flat = np.fromiter((i for c in cuts for i in c), np.int32, int(sizes.sum()))
        starts = np.cumsum(sizes) - sizes
        which = coded.indices.to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes[which])
        takes = np.repeat(starts[which] - (ends - sizes[which]), sizes[which]) + np.arange(ends[-1])
        return flat[takes], ends

    def batch(self, units: pa.Array) -> pa.Array:
        flat = units.flatten()
        row_ends = np.cumsum(units.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        bounds = np.zeros(len(units) + 1, np.int64)
        parts, total = [np.zeros(0, np.int32)], 0
        for at in range(0, len(flat), _UNITS_AT_ONCE):
            ids, ends = self.run_ids(flat.slice(at, _UNITS_AT_ONCE))
            first, last = np.searchsorted(row_ends, [at, at + len(ends)], side="right")
            bounds[first + 1 : last + 1] = total + ends[row_ends[first:last] - at - 1]
            parts.append(ids)
            total += len(ids)
        mask = units.is_null() if units.null_count else None
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(parts), pa.int32()), mask=mask)
