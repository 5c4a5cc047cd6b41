"""Exact top-k search by columnar branch-and-bound.

A group of rows is held vertically: one contiguous run per dimension, dimensions by falling mass,
and beside them, for each block of dimensions, the length of what is left of every row. A query adds
up its inner product block by block over all rows still alive; after a block, a row can gain at most
the product of the two remaining lengths, so rows whose sum cannot reach the query's k-th best any
more are compacted away. The k-th best comes from the rows that score highest on the heaviest block.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from tokenloom.llm import grid
from tokenloom.llm.common import ship_package

BLOCK = 16  # dimensions between two prunings
SCALE = 256
_EXACT = 2.0**53  # whole numbers up to here are exact as doubles


def top_k(
    df: DataFrame, chosen: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE
) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id``, ``score`` of the ``k`` rows with the highest inner
    product of ``floor(scale * x)``, for each query; all rows, if there are fewer.

    ``chosen`` is a condition on ``vec_id`` that states the queries. A query's own row, that is every
    row with its id, is no candidate; other rows with equal ids or vectors all count. Rows with a null
    id or a vector that is null or has a null or non-finite component take no part. Vectors of unlike
    length, empty ones too, are compared as if zeros followed the shorter. Products beyond the range of long
    are cut to it. Ties go to the smaller id. Other columns are not read; no query, no rows.
    """
    ship_package(df.sparkSession)
    rows = grid.usable(df, vec_id, embedding)
    return grid.search(rows, grid.query_rows(rows, chosen), functools.partial(_cell, k, scale), k, "long")


def _cell(k: int, scale: int, rows: pa.Table, queries: pa.Table) -> pa.Table:
    out: list[tuple] = []
    if rows.num_rows and queries.num_rows:
        width = grid.widest(rows.column("vector"), queries.column("vector"))
        vectors = np.floor(scale * grid.matrix(rows.column("vector"), width))
        asked = np.floor(scale * grid.matrix(queries.column("vector"), width))
        ids, own = rows.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy()
        largest = np.abs(vectors).max(initial=1) * np.abs(asked).max(initial=1)
        if largest * width < _EXACT:
            held = Vertical(vectors, ids)
            out = [(q, *held.top(v, q, k)) for q, v in zip(own.tolist(), asked)]
        else:
            out = [(q, *_big(vectors, ids, v, q, k)) for q, v in zip(own.tolist(), asked)]
    return pa.table({
        "query_id": pa.array(np.repeat([o[0] for o in out], [len(o[1]) for o in out]).astype(np.int64) if out else [], pa.int64()),
        "vec_id": pa.array(np.concatenate([o[1] for o in out]) if out else [], pa.int64()),
        "score": pa.array(np.concatenate([o[2] for o in out]).astype(np.int64) if out else [], pa.int64()),
    })


class Vertical:
    """Whole-number vectors, one run per dimension, with the length that remains after each block."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, block: int = BLOCK):
        self.ids = ids
        self.order = np.argsort(-np.square(vectors).sum(axis=0), kind="stable")
        self.columns = np.ascontiguousarray(vectors.T[self.order])
        self.cuts = list(range(0, len(self.order), block))
        mass = [np.square(self.columns[at : at + block]).sum(axis=0) for at in self.cuts]
        after = np.cumsum([np.zeros(len(ids)), *mass[:0:-1]], axis=0)[::-1]
        self.left = np.sqrt(after) * (1 + 1e-9)  # rounded up, so that a bound is never too low
        self.block = block

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``k`` best rows, best first."""
        q = query[self.order]
        alive = np.flatnonzero(self.ids != own)
        if not len(alive):
            return self.ids[:0], np.zeros(0)
        columns, sums, floor = self.columns, np.zeros(len(self.ids)), -np.inf
        whole = True  # nothing is compacted yet, so columns are used in place
        for step, at in enumerate(self.cuts):
            part = q[at : at + self.block]
            block = columns[at : at + self.block]
            gained = part @ (block if whole else block[:, alive])
            if whole:
                sums += gained
            else:
                sums = sums + gained
            rest = np.sqrt(np.square(q[at + self.block :]).sum()) * (1 + 1e-9)
            if step + 1 == len(self.cuts) or len(alive) <= k:
                continue
            seen = sums[alive] if whole else sums
            if step == 0:
                floor = self._floor(q, alive, seen, k)
            bound = seen + rest * self.left[step][alive]
            kept = bound >= floor
            if kept.mean() < 0.8:
                alive, sums, whole = alive[kept], seen[kept], False
        seen = sums[alive] if whole else sums
        best = grid.best(seen, self.ids[alive], own, k)
        return self.ids[alive][best], seen[best]

    def _floor(self, q: np.ndarray, alive: np.ndarray, seen: np.ndarray, k: int) -> float:
        # the k-th best full score among the rows that lead after the first block
        lead = min(len(alive), 16 * k)
        first = alive[np.argpartition(-seen, lead - 1)[:lead]]
        return float(np.partition(q @ self.columns[:, first], lead - k)[lead - k]) if lead >= k else -np.inf


def _big(vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    # components too large for exact doubles: whole numbers of any size, without pruning
    high = (1 << 63) - 1
    whole = [int(x) for x in query]
    scores = [min(high, max(-high - 1, sum(int(x) * y for x, y in zip(v, whole)))) for v in vectors]
    kept = sorted((-s, i) for s, i in zip(scores, ids.tolist()) if i != own)[:k]
    return np.array([i for _, i in kept], np.int64), np.array([-s for s, _ in kept], np.int64)
