"""Approximate nearest neighbours by randomly rotated one-bit codes.

The index keeps of every vector, less the centre, the signs of its randomly rotated components as
packed bits, and three numbers: its length, the inner product of its direction with its own code's
direction, and its inner product with the centre. From the bits and a query's rotated components,
rounded to a few bit planes, the inner product is estimated by counting bits; the correction says
how wide the estimate's error may be. Rows are reranked on the original vectors from the highest
upper bound down, until no bound reaches the k-th best exact score found.

The centre is the mean of a bounded sample; it only affects how tight the bounds are. Every row is
indexed.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm import grid
from tokenloom.llm.common import bounded_sample, ship_package

SAMPLE_ROWS = 4096  # rows the centre is taken from
PLANES = 4  # bits of a query component
WIDTH = 1.9  # of the error bound, in standard deviations of a random direction
SEED = 7
RERANK = 64  # rows reranked at a time


class Rotation:
    """The random rotation and centre of an index; of a fixed number of dimensions, zero-filled to
    whole 64-bit words."""

    def __init__(self, centre: np.ndarray, seed: int = SEED):
        self.dims = max(64, -(-len(centre) // 64) * 64)
        self.centre = np.zeros(self.dims)
        self.centre[: len(centre)] = centre
        basis, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(self.dims, self.dims)))
        self.basis = basis * np.sign(np.diag(r))

    def fitted(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors as rows of ``dims`` doubles."""
        return np.pad(vectors, ((0, 0), (0, self.dims - vectors.shape[1])))

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Packed codes, lengths, corrections and inner products with the centre."""
        from_centre = self.fitted(vectors) - self.centre
        length = np.sqrt(np.square(from_centre).sum(axis=1))
        turned = from_centre @ self.basis
        codes = np.packbits(turned > 0, axis=1, bitorder="little").view("<u8")
        fit = np.abs(turned).sum(axis=1) / np.sqrt(self.dims) / np.where(length > 0, length, 1)
        return codes, length, np.where(length > 0, fit, 1.0), from_centre @ self.centre


def fit(rows: DataFrame) -> Rotation | None:
    """A rotation whose centre is the mean of about ``SAMPLE_ROWS`` rows; none for an empty table."""
    sample = bounded_sample(rows, [F.col("vec_id"), F.col("vector")], SAMPLE_ROWS).select("vector").toArrow()
    width = rows.agg(F.max(F.size("vector"))).first()[0]
    return Rotation(grid.matrix(sample.column(0), width).mean(axis=0) if sample.num_rows else np.zeros(width)) if width else None


def build_index(rows: DataFrame, rotation: Rotation) -> DataFrame:
    """``vec_id``, ``code``, ``length``, ``fit``, ``to_centre``, ``vector`` of every row."""
    ship_package(rows.sparkSession)
    return rows.select("vec_id", "vector").mapInArrow(
        functools.partial(_index, rotation),
        "vec_id long, code binary, length double, fit double, to_centre double, vector array<double>",
    )


def _index(rotation: Rotation, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = pa.chunked_array([batch.column(1)])
        codes, length, fitted, to_centre = rotation.encode(grid.matrix(column, grid.widest(column)) if len(column) else np.zeros((0, 1)))
        columns = [batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(length), pa.array(fitted), pa.array(to_centre)]
        yield pa.RecordBatch.from_arrays([*columns, batch.column(1)], names=["vec_id", "code", "length", "fit", "to_centre", "vector"])


def nearest(df: DataFrame, chosen: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id``, ``score`` of the ``k`` rows found with the largest
    inner product, for each query; all rows, if there are fewer. Scores are exact, in doubles.

    ``chosen`` is a condition on ``vec_id`` that states the queries. A query's own row, that is every
    row with its id, is no candidate; other rows with equal ids or vectors all count. Rows with a null
    id or a vector that is null, empty, zero or has a null or non-finite component take no part.
    Vectors of unlike length are compared as if zeros followed the shorter. Ties go to the smaller
    id. Other columns are not read; an empty table gives no rows.
    """
    rows = grid.usable(df, vec_id, embedding)
    rows = rows.where(F.exists("vector", lambda x: x != 0))
    rotation = fit(rows)
    if rotation is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    index = build_index(rows, rotation)
    queries = grid.query_rows(rows, chosen)
    return grid.search(index, queries, functools.partial(_cell, rotation, k), k, "double")


def _cell(rotation: Rotation, k: int, rows: pa.Table, queries: pa.Table) -> pa.Table:
    out: list[tuple] = []
    if rows.num_rows and queries.num_rows:
        held = Codes(rotation, rows)
        vectors = rotation.fitted(grid.matrix(queries.column("vector"), grid.widest(queries.column("vector"))))
        out = [(q, *held.top(v, q, k)) for q, v in zip(queries.column("vec_id").to_pylist(), vectors)]
    return pa.table({
        "query_id": pa.array(np.repeat([o[0] for o in out], [len(o[1]) for o in out]).astype(np.int64) if out else [], pa.int64()),
        "vec_id": pa.array(np.concatenate([o[1] for o in out]) if out else [], pa.int64()),
        "score": pa.array(np.concatenate([o[2] for o in out]) if out else [], pa.float64()),
    })


class Codes:
    """A group of indexed rows: codes with one run of words for each 64 dimensions."""

    def __init__(self, rotation: Rotation, rows: pa.Table):
        self.rotation = rotation
        self.ids = rows.column("vec_id").to_numpy()
        words = np.frombuffer(b"".join(rows.column("code").to_pylist()), "<u8").reshape(len(self.ids), -1)
        self.words = np.ascontiguousarray(words.T)
        self.ones = np.bitwise_count(self.words).sum(axis=0, dtype=np.int64)
        self.length, self.fit, self.to_centre = (rows.column(c).to_numpy() for c in ("length", "fit", "to_centre"))
        self.vectors = rotation.fitted(grid.matrix(rows.column("vector"), grid.widest(rows.column("vector"))))
        dims = rotation.dims
        # how far the estimate of a unit direction may be off, for a unit query
        self.spread = WIDTH * np.sqrt(np.maximum(1 - self.fit**2, 0)) / self.fit / np.sqrt(dims - 1)

    def estimate(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products of all rows with a query, and their error bounds."""
        rotation, dims = self.rotation, self.rotation.dims
        from_centre = query - rotation.centre
        turned = from_centre @ rotation.basis
        low = turned.min()
        step = (turned.max() - low) / ((1 << PLANES) - 1) or 1.0
        levels = np.rint((turned - low) / step).astype(np.uint8)
        under = np.zeros(len(self.ids), np.int64)  # sum of the levels under a row's one bits
        for plane in range(PLANES):
            bits = np.packbits((levels >> plane) & 1, bitorder="little").view("<u8")
            for word, mask in zip(self.words, bits):
                under += np.bitwise_count(word & mask).astype(np.int64) << plane
        # signs are +1 and -1: twice what lies under ones, less the whole
        signed = 2 * (step * under + low * self.ones) - (step * int(levels.sum()) + low * dims)
        direction = signed / np.sqrt(dims) / self.fit
        rounding = step / 2 / self.fit  # each component is off by up to half a step, to either side
        length = np.sqrt(np.square(from_centre).sum())
        estimate = self.length * direction + self.to_centre + query @ rotation.centre
        return estimate, self.length * (self.spread * length + rounding)

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the best ``k`` rows found, best first."""
        estimate, error = self.estimate(query)
        upper = np.where(self.ids != own, estimate + error, -np.inf)
        n = int((self.ids != own).sum())
        first = np.argpartition(-upper, min(n, 4 * k) - 1)[: min(n, 4 * k)] if n else np.zeros(0, int)
        scores = self._exact(first, query)
        floor = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) > k else -np.inf
        upper[first] = -np.inf
        rest = np.flatnonzero(upper >= floor) if n > len(first) else first[:0]
        rest = rest[np.argsort(-upper[rest], kind="stable")]
        for at in range(0, len(rest), RERANK):
            part = rest[at : at + RERANK]
            if upper[part[0]] < floor:
                break
            first, scores = np.concatenate([first, part]), np.concatenate([scores, self._exact(part, query)])
            floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        best = grid.best(scores, self.ids[first], own, k)
        return self.ids[first][best], scores[best]

    def _exact(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        # one row's sum does not depend on the rows beside it, so equal vectors tie
        return (self.vectors[rows] * query).sum(axis=1)
