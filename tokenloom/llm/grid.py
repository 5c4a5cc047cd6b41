"""A stated query set against all rows, in blocks, for the vector searches.

Rows and queries are dealt to groups of bounded size by a hash; every cell of the grid of row groups
and query groups is one task's work and gives its best few per query, which one ranking then joins.
A row is sent once per query group and a query once per row group, so no task holds more than one
group of each, whatever the table's size.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_GROUP = 1 << 17
QUERIES_PER_GROUP = 1 << 14
MIN_GROUPS = 12  # so that small tables use all cores


def usable(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``vec_id`` and ``vector`` (doubles) of the rows that take part: those with an id and a vector
    whose components are all finite."""
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~bad)


def query_rows(rows: DataFrame, chosen: Column) -> DataFrame:
    """One query for each chosen id: of rows that share the id, the greatest vector."""
    return rows.where(chosen).groupBy("vec_id").agg(F.max("vector").alias("vector"))


def search(
    rows: DataFrame, queries: DataFrame, cell: Callable[[pa.Table, pa.Table], pa.Table], k: int, score_type: str
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` highest scores, ties to the smaller id.

    ``cell`` gets a group of rows and a group of queries and gives ``query_id``, ``vec_id``, ``score``
    of at least the ``k`` best of its rows for each query.
    """
    n_rows, n_queries = rows.count(), queries.count()
    row_groups = max(MIN_GROUPS, math.ceil(n_rows / ROWS_PER_GROUP))
    query_groups = max(1, math.ceil(n_queries / QUERIES_PER_GROUP))
    dealt = rows.withColumns({
        "g": F.pmod(F.xxhash64(*rows.columns), F.lit(row_groups)),
        "q": F.explode(F.sequence(F.lit(0), F.lit(query_groups - 1))),
    })
    asked = queries.withColumns({
        "q": F.pmod(F.xxhash64("vec_id"), F.lit(query_groups)).cast("int"),
        "g": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_groups - 1).cast("long"))),
    })
    found = dealt.groupBy("g", "q").cogroup(asked.groupBy("g", "q")).applyInArrow(
        cell, f"query_id long, vec_id long, score {score_type}"
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of ``width`` doubles; a shorter one is filled up with zeros."""
    lists = column.combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    bounds, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    sizes = np.diff(bounds)
    if len(sizes) and (sizes == width).all():
        return flat[bounds[0] : bounds[-1]].reshape(len(sizes), width)
    made = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    made[row, np.arange(len(row)) - np.repeat(bounds[:-1] - bounds[0], sizes)] = flat[bounds[0] : bounds[-1]]
    return made


def widest(*columns: pa.ChunkedArray) -> int:
    import pyarrow.compute as pc

    return max((pc.max(pc.list_value_length(c)).as_py() or 0 for c in columns if len(c)), default=0)


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores whose id is not ``own``, ties to the smaller id."""
    at = np.flatnonzero(ids != own)
    if len(at) > k:
        cut = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= cut]
    return at[np.lexsort((ids[at], -scores[at]))][:k]
