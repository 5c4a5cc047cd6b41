"""Variable-capacity best-fit packing of token sequences.

Pieces are dealt to groups of bounded size by a hash and every group is packed on its own, longest
piece first. A piece goes to the open bin it leaves least room in; if it fits none, the permitted
length is opened that costs least for each token the group can still put into it. When all pieces
are placed, every bin shrinks to the smallest permitted length that holds its contents.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.llm.common import materialize, ship_package, word_windows

LENGTHS = (256, 512, 1024, 2048, 4096)
OVERHEAD = 32  # what a sequence costs beside its length, in tokens
GROUP_PIECES = 1 << 15  # pieces packed together, about


def word_count(text: str = "text") -> Column:
    """The length of a text in words, cut at ASCII white space; zero for null."""

    def count(texts: pa.Array) -> pa.Array:
        return pa.array([sum(map(len, word_windows(t.as_py() or b""))) for t in texts], pa.int64())

    return F.arrow_udf(count, T.LongType())(F.col(text).cast("binary"))


def pack(
    docs: DataFrame, length: Column, lengths: Sequence[int] = LENGTHS, overhead: int = OVERHEAD, doc_id: str = "doc_id"
) -> DataFrame:
    """One row for each piece of every row: ``doc_id``, ``piece`` from 0, ``start``, ``n_tokens``,
    ``bin_id``, ``bin_start``, ``bin_capacity``, ``bin_used``.

    A row longer than the greatest permitted length is cut to pieces of that length and a rest. A row
    of length zero, or of a null or negative one, is one piece of length 0 in no bin: its bin columns
    are null. Repeated rows and null ids are packed like others. Other columns are not read, and an
    empty table gives an empty result.
    """
    lengths = tuple(sorted(set(lengths)))
    if not lengths or lengths[0] < 1:
        raise ValueError("permitted lengths must be positive")
    ship_package(docs.sparkSession)
    most = lengths[-1]
    size = F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0))
    # The number of a row is written with it, so that ties and groups do not change in a rerun.
    rows = docs.select(F.col(doc_id).alias("doc_id"), size.alias("size"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows, "lengths")
    total = rows.agg(F.sum(F.ceil(F.col("size") / most))).first()[0] or 0
    groups = max(1, math.ceil(total / GROUP_PIECES))
    pieces = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"greatest(size - 1, 0L) div {most}L"))).alias("piece"))
    pieces = pieces.select(
        "doc_id", "row", "piece", (F.col("piece") * most).alias("start"),
        F.least(F.lit(most), F.col("size") - F.col("piece") * most).cast("long").alias("n_tokens"),
    )
    grouped = pieces.where("n_tokens > 0").withColumn("grp", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)))
    bins = [T.StructField(n, T.LongType()) for n in ("bin_id", "bin_start", "bin_capacity", "bin_used")]
    schema = T.StructType([*(pieces.schema[c] for c in ("doc_id", "piece", "start", "n_tokens")), *bins])
    packed = grouped.groupBy("grp").applyInArrow(_packing(lengths, overhead), schema)
    nowhere = [F.lit(None).cast("long").alias(b.name) for b in bins]
    return packed.unionByName(pieces.where("n_tokens = 0").select("doc_id", "piece", "start", "n_tokens", *nowhere))


def _packing(lengths: tuple[int, ...], overhead: int):
    def pack_group(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("n_tokens", "descending"), ("row", "ascending"), ("piece", "ascending")])
        at, starts, used = best_fit(rows.column("n_tokens").to_numpy(), lengths, overhead)
        fitted = np.array(lengths)[np.searchsorted(lengths, used)]
        made = rows.select(["doc_id", "piece", "start", "n_tokens"])
        ids = (rows.column("grp")[0].as_py() << 32) + at
        for name, values in (("bin_id", ids), ("bin_start", starts), ("bin_capacity", fitted[at]), ("bin_used", used[at])):
            made = made.append_column(name, pa.array(values, pa.int64()))
        return made

    return pack_group


def best_fit(sizes: np.ndarray, lengths: Sequence[int], overhead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bin of each piece, its start there, and what each bin holds; ``sizes`` fall.

    Bins with the same room are taken last opened first. ``room`` has a bit for every amount of room
    some open bin has, so the least room that is enough is its lowest bit at or above the piece.
    """
    most = lengths[-1]
    below = np.concatenate([[0], np.cumsum(np.bincount(sizes, minlength=most + 1) * np.arange(most + 1))]).tolist()
    rest = int(sizes.sum())
    bins_with: list[list[int]] = [[] for _ in range(most + 1)]
    room, used = 0, []
    at, starts = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i, size in enumerate(sizes.tolist()):
        rest -= size
        enough = room >> size
        if enough:
            left = size + (enough & -enough).bit_length() - 1
            chosen = bins_with[left].pop()
            if not bins_with[left]:
                room ^= 1 << left
            left -= size
        else:
            capacity = _cheapest(size, rest, below, lengths, overhead)
            chosen, left = len(used), capacity - size
            used.append(0)
        at[i], starts[i] = chosen, used[chosen]
        used[chosen] += size
        if left:
            if not bins_with[left]:
                room ^= 1 << left
            bins_with[left].append(chosen)
    return at, starts, np.array(used, np.int64)


def _cheapest(size: int, rest: int, below: list[int], lengths: Sequence[int], overhead: int) -> int:
    # what can still come into a bin: the unplaced pieces that fit beside this one
    best = None
    for capacity in lengths:
        if capacity >= size:
            beside = capacity - size
            coming = rest if beside >= size else min(rest, below[beside + 1])
            cost = (capacity + overhead) / min(capacity, size + coming)
            if best is None or cost < best[0]:
                best = (cost, capacity)
    return best[1]
