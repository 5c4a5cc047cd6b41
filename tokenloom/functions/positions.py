"""Global row numbers and running sums without a single-task window.

A window with no partition key, or one keyed by a hot value, runs in one task. Both helpers here
work in two phases instead: a running value inside bounded blocks, and the totals of the blocks
ahead, which is a table of one row per block.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_before(
    df: DataFrame,
    name: str,
    value: Column,
    block: str,
    order_by: Sequence[str],
    within: Sequence[str] = (),
) -> DataFrame:
    """Add ``name``: the sum of the whole number ``value`` over the rows ahead of each row.

    Rows are ordered by ``block`` and then ``order_by`` inside each ``within`` group. ``block``
    must grow with the order, and one block must fit a task; a group may span any number of them.
    Neither ``block`` nor ``within`` may hold nulls.
    """
    zero = F.lit(0).cast("long")
    local, ahead = _two_phase(df, value.cast("long"), F.sum, block, order_by, within)
    return _joined(local, ahead, block, within, name, F.coalesce("_local", zero) + F.coalesce("_ahead", zero))


def running_min_before(
    df: DataFrame, name: str, value: Column, block: str, order_by: Sequence[str], within: Sequence[str] = ()
) -> DataFrame:
    """As ``running_before``, with the least ``value`` ahead of each row; null on the first."""
    local, ahead = _two_phase(df, value, F.min, block, order_by, within)
    return _joined(local, ahead, block, within, name, F.least("_local", "_ahead"))


def _two_phase(df, value, combine, block, order_by, within):
    keys = [*within, block]
    rows_ahead = Window.partitionBy(*keys).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    blocks_ahead = Window.partitionBy(*within).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    valued = df.withColumn("_v", value)
    totals = valued.groupBy(*keys).agg(combine("_v").alias("_total"))
    return (
        valued.withColumn("_local", combine("_v").over(rows_ahead)),
        totals.select(*keys, combine("_total").over(blocks_ahead).alias("_ahead")),
    )


def _joined(local, ahead, block, within, name, result):
    return local.join(ahead, [*within, block]).withColumn(name, result).drop("_v", "_local", "_ahead")


MAX_BLOCKS = 1 << 20  # keeps the block tables small enough to broadcast
_SAMPLES_PER_BLOCK = 8
_SAMPLED_KEYS = 20_000


def range_block(
    df: DataFrame,
    key: str,
    rows_per_block: int = 1_000_000,
    min_blocks: int | None = None,
    size: Column | None = None,
    size_per_block: int | None = None,
) -> tuple[Column, int]:
    """A column that cuts the integer ``key`` into blocks of about equal row count, in key order; with
    ``size`` of about equal size, so that few heavy rows make a block as many light ones do. One
    row is never cut.

    Only the key and size are read. The bounds are taken from a sample of the keys and fixed as a
    literal, so every later evaluation puts a row in the same block; any bounds give the same
    result, and a few numbers per block reach the driver. Returns the column and the block count;
    more than ``MAX_BLOCKS`` blocks are refused, as their table could not be broadcast.
    """
    weight = F.lit(1) if size is None else F.coalesce(size, F.lit(0)) + 1
    keys = df.select(F.col(key).cast("long").alias("k"), weight.cast("long").alias("w"))
    rows, total = keys.agg(F.count("*"), F.coalesce(F.sum("w"), F.lit(0))).first()
    floor = min_blocks if min_blocks is not None else 4 * df.sparkSession.sparkContext.defaultParallelism
    blocks = max(math.ceil(rows / rows_per_block), min(floor, rows), 1)
    if size_per_block:
        blocks = max(blocks, min(math.ceil(total / size_per_block), rows))
    if blocks > MAX_BLOCKS:
        raise ValueError(f"{blocks} blocks are more than {MAX_BLOCKS}; make them larger")
    if blocks == 1:
        return F.lit(0).cast("int"), 1
    # a row comes as often as its size is a multiple of a sample's, the rest by the hash of its key
    share = _SAMPLES_PER_BLOCK * blocks / total
    drawn = F.floor(F.col("w") * share + F.pmod(F.xxhash64("k", "w"), F.lit(1 << 30)) / float(1 << 30)).alias("n")
    taken = keys.select("k", drawn).where("n > 0").toArrow()
    sample = np.sort(np.repeat(taken.column("k").to_numpy(), taken.column("n").to_numpy()))
    cuts = np.linspace(0, len(sample), blocks, endpoint=False)[1:].astype(int)
    bounds = np.unique(sample[cuts]).tolist() if len(sample) else []
    return sorted_position(bounds, F.col(key).cast("long")), len(bounds) + 1


def first_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows by the columns ``order``, which hold no nulls; all rows, if there are fewer.

    A sample of the keys gives a bound that a few more than ``n`` rows pass, which is counted; only
    these are sorted, so a task never gets ``n`` rows from every other one.
    """
    keys = df.select(*order)
    total = keys.count()
    if total <= n:
        return df
    share = min(1.0, _SAMPLED_KEYS / total)
    sample = keys.sample(share, seed=1).orderBy(*order).collect()
    want = n * share
    at = math.ceil(want + 4 * math.sqrt(want)) + 4
    passing = df
    while at < len(sample):
        bound = F.struct(*[F.lit(v).cast(keys.schema[c].dataType).alias(c) for c, v in zip(order, sample[at])])
        passing = df.where(F.struct(*order) <= bound)
        if passing.count() >= n:
            break
        passing, at = df, 2 * at
    return passing.orderBy(*order).limit(n)


def sorted_position(bounds: Sequence[int], value: Column) -> Column:
    """How many of the ascending ``bounds`` are at or below ``value``, by binary search."""
    if not bounds:
        return F.lit(0).cast("int")
    table = F.from_json(F.lit(json.dumps(list(bounds))), "array<bigint>")
    strides = [1 << b for b in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(s) for s in strides]),
        F.lit(0),
        lambda at, stride: F.when(F.get(table, at + stride - 1) <= value, at + stride).otherwise(at),
    )
