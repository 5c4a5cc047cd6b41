"""Helpers the operators share: bounded samples and local connected components."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.session import bound_batches, remove, ship_package, work_path

__all__ = ["among", "bound_batches", "bounded_sample", "drop_tables", "local_roots", "materialize", "ship_package", "word_windows"]

_BUCKETS = 1 << 30


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts its lineage. The shuffle
    files of the write are deleted with its end; they would stay until the driver collects garbage."""
    conf, path = df.sparkSession.conf, work_path(df.sparkSession, label)
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_CLEANUP, before)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.written_to = path
    return made


def drop_tables(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for table in tables:
        remove(table.sparkSession, table.written_to)


_WHITE = re.compile(rb"[ \t\n\r\x0b\x0c]")


def word_windows(text: bytes, size: int = 1 << 22) -> Iterator[list[bytes]]:
    """The words of a text, cut at ASCII white space, in lists from about ``size`` bytes each, so that a
    very long text never becomes one list."""
    lo = 0
    while lo < len(text):
        cut = _WHITE.search(text, lo + size) if lo + size < len(text) else None
        hi = cut.start() if cut else len(text)
        yield text[lo:hi].split()
        lo = hi + 1


def bounded_sample(df: DataFrame, by: Sequence[Column], rows: int) -> DataFrame:
    """About ``rows`` rows, at most twice as many, chosen by a hash of ``by`` so that a rerun chooses
    the same ones. For fitting only: nothing that decides which rows are kept may use it."""
    total = df.count()
    share = math.ceil(_BUCKETS * min(1.0, rows / max(total, 1)))
    place = F.pmod(F.xxhash64(*by), F.lit(_BUCKETS))
    return df.where(place < share).orderBy(place, *by).limit(2 * rows)


FILTER_BITS = 1 << 26


def filter_bits(ids: DataFrame, column: str) -> np.ndarray:
    """Bits of fixed number, 8 MB, that say which whole numbers may be in ``column``."""
    bit = F.pmod(F.col(column), F.lit(FILTER_BITS))
    blocks = ids.select(F.floor(bit / 32768).cast("int").alias("at"), F.pmod(bit, F.lit(32768)).alias("bit"))
    rows = blocks.groupBy("at").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()  # 2,048 rows of 4 KB at most
    bits = np.zeros((FILTER_BITS // 32768, 4096), np.uint8)
    for row in rows:
        bits[row.at] = np.frombuffer(row.bits, np.uint8)
    return bits.ravel()


def may_hold(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value may be among those the bits were made from."""
    at = np.mod(values, FILTER_BITS)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def among(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows whose ``column`` may be among ``ids``, a written table, so that a join with it moves few others."""
    sent = rows.sparkSession.sparkContext.broadcast(filter_bits(ids, column))

    @F.arrow_udf("boolean")
    def passes(values: pa.Array) -> pa.Array:
        return pa.array(may_hold(sent.value, values.to_numpy(zero_copy_only=False)))

    return rows.where(passes(F.col(column)))


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index each of ``n`` nodes is connected to by the edges ``a[i]``-``b[i]``."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        live = low != high
        if not live.any():
            break
        a, b, low, high = a[live], b[live], low[live], high[live]
        np.minimum.at(root, high, low)
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root = jumped
    return root
