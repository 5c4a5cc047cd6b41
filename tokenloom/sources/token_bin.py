"""Binary token files: 16-bit little-endian ids, with or without a 16-byte header.

``read_tokens`` reads one file or a folder of shards in parallel byte ranges as blocks of
``start_pos``, ``ids``; ``write_tokens`` writes shards of a fixed number of tokens, each a token file
of its own, and a manifest with their lengths. Documents are cut at shard borders, so a shard's
header is known before its ids and every byte is written once, under its final name. Files of lost
tasks are in no manifest and are never read.

Comparisons of ``start_pos`` with numbers are pushed into the reader, which then opens only the ranges,
and reads only the blocks, that they leave; ``read_positions`` gives the ids of a range of positions so.

Files are reached through ``pyarrow.fs``, so any address it knows will do; a path without a scheme
belongs to the cluster's default file system.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from tokenloom.functions.numbers import div
from tokenloom.session import qualified, ship_package

# The header is this number and the token count, both 8 bytes little-endian.
MAGIC = 0x544F4B454E53
HEADER_BYTES = 16
MANIFEST = "_manifest.json"

TOKENS_PER_SHARD = 1 << 27
_LEAST_SHARD = 1 << 20
_RANGE_TOKENS = 1 << 24  # tokens per input partition
_BLOCK_TOKENS = 1 << 16  # tokens per row


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _flag(options, name: str, default: str) -> bool:
    return options.get(name, default).lower() == "true"


_END = 1 << 62


def _start_bounds(one: Filter) -> tuple[int, int] | None:
    """The least and the largest ``start_pos`` that a filter passes; None if it is about something else."""
    if getattr(one, "attribute", None) != ("start_pos",):
        return None
    match one:
        case IsNotNull():
            return 0, _END
        case EqualTo(value=int(v)):
            return v, v
        case GreaterThan(value=int(v)):
            return v + 1, _END
        case GreaterThanOrEqual(value=int(v)):
            return v, _END
        case LessThan(value=int(v)):
            return 0, v - 1
        case LessThanOrEqual(value=int(v)):
            return 0, v
    return None


@dataclass
class TokenRange(InputPartition):
    file: str
    offset: int
    n_tokens: int
    start_pos: int


class TokenReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.header = _flag(options, "header", "true")
        self.least, self.most = 0, _END

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what bounds ``start_pos``; the rest is Spark's."""
        for one in filters:
            bounds = _start_bounds(one)
            if bounds is None:
                yield one
            else:
                self.least, self.most = max(self.least, bounds[0]), min(self.most, bounds[1])

    def _lengths(self, system: fs.FileSystem, root: str) -> list[tuple[str, int]]:
        """Files and their token counts, each count checked against the file's size."""
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(root)
        if info.type == fs.FileType.File:
            return [(root, self._length(system, root, info.size))]
        with system.open_input_stream(f"{root}/{MANIFEST}") as f:
            shards = json.loads(f.read())["shards"]
        sizes = {i.base_name: i.size for i in system.get_file_info(fs.FileSelector(root))}
        for shard in shards:
            if sizes.get(shard["name"]) != self._bytes(shard["n_tokens"]):
                raise ValueError(f"{root}/{shard['name']} is missing or has not the size its manifest says")
        return [(f"{root}/{shard['name']}", shard["n_tokens"]) for shard in shards]

    def _bytes(self, n_tokens: int) -> int:
        return 2 * n_tokens + (HEADER_BYTES if self.header else 0)

    def _length(self, system: fs.FileSystem, file: str, size: int) -> int:
        if not self.header:
            if size % 2:
                raise ValueError(f"a token file has whole ids; {file} has {size} bytes")
            return size // 2
        with system.open_input_file(file) as f:
            head = f.read(HEADER_BYTES)
        if len(head) < HEADER_BYTES or struct.unpack("<Q", head[:8])[0] != MAGIC:
            raise ValueError(f"not a token file with a header: {file}")
        length = struct.unpack("<Q", head[8:])[0]
        if size != self._bytes(length):
            raise ValueError(f"{file} has {size} bytes but says it holds {length} ids")
        return length

    def partitions(self) -> list[TokenRange]:
        system, root = _open(self.path)
        ranges, pos = [], 0
        for file, length in self._lengths(system, root):
            base = HEADER_BYTES if self.header else 0
            for at in range(0, length, _RANGE_TOKENS):
                start, n = pos + at, min(_RANGE_TOKENS, length - at)
                first = max(0, -((start - self.least) // _BLOCK_TOKENS)) * _BLOCK_TOKENS
                end = min(n, ((self.most - start) // _BLOCK_TOKENS + 1) * _BLOCK_TOKENS)
                if first < end:
                    ranges.append(TokenRange(file, base + 2 * (at + first), end - first, start + first))
            pos += length
        return ranges

    def read(self, part: TokenRange | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # a store without tokens has no ranges
            return
        system, _ = _open(self.path)
        with system.open_input_file(part.file) as f:
            f.seek(part.offset)
            for at in range(0, part.n_tokens, _BLOCK_TOKENS):
                n = min(_BLOCK_TOKENS, part.n_tokens - at)
                ids = np.frombuffer(f.read(2 * n), "<u2").astype(np.int32)
                row = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.start_pos + at], pa.int64()), row], names=["start_pos", "ids"]
                )


@dataclass
class Shards(WriterCommitMessage):
    written: list[tuple[int, str, int]]  # number, file name, tokens


class TokenWriter(DataSourceArrowWriter):
    """Rows of a task come by position, cut at shard borders. Each shard is written once, behind a
    header that follows from its number; the commit lists the shards in the manifest."""

    def __init__(self, options):
        self.path = options["path"]
        self.header = _flag(options, "header", "true")
        self.per_shard, self.total = int(options["tokens_per_shard"]), int(options["total"])
        system, root = _open(self.path)
        if system.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File:
            raise ValueError(f"a token store already exists at {root}")
        system.create_dir(root, recursive=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Shards:
        system, root = _open(self.path)
        done, out, shard, pos = [], None, None, None

        def close():
            out.close()
            if pos != min(self.total, (shard + 1) * self.per_shard):
                raise ValueError(f"the stream ends or has a gap at position {pos}")

        for batch in batches:
            starts, lists = batch.column("start_pos").to_numpy(), batch.column("ids")
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            if len(ids) and (ids.min() < 0 or ids.max() > 65535):
                raise ValueError("token ids must fit 16 bits")
            numbers = starts // self.per_shard
            ends = np.cumsum(sizes)
            cuts = np.flatnonzero(np.diff(numbers)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(starts)]):
                if lo == hi:
                    continue
                if numbers[lo] != shard:
                    if out is not None:
                        close()
                    shard = int(numbers[lo])
                    pos = shard * self.per_shard
                    length = min(self.total - pos, self.per_shard)
                    name = f"part-{shard:06d}-{uuid.uuid4().hex[:8]}.bin"
                    out = system.open_output_stream(f"{root}/{name}")
                    done.append((shard, name, length))
                    if self.header:
                        out.write(struct.pack("<QQ", MAGIC, length))
                want = pos + ends[lo:hi] - sizes[lo:hi] - (ends[lo] - sizes[lo])
                if not np.array_equal(want, starts[lo:hi]):
                    raise ValueError(f"stream has a gap or overlap at position {int(starts[lo:hi][want != starts[lo:hi]][0])}")
                first, last = ends[lo] - sizes[lo], ends[hi - 1]
                out.write(ids[first:last].astype("<u2").tobytes())
                pos += int(last - first)
        if out is not None:
            close()
        return Shards(done)

    def commit(self, messages: list[Shards | None]) -> None:
        system, root = _open(self.path)
        shards = sorted(w for m in messages if m for w in m.written)
        if [n for n, _, _ in shards] != list(range(-(-self.total // self.per_shard))):
            self.abort(messages)
            raise ValueError("the stream does not cover all positions once")
        listed = [{"name": name, "n_tokens": length} for _, name, length in shards]
        with system.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps({"shards": listed, "n_tokens": self.total}).encode())

    def abort(self, messages: list[Shards | None]) -> None:
        system, root = _open(self.path)
        for _, name, _ in (w for m in messages if m for w in m.written):
            if system.get_file_info(f"{root}/{name}").type == fs.FileType.File:
                system.delete_file(f"{root}/{name}")


class TokenBin(DataSource):
    @classmethod
    def name(cls) -> str:
        return "token_bin"

    def schema(self) -> str:
        return "start_pos long, ids array<int>"

    def reader(self, schema) -> TokenReader:
        return TokenReader(self.options)

    def writer(self, schema, overwrite: bool) -> TokenWriter:
        return TokenWriter(self.options)


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TokenBin)


def read_tokens(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Blocks of a token file or folder: ``start_pos``, ``ids``. A file whose size is not what its header
    or manifest says raises an error."""
    register(spark)
    return spark.read.format("token_bin").option("header", str(header).lower()).load(qualified(spark, path))


def read_positions(spark: SparkSession, path: str, start: int, end: int, header: bool = True) -> DataFrame:
    """The ids at positions from ``start`` up to ``end`` (exclusive) as blocks ``start_pos``, ``ids``. Only
    the blocks that hold them are read, and the last ones of a shard just ahead; a part beyond the end is empty."""
    if not 0 <= start <= end:
        raise ValueError("positions must ascend from 0")
    blocks = read_tokens(spark, path, header).where((F.col("start_pos") > start - _BLOCK_TOKENS) & (F.col("start_pos") < end))
    lo = F.greatest("start_pos", F.lit(start))
    hi = F.least(F.col("start_pos") + F.size("ids"), F.lit(end))
    ids = F.slice("ids", (lo - F.col("start_pos") + 1).cast("int"), (hi - lo).cast("int"))
    return blocks.where(hi > lo).select(lo.alias("start_pos"), ids.alias("ids"))


def write_tokens(stream: DataFrame, path: str, header: bool = True, tokens_per_shard: int | None = TOKENS_PER_SHARD) -> None:
    """Write a stream, which starts at position 0, as shards in position order, each a token file of
    its own: of ``tokens_per_shard``, or fewer where that leaves cores without a shard.
    ``tokens_per_shard=None`` gives one file, written by one task."""
    spark = stream.sparkSession
    register(spark)
    total = stream.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    even = max(_LEAST_SHARD, -(-total // spark.sparkContext.defaultParallelism))
    size = min(tokens_per_shard, even) if tokens_per_shard else max(total, 1)
    shards = max(1, -(-total // size))
    lo, hi = F.greatest("start_pos", F.col("shard") * size), F.least(F.col("end_pos"), (F.col("shard") + 1) * size)
    cut = (
        stream.where("n_tokens > 0")
        .withColumn("end_pos", F.col("start_pos") + F.col("n_tokens"))
        .withColumn("shard", F.explode(F.sequence(div(F.col("start_pos"), size), div(F.col("end_pos") - 1, size))))
        .withColumn("whole", (lo == F.col("start_pos")) & (hi == F.col("end_pos")))
        .select(
            "shard",
            lo.alias("start_pos"),
            F.when(F.col("whole"), F.col("ids"))
            .otherwise(F.slice("ids", (lo - F.col("start_pos") + 1).cast("int"), (hi - lo).cast("int")))
            .alias("ids"),
        )
    )
    placed = cut.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("start_pos")
    options = {"header": str(header).lower(), "tokens_per_shard": size, "total": total}
    placed.select("start_pos", "ids").write.format("token_bin").mode("append").options(**options).save(qualified(spark, path))


def as_stream(blocks: DataFrame) -> DataFrame:
    """Blocks in the shape the stream operators take."""
    return blocks.select(
        F.col("start_pos").alias("doc_id"), "ids", F.size("ids").cast("long").alias("n_tokens"), "start_pos"
    )
