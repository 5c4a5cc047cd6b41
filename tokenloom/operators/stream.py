"""One addressable stream of token ids over all documents.

The stream is a table: one row per document with its ids and its interval of positions. It is
written block by block (``write_stream``) next to a small table of the blocks, and read with the
global start of each document (``read_stream``), so no step numbers rows in a single task. The
written table is what a token file is elsewhere; slices, splits and packing all read it, and a
range of positions reads only the blocks that hold it.

Operators that need the length of the stream take it as ``total`` (see ``stream_total``); without
it they add up ``n_tokens``, which reads that column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.functions.numbers import div
from tokenloom.functions.positions import range_block, sorted_position
from tokenloom.operators.encode import encode
from tokenloom.session import bound_batches, ship_package, work_path, write_wide

SPAN = 1 << 16  # positions per join key when requests meet documents
BYTES_PER_BLOCK = 256 << 20  # text of one block, about
_RANGES = 64  # block ranges a read names at most; more are joined over the smallest gaps


def write_stream(
    docs: DataFrame,
    ids_of: Callable[[Column], Column],
    path: str,
    key: str = "doc_id",
    text: str = "text",
    add_eos: bool = True,
    rows_per_block: int = 1_000_000,
    bytes_per_block: int = BYTES_PER_BLOCK,
) -> None:
    """Encode documents in ``key`` order and write them with their start inside their block.

    A block holds about ``bytes_per_block`` of text at most, and at least one document. One shuffle
    gives every block a task of its own; encoding and the running sum follow in the same stage, and
    each file of the table holds one block. ``path`` gets the folders ``rows`` and ``blocks``.
    """
    spark = docs.sparkSession
    ship_package(spark)
    bound_batches(spark)
    block, n_blocks = range_block(docs, key, rows_per_block, size=F.octet_length(text), size_per_block=bytes_per_block)
    placed = docs.select(F.col(key).cast("long").alias(key), text).withColumn("block", block)
    placed = placed.repartitionById(n_blocks, F.col("block")).sortWithinPartitions("block", key)
    rows = (
        encode(placed, ids_of, text, add_eos=add_eos)
        .select("block", F.col(key).alias("doc_id"), "ids", F.size("ids").cast("long").alias("n_tokens"))
        .mapInArrow(_with_starts, "block int, doc_id long, ids array<int>, n_tokens long, local_start long")
    )
    write_wide(rows, f"{path}/rows")
    blocks_ahead = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    (
        spark.read.parquet(f"{path}/rows")
        .groupBy("block")
        .agg(F.sum("n_tokens").alias("n_tokens"))
        .withColumn("block_start", F.coalesce(F.sum("n_tokens").over(blocks_ahead), F.lit(0)))
        .write.parquet(f"{path}/blocks")
    )


def _with_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add ``local_start``, the tokens ahead of a row in its block. The rows of a task come by block, and
    a block is in one task, so nothing is held but a sum."""
    ahead, base, block = 0, 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column("n_tokens").fill_null(0).to_numpy(zero_copy_only=False)
        blocks = batch.column("block").to_numpy(zero_copy_only=False)
        starts = ahead + np.cumsum(sizes) - sizes
        bases = np.full(len(starts), base, np.int64)
        for at in np.flatnonzero(np.concatenate([[blocks[0] != block], blocks[1:] != blocks[:-1]])):
            bases[at:] = starts[at]
        ahead, base, block = ahead + int(sizes.sum()), int(bases[-1]), blocks[-1]
        yield batch.append_column("local_start", pa.array(starts - bases, pa.int64()))


def read_stream(spark: SparkSession, path: str, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """``doc_id``, ``ids``, ``n_tokens``, ``start_pos`` of a written stream.

    With ``lo`` and ``hi`` only documents that overlap these positions are read: the block numbers
    in question become a filter on the files. The block table has at most ``MAX_BLOCKS`` rows of
    three numbers (see ``range_block``), which is checked when it is written, so it is broadcast.
    """
    rows, blocks = _tables(spark, path)
    start, end = F.col("start_pos"), F.col("start_pos") + F.col("n_tokens")
    wanted = F.lit(True)
    if lo is not None or hi is not None:
        lo, hi = lo or 0, (1 << 62) if hi is None else hi
        held = (F.col("block_start") < hi) & (F.col("block_start") + F.col("n_tokens") > lo)
        edge = blocks.where(held).agg(F.min("block").alias("first"), F.max("block").alias("last")).first()
        first, last = (edge.first, edge.last) if edge.first is not None else (1, 0)
        rows = rows.where(F.col("block").between(first, last))
        wanted = (start < hi) & (end > lo)
    return _placed(rows, blocks).where(wanted)


def read_spans(spark: SparkSession, path: str, spans: DataFrame) -> DataFrame:
    """A written stream as far as it may hold any of the spans (``lo``, ``hi``).

    The spans meet the block table, and only the blocks that hold one are read.
    """
    rows, blocks = _tables(spark, path)
    table = blocks.orderBy("block").collect()
    starts = [b.block_start for b in table]
    first = F.greatest(sorted_position(starts, F.col("lo")) - 1, F.lit(0))
    last = sorted_position(starts, F.col("hi") - 1) - 1
    held = spans.where("hi > lo").select(F.explode(F.when(last >= first, F.sequence(first, last))).alias("i")).distinct()
    wanted = [table[r.i].block for r in held.orderBy("i").collect()]
    return _placed(rows.where(_in_ranges(wanted)), blocks)


def _tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/blocks")


def _placed(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(blocks.select("block", "block_start")), "block").select(
        "doc_id", "ids", "n_tokens", (F.col("block_start") + F.col("local_start")).alias("start_pos")
    )


def _in_ranges(wanted: list[int]) -> Column:
    """A filter on ``block`` that the files can answer: a few ranges that hold all wanted blocks."""
    gaps = sorted(range(1, len(wanted)), key=lambda i: wanted[i] - wanted[i - 1], reverse=True)
    cuts = sorted(i for i in gaps[: _RANGES - 1] if wanted[i] - wanted[i - 1] > 1)
    edges = [0, *cuts, len(wanted)]
    held = F.lit(False)
    for lo, hi in zip(edges, edges[1:]):
        if lo < hi:
            held = held | F.col("block").between(wanted[lo], wanted[hi - 1])
    return held


def stream_total(spark: SparkSession, path: str) -> int:
    """The number of tokens of a written stream, from its block table."""
    return spark.read.parquet(f"{path}/blocks").agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first().n


def token_stream(docs: DataFrame, ids_of: Callable[[Column], Column], **options) -> DataFrame:
    """Write a stream to the shared working folder and read it."""
    spark = docs.sparkSession
    path = work_path(spark, "stream")
    write_stream(docs, ids_of, path, **options)
    return read_stream(spark, path)


def total_tokens(stream: DataFrame, total: int | None = None) -> Column:
    if total is not None:
        return F.lit(total).cast("long")
    return F.coalesce(stream.agg(F.sum("n_tokens")).scalar(), F.lit(0))


def check_ids(stream: DataFrame, vocab_size: int | Column = 65536, ids: str = "ids") -> DataFrame:
    """Documents whose ids do not fit 16 bits or the vocabulary, with the offending ids counted."""
    size = vocab_size if isinstance(vocab_size, Column) else F.lit(vocab_size)
    narrow = F.size(F.filter(ids, lambda i: (i < 0) | (i > 65535)))
    out = stream.withColumn("_size", size)
    unknown = F.size(F.filter(ids, lambda i: i >= F.col("_size")))
    return (
        out.select("doc_id", narrow.cast("long").alias("not_uint16"), unknown.cast("long").alias("not_in_vocab"))
        .where((F.col("not_uint16") > 0) | (F.col("not_in_vocab") > 0))
    )


def _clipped(requests: DataFrame, stream: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Each request with the parts of documents inside ``[lo, hi)``: ``request_id``, ``at``, ``part``,
    and the columns ``keep``.

    Both sides are spread over spans of positions, so a long request or a span that many requests
    ask for is many join rows rather than one large group; a part is cut to its span, so no token
    comes twice.
    """

    def spans(lo: str, hi: str) -> Column:
        return F.when(F.col(hi) > F.col(lo), F.sequence(div(F.col(lo), SPAN), div(F.col(hi) - 1, SPAN)))

    asked = requests.withColumn("span", F.explode(spans("lo", "hi")))
    held = (
        stream.withColumn("end_pos", F.col("start_pos") + F.col("n_tokens"))
        .withColumn("span", F.explode(spans("start_pos", "end_pos")))
        .select(
            "span",
            F.greatest("start_pos", F.col("span") * SPAN).alias("from_pos"),
            F.least("end_pos", (F.col("span") + 1) * SPAN).alias("to_pos"),
            "start_pos",
            "ids",
        )
        .select(
            "span",
            "from_pos",
            "to_pos",
            F.slice("ids", (F.col("from_pos") - F.col("start_pos") + 1).cast("int"), (F.col("to_pos") - F.col("from_pos")).cast("int")).alias("held"),
        )
    )
    at, to = F.greatest("lo", "from_pos"), F.least("hi", "to_pos")
    return (
        asked.join(held, "span")
        .where((F.col("lo") < F.col("to_pos")) & (F.col("hi") > F.col("from_pos")))
        .select(
            "request_id",
            *keep,
            at.alias("at"),
            F.slice("held", (at - F.col("from_pos") + 1).cast("int"), (to - at).cast("int")).alias("part"),
        )
    )


def token_at(stream: DataFrame, requests: DataFrame, total: int | None = None) -> DataFrame:
    """The id at each ``pos`` of (``request_id``, ``pos``); a negative one counts from the end, one
    outside the stream gives an ``error`` and no id. For a written stream, ``read_token_at`` reads
    only the blocks in question."""
    checked = _checked_positions(requests, total_tokens(stream, total))
    wanted = checked.where("error is null").select("request_id", "lo", (F.col("lo") + 1).alias("hi"))
    found = _clipped(wanted, stream).select("request_id", F.get("part", F.lit(0)).alias("token_id"))
    return checked.select("request_id", "pos", "error").join(found, "request_id", "left")


def _checked_positions(requests: DataFrame, total: Column) -> DataFrame:
    placed = requests.withColumn("_total", total).withColumn(
        "lo", F.when(F.col("pos") < 0, F.col("pos") + F.col("_total")).otherwise(F.col("pos"))
    )
    inside = (F.col("lo") >= 0) & (F.col("lo") < F.col("_total"))
    return placed.withColumn("error", F.when(~inside, F.lit("out of range")))


def read_token_at(spark: SparkSession, path: str, requests: DataFrame) -> DataFrame:
    """``token_at`` over a written stream; only the blocks that hold a position are read."""
    total = stream_total(spark, path)
    wanted = _checked_positions(requests, F.lit(total)).where("error is null")
    return token_at(read_spans(spark, path, wanted.select("lo", (F.col("lo") + 1).alias("hi"))), requests, total)


def read_slices(spark: SparkSession, path: str, requests: DataFrame, parts: bool = False) -> DataFrame:
    """``token_slices`` over a written stream (``slice_parts`` with ``parts``); only the blocks that
    hold a part of a slice are read."""
    total = stream_total(spark, path)
    held = read_spans(spark, path, _slice_spans(requests, F.lit(total)).select("lo", "hi"))
    return (slice_parts if parts else token_slices)(held, requests, total)


def read_chunks(spark: SparkSession, path: str, requests: DataFrame) -> DataFrame:
    """``get_chunk`` over a written stream; only the blocks that hold a part of a chunk are read."""
    total = stream_total(spark, path)
    inside = requests.where((F.col("start") >= 0) & (F.col("start") + F.col("length") <= total))
    spans = inside.select(F.col("start").alias("lo"), (F.col("start") + F.col("length")).alias("hi"))
    return get_chunk(read_spans(spark, path, spans), requests, total)


def _slice_spans(requests: DataFrame, total: Column) -> DataFrame:
    """Requests with ``step``, ``down``, and the positions ``[lo, hi)`` they walk over from ``first``."""
    n, step = F.col("_total"), F.coalesce("step", F.lit(1))
    down = step < 0

    def bound(name: str, when_null: Column) -> Column:
        raw = F.when(F.col(name) < 0, F.col(name) + n).otherwise(F.col(name))
        low = F.when(down, F.lit(-1)).otherwise(F.lit(0))
        high = F.when(down, n - 1).otherwise(n)
        return F.when(F.col(name).isNull(), when_null).otherwise(F.least(F.greatest(raw, low), high))

    return (
        requests.withColumn("_total", total)
        .withColumn("step", step)
        .withColumn("first", bound("start", F.when(down, n - 1).otherwise(F.lit(0))))
        .withColumn("last", bound("stop", F.when(down, F.lit(-1)).otherwise(n)))
        .withColumn("lo", F.when(down, F.col("last") + 1).otherwise(F.col("first")))
        .withColumn("hi", F.when(down, F.col("first") + 1).otherwise(F.col("last")))
    )


def slice_parts(stream: DataFrame, requests: DataFrame, total: int | None = None) -> DataFrame:
    """``token_slices`` in parts of at most ``SPAN`` ids: ``request_id``, ``part_no``, ``ids``; a slice
    of any length is that many rows and none is gathered. Empty parts are left out.

    The step is taken where a part lies, ahead of the shuffle.
    """
    sized = _slice_spans(requests, total_tokens(stream, total))
    parts = _clipped(sized.select("request_id", "lo", "hi", "first", "step"), stream, ["first", "step"])
    stride, at = F.abs("step"), F.col("at")
    offset = F.pmod(F.col("first") - at, stride)
    stepped = F.filter("part", lambda _, i: F.pmod(i - offset, stride) == 0)
    rows = parts.withColumn("part", F.when(stride == 1, F.col("part")).otherwise(stepped)).where(F.size("part") > 0)
    number = F.abs(div(F.col("at"), SPAN) - div(F.col("first"), SPAN))
    joined = _joined(rows.withColumn("part_no", number), ["request_id", "part_no", "step"])
    ids = F.when(F.col("step") < 0, F.reverse("run")).otherwise(F.col("run"))
    return joined.select("request_id", "part_no", ids.alias("ids"))


def token_slices(stream: DataFrame, requests: DataFrame, total: int | None = None) -> DataFrame:
    """Slices of (``request_id``, ``start``, ``stop``, ``step``): bounds count from the end when
    negative and are clamped to the stream; a null bound means the end the step walks from or to.
    A negative step walks backwards. A slice is one row; slices that may be longer than a row should
    hold are for ``slice_parts``."""
    parts = slice_parts(stream, requests, total)
    ordered = F.array_sort(F.collect_list(F.struct("part_no", "ids")))
    whole = parts.groupBy("request_id").agg(F.flatten(F.transform(ordered, lambda p: p["ids"])).alias("ids"))
    empty = F.array().cast("array<int>")
    joined = requests.select("request_id").join(whole, "request_id", "left")
    return joined.select("request_id", F.coalesce("ids", empty).alias("ids"))


def get_chunk(stream: DataFrame, requests: DataFrame, total: int | None = None) -> DataFrame:
    """Runs of (``request_id``, ``start``, ``length``); one that leaves the stream gives an ``error``."""
    sized = requests.withColumn("_total", total_tokens(stream, total))
    inside = (F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("_total"))
    checked = sized.withColumn("error", F.when(~inside, F.lit("out of range")))
    wanted = checked.where("error is null").select(
        "request_id", F.col("start").alias("lo"), (F.col("start") + F.col("length")).alias("hi")
    )
    runs = _joined(_clipped(wanted, stream))
    empty = F.when(F.col("error").isNull(), F.array().cast("array<int>"))
    return (
        checked.select("request_id", "error")
        .join(runs, "request_id", "left")
        .select("request_id", F.coalesce("run", empty).alias("ids"), "error")
    )


def _joined(parts: DataFrame, by: Sequence[str] = ("request_id",)) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("at", "part")))
    return parts.groupBy(*by).agg(F.flatten(F.transform(ordered, lambda p: p["part"])).alias("run"))


def _train_size(total: Column, val_ratio: float) -> Column:
    return total - (total * F.lit(float(val_ratio))).cast("long")


def split(stream: DataFrame, val_ratio: float = 0.05, total: int | None = None) -> DataFrame:
    """Train and validation streams: the last ``trunc(total * val_ratio)`` tokens are validation.

    Adds ``split`` and counts ``start_pos`` from the start of each part. A document on the cut
    becomes two rows. One pass over the stream, no shuffle.
    """
    train, cut, n = F.col("_train"), F.col("_cut"), F.col("n_tokens")
    parts = F.array(
        F.struct(F.lit("train").alias("split"), F.col("start_pos").alias("start_pos"), F.lit(0).alias("from"), cut.alias("n")),
        F.struct(F.lit("val").alias("split"), (F.col("start_pos") + cut - train).alias("start_pos"), cut.alias("from"), (n - cut).alias("n")),
    )
    return (
        _with_cut(stream, val_ratio, total)
        .withColumn("p", F.explode(F.filter(parts, lambda p: p["n"] > 0)))
        .select("p.split", "doc_id", _part_ids(F.col("p.from"), F.col("p.n")).alias("ids"), F.col("p.n").alias("n_tokens"), "p.start_pos")
    )


def split_part(stream: DataFrame, val_ratio: float, name: str, total: int | None = None) -> DataFrame:
    """One part of ``split`` as a stream of its own."""
    if name not in ("train", "val"):
        raise ValueError("a part is 'train' or 'val'")
    train, cut, n = F.col("_train"), F.col("_cut"), F.col("n_tokens")
    is_train = name == "train"
    skip, size = (F.lit(0), cut) if is_train else (cut, n - cut)
    start = F.col("start_pos") if is_train else F.col("start_pos") + cut - train
    return (
        _with_cut(stream, val_ratio, total)
        .where(size > 0)
        .select("doc_id", _part_ids(skip, size).alias("ids"), size.alias("n_tokens"), start.alias("start_pos"))
    )


def read_part(spark: SparkSession, path: str, val_ratio: float, name: str) -> DataFrame:
    """``split_part`` of a written stream; only the blocks that hold the part are read."""
    total = stream_total(spark, path)
    cut = total - int(total * float(val_ratio))
    held = read_stream(spark, path, hi=cut) if name == "train" else read_stream(spark, path, lo=cut)
    return split_part(held, val_ratio, name, total)


def _with_cut(stream: DataFrame, val_ratio: float, total: int | None) -> DataFrame:
    """Add ``_train``, the size of the train part, and ``_cut``, how many ids of a document are in it."""
    inside = F.least(F.greatest(F.col("_train") - F.col("start_pos"), F.lit(0)), F.col("n_tokens"))
    return stream.withColumn("_train", _train_size(total_tokens(stream, total), val_ratio)).withColumn("_cut", inside)


def _part_ids(skip: Column, size: Column) -> Column:
    whole = (skip == 0) & (size == F.col("n_tokens"))
    return F.when(whole, F.col("ids")).otherwise(F.slice("ids", (skip + 1).cast("int"), size.cast("int")))


def dataset_stats(stream: DataFrame, context_length: int, header: bool = True) -> DataFrame:
    """Tokens, whole sequences, size of the token file in MB, and epochs per step for 1, 4 and 8
    sequences a step."""
    tokens = F.coalesce(F.sum("n_tokens"), F.lit(0))
    counted = stream.agg(tokens.alias("total_tokens")).withColumn(
        "num_sequences", div(F.col("total_tokens"), context_length + 1)
    )
    sequences = F.col("num_sequences")
    return counted.select(
        "total_tokens",
        sequences,
        ((F.lit(16 if header else 0) + 2 * F.col("total_tokens")) / (1024 * 1024)).alias("file_size_mb"),
        *[
            F.when(sequences > 0, F.lit(float(k)) / sequences).otherwise(F.lit(0.0)).alias(f"epochs_per_step_{k}")
            for k in (1, 4, 8)
        ],
    )
