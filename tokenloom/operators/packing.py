"""Fixed-length training sequences from a token stream, their order, and batches.

Documents are cut at sequence borders where they are, and only the cuts are shuffled, by sequence.
A sequence holds at most its own length in ids, so no group grows with the data. The order of an
epoch is worked out on sequence numbers alone and joined to the sequences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.numbers import div
from tokenloom.functions.positions import running_before
from tokenloom.operators.stream import total_tokens

_ROWS_PER_BLOCK = 50_000


def _pack(stream: DataFrame, stride: int, width: int, count: Column) -> DataFrame:
    first = F.greatest(div(F.col("start_pos") - width + stride, stride), F.lit(0))
    last = F.least(div(F.col("end_pos") - 1, stride), F.col("_count") - 1)
    lo = F.greatest(F.col("start_pos"), F.col("seq_idx") * stride)
    hi = F.least(F.col("end_pos"), F.col("seq_idx") * stride + width)
    cuts = (
        stream.withColumn("_count", count)
        .withColumn("end_pos", F.col("start_pos") + F.col("n_tokens"))
        .withColumn("_first", first)
        .withColumn("_last", last)
        .where((F.col("n_tokens") > 0) & (F.col("_last") >= F.col("_first")))
        .withColumn("seq_idx", F.explode(F.sequence("_first", "_last")))
        .select(
            "seq_idx",
            lo.alias("at"),
            F.slice("ids", (lo - F.col("start_pos") + 1).cast("int"), (hi - lo).cast("int")).alias("part"),
        )
    )
    ordered = F.array_sort(F.collect_list(F.struct("at", "part")))
    return cuts.groupBy("seq_idx").agg(F.flatten(F.transform(ordered, lambda p: p["part"])).alias("tokens"))


def sequence_count(tokens: Column, context_length: int, overlap: bool = False) -> Column:
    if overlap:
        return F.greatest(div(tokens - 1, context_length), F.lit(0))
    return div(tokens, context_length + 1)


def pack_disjoint(stream: DataFrame, context_length: int, total: int | None = None) -> DataFrame:
    """``seq_idx``, ``tokens``: sequences of ``context_length + 1`` that do not share tokens; the
    rest of the stream is left out."""
    width = context_length + 1
    return _pack(stream, width, width, sequence_count(total_tokens(stream, total), context_length))


def pack_overlap(stream: DataFrame, context_length: int, total: int | None = None) -> DataFrame:
    """As ``pack_disjoint``, but each sequence starts with the last token of the one before."""
    count = sequence_count(total_tokens(stream, total), context_length, overlap=True)
    return _pack(stream, context_length, context_length + 1, count)


def shift_targets(sequences: DataFrame) -> DataFrame:
    """Inputs (all but the last token) and targets (all but the first)."""
    size = F.size("tokens") - 1
    return sequences.withColumn("input_ids", F.slice("tokens", F.lit(1), size)).withColumn(
        "target_ids", F.slice("tokens", F.lit(2), size)
    ).drop("tokens")


def permutation(indices: DataFrame, seed: int = 42, epoch: int = 0, rows: int | None = None) -> DataFrame:
    """``seq_idx``, ``rank``: a seeded order of the sequence numbers, by MD5 of seed, epoch and number.

    MD5 is even, so its leading digits cut the order into blocks of about equal size.
    """
    rows = indices.count() if rows is None else rows
    digits = 1
    while rows / 16**digits > _ROWS_PER_BLOCK:
        digits += 1
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), F.col("seq_idx").cast("string")).cast("binary"))
    marked = indices.select("seq_idx", mark.alias("mark")).withColumn("block", F.substring("mark", 1, digits))
    return running_before(marked, "rank", F.lit(1), "block", ["mark", "seq_idx"]).select("seq_idx", "rank")


def shuffle(
    sequences: DataFrame,
    seed: int = 42,
    epoch: int = 0,
    reshuffle_each_epoch: bool = False,
    num_sequences: int | None = None,
) -> DataFrame:
    """Add ``rank``, the place of each sequence in the epoch.

    With ``reshuffle_each_epoch`` every epoch has its own order, else all share one. Sequence
    numbers run from 0 without gaps; giving ``num_sequences`` spares a count.
    """
    count = sequences.count() if num_sequences is None else num_sequences
    numbers = sequences.sparkSession.range(count).select(F.col("id").alias("seq_idx"))
    order = permutation(numbers, seed, epoch if reshuffle_each_epoch else 0, count)
    return sequences.join(order, "seq_idx")


def in_order(sequences: DataFrame) -> DataFrame:
    return sequences.withColumn("rank", F.col("seq_idx"))


def batches(ranked: DataFrame, batch_size: int, num_sequences: int | Column, drop_last: bool = True) -> DataFrame:
    """Replace ``rank`` by ``batch_no`` and ``slot``. ``drop_last`` leaves out an incomplete batch."""
    out = ranked.withColumn("batch_no", div(F.col("rank"), batch_size)).withColumn(
        "slot", (F.col("rank") % batch_size).cast("int")
    )
    if drop_last:
        count = num_sequences if isinstance(num_sequences, Column) else F.lit(num_sequences)
        out = out.withColumn("_whole", div(count, batch_size)).where("batch_no < _whole").drop("_whole")
    return out.drop("rank")


def batch_positions(batch_idx: int, batch_size: int, context_length: int) -> tuple[int, int]:
    """The stream positions a disjoint batch covers."""
    span = batch_size * (context_length + 1)
    return batch_idx * span, (batch_idx + 1) * span


def get_batch(sequences: DataFrame, batch_idx: int, batch_size: int) -> DataFrame:
    """One batch of the unshuffled order, as ``slot``, ``seq_idx``, ``input_ids``, ``target_ids``.

    The range filter is applied before the sequences are put together; over a stream read for
    ``batch_positions`` only the blocks that hold the batch are read.
    """
    first = batch_idx * batch_size
    chosen = sequences.where((F.col("seq_idx") >= first) & (F.col("seq_idx") < first + batch_size))
    return shift_targets(chosen.withColumn("slot", (F.col("seq_idx") - first).cast("int")))


def loaders(
    train: DataFrame,
    val: DataFrame,
    context_length: int,
    batch_size: int,
    seed: int = 42,
    overlap: bool = False,
    totals: tuple[int, int] | None = None,
) -> DataFrame:
    """Batches of both splits with a ``split`` column: train shuffled, validation in order.

    ``totals`` are the token counts of the two streams, which are added up if not given.
    """
    pack = pack_overlap if overlap else pack_disjoint
    if totals is None:
        totals = tuple(s.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first().n for s in (train, val))
    out = []
    for name, stream, total in (("train", train, totals[0]), ("val", val, totals[1])):
        count = max((total - 1) // context_length, 0) if overlap else total // (context_length + 1)
        packed = pack(stream, context_length, total)
        ranked = shuffle(packed, seed, num_sequences=count) if name == "train" else in_order(packed)
        out.append(shift_targets(batches(ranked, batch_size, count)).withColumn("split", F.lit(name)))
    return out[0].unionByName(out[1])
