"""Texts to token ids and back, and token counts.

Encoding needs no shuffle: units are cut by a JVM expression, and an Arrow function turns each
distinct unit of a batch into ids once. The vocabulary travels with the function; it is at most
65,536 rows. Decoding stays in the JVM: ids index into an array of piece bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.pieces import UnitEncoder
from tokenloom.functions.tables import SKIPPED_IDS, SPECIAL_IDS, UNKNOWN_SURFACE, USER_SYMBOLS
from tokenloom.functions.text import SPACE_MARK, units
from tokenloom.operators.vocab import checked_vocab, collect_vocab
from tokenloom.session import bound_batches, ship_package

MODELS = ("bpe", "unigram", "char", "word")


def encoder(vocab: DataFrame, model: str = "bpe", form: str = "identity") -> Callable[[Column], Column]:
    """A function from a text column to its ids. A character with no piece becomes its bytes."""
    if model not in MODELS:
        raise ValueError(f"model must be one of {MODELS}")
    ship_package(vocab.sparkSession)
    bound_batches(vocab.sparkSession)
    pieces = {r.piece: (r.id, r.score) for r in collect_vocab(vocab) if r.kind in ("piece", "user")}
    batches = UnitEncoder(pieces, model, frozenset(USER_SYMBOLS) & pieces.keys())
    unit_ids = F.arrow_udf(batches.batch, "array<int>")
    return lambda text: unit_ids(units(text, form))


def encode(
    df: DataFrame,
    ids_of: Callable[[Column], Column],
    text: str = "text",
    ids: str = "ids",
    add_bos: bool = False,
    add_eos: bool = False,
) -> DataFrame:
    """Add an ``ids`` column, with the start and end ids if asked for."""
    out = df.withColumn(ids, ids_of(F.col(text)))
    if add_bos or add_eos:
        mark = {n: F.array(F.lit(SPECIAL_IDS[n])) if on else None for n, on in (("bos", add_bos), ("eos", add_eos))}
        out = out.withColumn(ids, F.concat(*[c for c in (mark["bos"], F.col(ids), mark["eos"]) if c is not None]))
    return out


def decode(
    df: DataFrame, vocab: DataFrame, ids: str = "ids", text: str = "text", skip_special_tokens: bool = True
) -> DataFrame:
    """Add the text of an id column. Broken byte sequences become replacement characters."""
    kind, piece = F.col("kind"), F.col("piece")
    content = (
        F.when(kind == "byte", F.substring(piece, 4, 2))
        .when(kind == "control", F.lit(""))
        .when(kind == "unknown", F.hex(F.encode(F.lit(UNKNOWN_SURFACE), "UTF-8")))
        .otherwise(F.hex(F.encode(piece, "UTF-8")))
    )
    table = (
        checked_vocab(vocab)
        .select("id", content.alias("content"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "content"))), lambda r: r["content"]).alias("t"))
    )
    kept = F.col(ids)
    if skip_special_tokens:
        kept = F.filter(kept, lambda i: ~i.isin(*SKIPPED_IDS))
    joined = F.array_join(F.transform(kept, lambda i: F.get(F.col("_table"), i)), "")
    marked = F.make_valid_utf8(F.unhex(joined).cast("string"))
    plain = F.replace(F.regexp_replace(marked, f"^{SPACE_MARK}", ""), F.lit(SPACE_MARK), F.lit(" "))
    return df.withColumn("_table", table.scalar()).withColumn(text, plain).drop("_table")


def token_stats(
    df: DataFrame, file: str = "file", text: str = "text", ids: str = "ids"
) -> DataFrame:
    """Tokens, characters and characters per token for each file, and in total (``file`` null)."""
    sizes = df.select(
        F.col(file).alias("file"), F.size(ids).cast("long").alias("t"), F.length(text).cast("long").alias("c")
    )
    return sizes.rollup("file").agg(
        F.sum("t").alias("n_tokens"),
        F.sum("c").alias("n_chars"),
        F.try_divide(F.sum("c"), F.sum("t")).alias("chars_per_token"),
    )
