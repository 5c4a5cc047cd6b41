"""Vocabulary tables: ``id``, ``piece``, ``score``, ``kind``.

Ids are laid out as specials, then the 256 bytes, then trained pieces by rank, then single
characters. A vocabulary has at most 65,536 rows because ids are stored as 16-bit numbers, which is
what makes it safe to broadcast; ``checked_vocab`` and ``collect_vocab`` refuse a larger one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.functions.tables import BYTE_BASE, MAX_VOCAB, PIECE_BASE, SPECIAL_IDS, SPECIALS


def piece_kind(piece: Column) -> Column:
    """The kind of a piece from its text."""
    return (
        F.when(piece == SPECIALS["unk"], "unknown")
        .when(piece.isin(SPECIALS["pad"], SPECIALS["bos"], SPECIALS["eos"]), "control")
        .when(piece.isin(SPECIALS["user"], SPECIALS["assistant"], SPECIALS["system"]), "user")
        .when(piece.rlike("^<0x[0-9A-F]{2}>$"), "byte")
        .otherwise("piece")
    )


def reserved_rows(spark: SparkSession) -> DataFrame:
    """The special tokens and the byte pieces, ids 0 to 262."""
    names = F.array(*[F.lit(s) for s in SPECIALS.values()])
    piece = F.when(F.col("id") < BYTE_BASE, F.get(names, F.col("id").cast("int"))).otherwise(
        F.format_string("<0x%02X>", F.greatest(F.col("id") - BYTE_BASE, F.lit(0)))
    )
    rows = spark.range(PIECE_BASE).select(F.col("id").cast("int"), piece.alias("piece"))
    return rows.select("id", "piece", F.lit(0.0).alias("score"), piece_kind(F.col("piece")).alias("kind"))


def assemble_vocab(pieces: DataFrame, alphabet: DataFrame | None = None, vocab_size: int = 32000) -> DataFrame:
    """Lay out a vocabulary from trained pieces (``piece``, ``rank``) and characters (``char``, ``rank``).

    A string two merges lead to gets one row, at its first rank. Pieces are cut so that every
    character has a place. Scores fall by one per id, unless ``pieces`` brings its own.
    """
    spark = pieces.sparkSession
    scored = "score" in pieces.columns
    own = F.col("score") if scored else F.lit(None).cast("double")
    trained = pieces.groupBy("piece").agg(F.min("rank").alias("rank"), F.max(own).alias("score"))
    trained = trained.withColumn("part", F.lit(0))
    room = F.lit(vocab_size - PIECE_BASE)
    if alphabet is not None:
        chars = alphabet.select(F.col("char").alias("piece"), "rank", F.lit(None).cast("double").alias("score"))
        trained = trained.join(chars.select("piece"), "piece", "left_anti")
        room = room - F.col("n_chars")
        trained = trained.withColumn("n_chars", alphabet.agg(F.count("*")).scalar())
        trained = _ranked(trained).where(F.col("at") < room).drop("n_chars", "at")
        trained = trained.unionByName(chars.withColumn("part", F.lit(1)))
    laid = _ranked(trained).where(F.col("at") < vocab_size - PIECE_BASE)
    rows = laid.select(
        (F.col("at") + PIECE_BASE).cast("int").alias("id"),
        "piece",
        F.coalesce("score", (F.lit(0) - F.col("at")).cast("double")).alias("score"),
        F.lit("piece").alias("kind"),
    )
    return reserved_rows(spark).unionByName(rows)


def _ranked(rows: DataFrame) -> DataFrame:
    # At most vocab_size rows come here, so one task ranks them.
    return rows.withColumn("at", F.row_number().over(Window.orderBy("part", "rank", "piece")) - 1)


def checked_vocab(vocab: DataFrame) -> DataFrame:
    """``vocab``, raising when it is read with more rows than 16-bit ids allow."""
    rows = vocab.agg(F.count("*")).scalar()
    refused = F.raise_error(F.lit(f"a vocabulary holds at most {MAX_VOCAB} pieces")).cast("int")
    return vocab.withColumn("id", F.when(rows > MAX_VOCAB, refused).otherwise(F.col("id")))


def collect_vocab(vocab: DataFrame) -> list:
    """The rows of a vocabulary on the driver, refused if they are more than 16-bit ids allow."""
    rows = vocab.select("id", "piece", "score", "kind").limit(MAX_VOCAB + 1).collect()
    if len(rows) > MAX_VOCAB:
        raise ValueError(f"a vocabulary holds at most {MAX_VOCAB} pieces")
    return sorted(rows)


def lookup_piece(ids: DataFrame, vocab: DataFrame, id_col: str = "id") -> DataFrame:
    """Add ``piece`` for each id; null where the vocabulary has no such id."""
    table = checked_vocab(vocab).select(F.col("id").alias(id_col), "piece")
    return ids.join(F.broadcast(table), id_col, "left")


def lookup_id(pieces: DataFrame, vocab: DataFrame, piece_col: str = "piece") -> DataFrame:
    """Add ``id`` for each piece; unknown pieces get the unknown id."""
    table = checked_vocab(vocab).select(F.col("piece").alias(piece_col), "id")
    joined = pieces.join(F.broadcast(table), piece_col, "left")
    return joined.withColumn("id", F.coalesce("id", F.lit(SPECIAL_IDS["unk"])))


def ids_of_pieces(vocab: DataFrame, pieces: list[str]) -> list[int]:
    """Ids of a few given pieces, such as stop tokens; unknown ones become the unknown id."""
    known = {r.piece: r.id for r in vocab.where(F.col("piece").isin(pieces)).select("piece", "id").collect()}
    return [known.get(p, SPECIAL_IDS["unk"]) for p in pieces]


def vocab_info(vocab: DataFrame) -> DataFrame:
    """One row: the size and the id of each special token (the unknown id where one is missing)."""
    unk = F.lit(SPECIAL_IDS["unk"])
    return vocab.agg(
        F.count("*").alias("vocab_size"),
        *[
            F.coalesce(F.max(F.when(F.col("piece") == text, F.col("id"))), unk).alias(f"{name}_id")
            for name, text in SPECIALS.items()
        ],
    )
