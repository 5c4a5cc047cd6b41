"""Corpus statistics for vocabulary training: units, characters and frequency-ranked vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.positions import first_rows
from tokenloom.functions.tables import PIECE_BASE, USER_SYMBOLS
from tokenloom.functions.text import SPACE_MARK, characters, strip, units
from tokenloom.session import ship_package


def word_counts(
    texts: DataFrame, text: str = "text", max_sentence_length: int = 16384, form: str = "identity"
) -> DataFrame:
    """How often each unit occurs: ``word``, ``n``.

    Texts are taken line by line; lines longer than ``max_sentence_length`` bytes are left out, as
    are chat markers. The count is combined map-side, so a frequent unit is one row per task.
    """
    if form != "identity":
        ship_package(texts.sparkSession)
    lines = texts.select(F.explode(F.split(text, "\n")).alias("line"))
    kept = lines.where(
        (F.octet_length("line") <= max_sentence_length) & (strip(F.col("line")) != "")
    )
    return (
        kept.select(F.explode(units(F.col("line"), form)).alias("word"))
        .where(~F.col("word").isin(*USER_SYMBOLS))
        .groupBy("word")
        .agg(F.count("*").alias("n"))
    )


def character_counts(words: DataFrame) -> DataFrame:
    """Occurrences of each character: ``char``, ``n``."""
    return (
        words.select(F.explode(characters(F.col("word"))).alias("char"), "n")
        .groupBy("char")
        .agg(F.sum("n").alias("n"))
    )


def alphabet(words: DataFrame, coverage: float = 0.9995) -> DataFrame:
    """The most frequent characters, taken until they cover ``coverage`` of all occurrences:
    ``char``, ``n``, ``rank`` (from 0). The space mark is always kept and ranks first.

    The window runs over one row per distinct character, which Unicode bounds.
    """
    ordered = Window.orderBy(F.desc("is_mark"), F.desc("n"), "char")
    ranked = (
        character_counts(words)
        .withColumn("is_mark", (F.col("char") == SPACE_MARK).cast("int"))
        .withColumn("rank", (F.row_number().over(ordered) - 1).cast("long"))
        .withColumn("before", F.sum("n").over(ordered) - F.col("n"))
        .withColumn("total", F.sum("n").over(Window.partitionBy()))
    )
    return ranked.where((F.col("is_mark") == 1) | (F.col("before") < F.col("total") * coverage)).select(
        "char", "n", "rank"
    )


def most_frequent(counts: DataFrame, piece: str, size: int) -> DataFrame:
    """The ``size`` most frequent pieces with their rank from 0, ties in piece order.

    The cut is found from the counts; only what passes it is sorted and ranked in one task.
    """
    top = first_rows(counts.withColumn("_less", -F.col("n")), ["_less", piece], size)
    return top.select(
        F.col(piece).alias("piece"),
        "n",
        (F.row_number().over(Window.orderBy(F.desc("n"), piece)) - 1).cast("long").alias("rank"),
    )


def train_word(words: DataFrame, vocab_size: int = 32000) -> DataFrame:
    """Pieces of a word vocabulary, most frequent first: ``piece``, ``n``, ``rank``."""
    return most_frequent(words, "word", vocab_size - PIECE_BASE)


def train_char(words: DataFrame, vocab_size: int = 32000) -> DataFrame:
    """Pieces of a character vocabulary, most frequent first: ``piece``, ``n``, ``rank``."""
    return most_frequent(character_counts(words), "char", vocab_size - PIECE_BASE)
