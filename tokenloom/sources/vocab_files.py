"""Vocabulary files: one ``piece TAB score`` line per id, in id order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.tables import MAX_VOCAB
from tokenloom.operators.vocab import checked_vocab, piece_kind


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """``id``, ``piece``, ``score``, ``kind``. The file has at most 65,536 short lines, so it is read
    as one value and the id is the line's place in it; quotes mean nothing. More lines raise an error."""
    whole = spark.read.text(path, wholetext=True)
    found = whole.select(F.split(F.rtrim("value", F.lit("\n")), "\n").alias("rows"))
    refused = F.raise_error(F.lit(f"a vocabulary holds at most {MAX_VOCAB} pieces")).cast("array<string>")
    checked = F.when(F.size("rows") > MAX_VOCAB, refused).otherwise(F.col("rows"))
    lines = found.select(F.posexplode(checked).alias("id", "row"))
    piece = F.regexp_extract("row", "^(.*)\t([^\t]*)$", 1)
    score = F.regexp_extract("row", "^(.*)\t([^\t]*)$", 2).cast("double") + F.lit(0.0)
    return lines.select("id", piece.alias("piece"), score.alias("score"), piece_kind(piece).alias("kind"))


def write_vocab(vocab: DataFrame, path: str) -> None:
    """One ordered file in the folder ``path``. Whole scores have no decimals, and the first trained
    piece scores ``-0``."""
    whole = F.col("score").cast("long").cast("string")
    score = (
        F.when((F.col("kind") == "piece") & (F.col("score") == 0), "-0")
        .when(F.col("score") == F.floor("score"), whole)
        .otherwise(F.col("score").cast("string"))
    )
    rows = checked_vocab(vocab).coalesce(1).sortWithinPartitions("id")
    rows.select(F.concat_ws("\t", "piece", score).alias("row")).write.text(path)
