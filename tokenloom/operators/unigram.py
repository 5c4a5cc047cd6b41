"""Training of a unigram vocabulary: expectation maximisation over the distinct units of a corpus.

Candidate pieces are the frequent substrings of units. Each round cuts every distinct unit in all
ways on the executors, sums the expected piece counts, and rescores or prunes the piece table, all
as tables. The pieces with their scores, at most ``seed_size`` and the characters, are the model that
a round's functions need; they are sent along once a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.lattice import Lattice
from tokenloom.functions.pieces import best_path
from tokenloom.functions.positions import first_rows
from tokenloom.functions.tables import MAX_PIECE_CHARS, PIECE_BASE
from tokenloom.operators.words import character_counts
from tokenloom.session import bound_batches, materialize, ship_package

_KEEP = 0.75  # share of pieces kept per pruning
_STEPS = 2  # rounds of counting between prunings
_LEAST_COUNT = 0.5


def seed_pieces(words: DataFrame, seed_size: int | None = 1_000_000) -> DataFrame:
    """Substrings of units that occur at least twice: ``piece``, ``n``; the best by count times length,
    or all of them for ``None``."""
    longest = F.least(F.lit(MAX_PIECE_CHARS), F.length("word") - F.col("at") + 1)
    starts = words.where(F.length("word") > 1).select(
        "word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("at")
    )
    spans = starts.select("word", "n", "at", F.explode(F.sequence(F.lit(2), longest)).alias("size"))
    counts = (
        spans.select(F.substring("word", F.col("at"), F.col("size")).alias("piece"), "n")
        .groupBy("piece")
        .agg(F.sum("n").alias("n"))
    )
    frequent = counts.where("n >= 2")
    if seed_size is None:
        return frequent
    weighed = materialize(frequent.withColumn("_less", -F.col("n") * F.length("piece")), "seeds")
    return first_rows(weighed, ["_less", "piece"], seed_size).drop("_less")


def _scores(table: DataFrame) -> dict[str, float]:
    return {r.piece: r.score for r in table.select("piece", "score").collect()}


def expected_counts(words: DataFrame, table: DataFrame) -> DataFrame:
    """``piece``, ``c``: how often each piece is expected over all cuts of all units, rounded so that equal
    counts stay equal however they are added up."""
    score = _scores(table)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = list(score)
        values, lattice = np.array(list(score.values())), Lattice(pieces)
        total, met = np.zeros(len(pieces)), np.zeros(len(pieces), bool)
        for frame in frames:
            counts, found = lattice.expected(frame["word"].tolist(), frame["n"].to_numpy(), values)
            total += counts
            met |= found
        at = np.flatnonzero(met)
        if len(at):
            yield pd.DataFrame({"piece": [pieces[i] for i in at], "c": total[at]})

    return words.mapInPandas(count, "piece string, c double").groupBy("piece").agg(F.round(F.sum("c"), 9).alias("c"))


def _digamma(x: Column) -> Column:
    shift = sum((F.lit(1.0) / (x + k) for k in range(7)), F.lit(0.0))
    far = x + 7
    inv = 1.0 / (far * far)
    return F.log(far) - 0.5 / far - inv * (1 / 12 - inv * (1 / 120 - inv / 252)) - shift


def rescore(counts: DataFrame) -> DataFrame:
    """``piece``, ``score`` from expected counts; rare pieces of several characters go."""
    value = F.greatest("c", F.lit(1e-3))
    kept = counts.where((F.col("c") >= _LEAST_COUNT) | (F.length("piece") == 1)).withColumn("v", value)
    whole = kept.agg(F.sum("v").alias("v")).select(_digamma(F.col("v")).alias("d"))
    return kept.select("piece", (_digamma(F.col("v")) - whole.scalar()).alias("score"))


def prune(table: DataFrame, counts: DataFrame, size: int) -> DataFrame:
    """Keep single characters and the pieces whose loss would lower the likelihood most."""
    score = _scores(table)
    longest = max(map(len, score))

    def losses(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rest = [best_path(p, score, longest, without=p)[1] for p in frame["piece"]]
            yield frame.assign(_less=frame["c"] * (rest - frame["score"]))[["piece", "score", "_less"]]

    single = table.where(F.length("piece") == 1)
    long = table.where(F.length("piece") > 1).join(counts, "piece", "left").fillna(0.0, ["c"])
    tasks = table.sparkSession.sparkContext.defaultParallelism
    weighed = long.repartition(tasks).mapInPandas(losses, "piece string, score double, _less double")
    room = max(size - single.count(), 0)
    best = first_rows(materialize(weighed, "losses"), ["_less", "piece"], room)
    return single.unionByName(best.drop("_less"))


def train_unigram(words: DataFrame, vocab_size: int = 32000, seed_size: int = 1_000_000) -> DataFrame:
    """Pieces with their log-likelihood: ``piece``, ``score``, ``rank`` (best first).

    ``words`` is read several times; hand in a written table. ``seed_size`` is the number of
    candidates the model starts from, beside the characters.
    """
    spark = words.sparkSession
    ship_package(spark)
    bound_batches(spark)
    units = materialize(words.repartition(spark.sparkContext.defaultParallelism), "unigram")
    size = vocab_size - PIECE_BASE
    seeds = seed_pieces(units, seed_size).unionByName(character_counts(units).withColumnRenamed("char", "piece"))
    seeds = materialize(seeds, "seeds")
    total = F.log(seeds.agg(F.sum("n")).scalar())
    table = materialize(seeds.select("piece", (F.log("n") - total).alias("score")), "pieces")
    while True:
        for _ in range(_STEPS):
            counts = materialize(expected_counts(units, table), "expected")
            table = materialize(rescore(counts), "pieces")
        held = table.count()
        if held <= size:
            break
        pruned = materialize(prune(table, counts, max(size, int(held * _KEEP))), "pieces")
        if pruned.count() == held:
            break
        table = pruned
    best_first = Window.orderBy(F.desc("score"), "piece")  # over one row for each piece of the vocabulary
    return table.withColumn("rank", (F.row_number().over(best_first) - 1).cast("long"))
