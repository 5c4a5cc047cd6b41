"""Training-run analytics: throughput, early stopping, checkpoints, time and cost reports.

A run may hold any share of the rows. Aggregates are combined map-side, and per-run order is
handled in blocks of steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.numbers import div
from tokenloom.functions.positions import running_before, running_min_before
from tokenloom.session import materialize, ship_package

STEPS_PER_BLOCK = 100_000


def throughput(steps: DataFrame, log_every: int = 10) -> DataFrame:
    """Tokens per second of each finished log interval: ``run``, ``step``, ``tokens``, ``seconds``,
    ``tokens_per_sec``. ``steps`` has ``run``, ``step`` (from 0), ``tokens``, ``seconds``."""
    return (
        steps.groupBy("run", ((div(F.col("step"), log_every) + 1) * log_every).alias("step_end"))
        .agg(F.sum("tokens").alias("tokens"), F.sum("seconds").alias("seconds"), F.max("step").alias("last"))
        .where(F.col("last") + 1 == F.col("step_end"))
        .select(
            "run",
            F.col("step_end").alias("step"),
            "tokens",
            "seconds",
            (F.col("tokens") / F.greatest("seconds", F.lit(1e-6))).alias("tokens_per_sec"),
        )
    )


def _step_block() -> Column:
    return div(F.col("step"), STEPS_PER_BLOCK)


class StopState:
    """What early stopping remembers of a run between evaluations."""

    __slots__ = ("best", "last")

    def __init__(self, best: float = math.inf, last: int = -1):
        self.best, self.last = best, last

    def accepts(self, at: int, value: float, patience: int, min_delta: float) -> bool:
        """Take the ``at``-th evaluation if it improves enough and the run had not stopped by then."""
        if value < self.best - min_delta and at - self.last <= patience:
            self.best, self.last = value, at
            return True
        return False


def early_stopping(evals: DataFrame, patience: int = 10, min_delta: float = 0.001) -> DataFrame:
    """Per run: ``best_step``, ``best_loss`` and ``n_accepted`` of the accepted evaluations, and
    ``stop_step``, null for a run that never stopped. ``evals`` has ``run``, ``step``, ``val_loss``.

    Only an evaluation below all before it can be accepted, so the others are filtered out in
    parallel; what is left is folded in step order as a stream of sorted rows, holding one small
    state and never a whole run. The numbered evaluations are read three times and so are written
    once.
    """
    if patience < 1:
        raise ValueError("patience must be at least 1")
    blocked = evals.select("run", "step", "val_loss").withColumn("block", _step_block())
    numbered = materialize(running_before(blocked, "at", F.lit(1), "block", ["step"], within=["run"]), "evals")
    lows = running_min_before(numbered, "lowest", F.col("val_loss"), "block", ["step"], within=["run"])
    records = lows.where(F.col("lowest").isNull() | (F.col("val_loss") < F.col("lowest")))

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, state = None, StopState()
        for frame in frames:
            keep = []
            for row_run, at, value in zip(frame["run"], frame["at"], frame["val_loss"]):
                if row_run != run:
                    run, state = row_run, StopState()
                keep.append(state.accepts(at, value, patience, min_delta))
            yield frame[keep]

    ship_package(evals.sparkSession)
    ordered = records.select("run", "at", "step", "val_loss").repartition("run").sortWithinPartitions("run", "at")
    accepted = (
        ordered.mapInPandas(fold, ordered.schema)
        .groupBy("run")
        .agg(
            F.count("*").alias("n_accepted"),
            F.max("at").alias("last"),
            F.max_by("step", "at").alias("best_step"),
            F.max_by("val_loss", "at").alias("best_loss"),
        )
    )
    runs = numbered.groupBy("run").agg(F.count("*").alias("n_evals")).join(accepted, "run", "left")
    stops = runs.withColumn("stop_at", F.coalesce("last", F.lit(-1)) + patience)
    stop_steps = numbered.select("run", F.col("at").alias("stop_at"), F.col("step").alias("stop_step"))
    return stops.join(stop_steps, ["run", "stop_at"], "left").select(
        "run", "best_step", "best_loss", F.coalesce("n_accepted", F.lit(0)).alias("n_accepted"), "stop_step"
    )


def best_checkpoints(manifests: DataFrame) -> DataFrame:
    """Add ``is_best``: the loss is below that of every earlier save of the run."""
    blocked = manifests.withColumn("_block", _step_block())
    return (
        running_min_before(blocked, "_lowest", F.col("val_loss"), "_block", ["step"], within=["run"])
        .withColumn("is_best", F.col("_lowest").isNull() | (F.col("val_loss") < F.col("_lowest")))
        .drop("_block", "_lowest")
    )


def retention(manifests: DataFrame, keep: int = 3) -> DataFrame:
    """Add ``is_best``, ``kept`` and ``removed``: the newest ``keep`` saves by step stay, and so does
    the copy of the latest best. Nothing is deleted.

    The newest saves are a per-run top-k, which Spark cuts down before the shuffle.
    """
    flagged = best_checkpoints(manifests)
    newest = Window.partitionBy("run").orderBy(F.desc("step"))
    floor = (
        manifests.select("run", "step")
        .withColumn("_n", F.row_number().over(newest))
        .where(F.col("_n") <= keep)
        .groupBy("run")
        .agg(F.min("step").alias("_floor"))
    )
    best = flagged.where("is_best").groupBy("run").agg(F.max("step").alias("_best"))
    kept = (F.col("step") >= F.col("_floor")) | (F.col("step") == F.col("_best"))
    return (
        flagged.join(floor, "run")
        .join(best, "run", "left")
        .withColumn("kept", F.coalesce(kept, F.lit(False)))
        .withColumn("removed", ~F.col("kept"))
        .drop("_floor", "_best")
    )


def step_time_report(
    times: DataFrame,
    total_steps: int,
    tokens_per_step: int,
    warmup_steps: int = 3,
    num_steps: int | None = None,
) -> DataFrame:
    """Step times of each run after its warmup, and the time ``total_steps`` would take. ``times``
    has ``run``, ``step`` (from 0), ``seconds``; ``num_steps`` limits the steps that are timed."""
    timed = times.where(F.col("step") >= warmup_steps)
    if num_steps is not None:
        timed = timed.where(F.col("step") < warmup_steps + num_steps)
    mean = F.col("avg_step_time")
    seconds = F.col("est_seconds")
    return (
        timed.groupBy("run")
        .agg(
            F.avg("seconds").alias("avg_step_time"),
            F.min("seconds").alias("min_step_time"),
            F.max("seconds").alias("max_step_time"),
        )
        .withColumn("avg_tokens_per_sec", F.try_divide(F.lit(tokens_per_step).cast("double"), mean))
        .withColumn("total_tokens", F.lit(total_steps * tokens_per_step).cast("long"))
        .withColumn("est_seconds", mean * total_steps)
        .withColumn("est_hours", seconds / 3600)
        .withColumn("est_days", seconds / 3600 / 24)
    )


# Rented machines, their speed against the local one and their price per hour.
OFFERS = (
    ("RTX 4090 (Vast.ai)", 15, 0.40),
    ("A100 40GB (Lambda)", 25, 1.10),
    ("A100 80GB (RunPod)", 35, 1.60),
    ("H100 (GCP)", 50, 3.50),
)


def cloud_cost(report: DataFrame, offers: tuple = OFFERS) -> DataFrame:
    """Hours and cost of each run on each offer. The few offers are unfolded per row, with no join."""
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("offer"), F.lit(float(speedup)).alias("speedup"), F.lit(price).alias("price"))
            for name, speedup, price in offers
        ]
    )
    return (
        report.select("run", "est_hours", F.inline(rows))
        .withColumn("cloud_hours", F.col("est_hours") / F.col("speedup"))
        .withColumn("cloud_cost", F.col("cloud_hours") * F.col("price"))
    )
