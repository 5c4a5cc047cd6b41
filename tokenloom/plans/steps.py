"""Which batch feeds each training step, and at what learning rate."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.numbers import div


def learning_rate(
    step: Column, peak: float, warmup_steps: int, max_steps: int, min_lr_ratio: float = 0.1
) -> Column:
    """Linear warmup to ``peak``, then a cosine down to ``peak * min_lr_ratio``."""
    floor = peak * min_lr_ratio
    progress = (step - warmup_steps) / F.lit(float(max(max_steps - warmup_steps, 1)))
    cosine = F.lit(floor) + F.lit(0.5 * (peak - floor)) * (1 + F.cos(F.lit(math.pi) * progress))
    return (
        F.when(step < warmup_steps, F.lit(peak) * step / max(warmup_steps, 1))
        .when(step >= max_steps, F.lit(floor))
        .otherwise(cosine)
    )


def step_plan(
    spark: SparkSession,
    num_batches: int,
    batch_size: int,
    context_length: int,
    max_steps: int,
    accumulation_steps: int = 1,
    peak: float = 3e-4,
    warmup_steps: int = 2000,
    min_lr_ratio: float = 0.1,
    start_step: int = 0,
) -> DataFrame:
    """One row per micro-step: ``step``, ``micro_step``, ``epoch``, ``batch_no``, ``learning_rate``,
    ``tokens_seen`` (since the start of this run).

    Batches wrap around when used up. A resumed run starts at batch 0 again.
    """
    if num_batches < 1:
        raise ValueError("no whole batch to train on")
    micro = spark.range(0, max(max_steps - start_step, 0) * accumulation_steps).withColumnRenamed("id", "draw")
    step = div(F.col("draw"), accumulation_steps) + start_step
    return micro.select(
        step.alias("step"),
        F.pmod("draw", F.lit(accumulation_steps)).cast("int").alias("micro_step"),
        div(F.col("draw"), num_batches).alias("epoch"),
        F.pmod("draw", F.lit(num_batches)).alias("batch_no"),
        learning_rate(step, peak, warmup_steps, max_steps, min_lr_ratio).alias("learning_rate"),
        ((F.col("draw") + 1) * batch_size * context_length).alias("tokens_seen"),
    )


def training_totals(batch_size: int, accumulation_steps: int, context_length: int, max_steps: int) -> dict[str, int]:
    """Effective batch, tokens per step and tokens over all steps."""
    effective = batch_size * accumulation_steps
    return {
        "effective_batch": effective,
        "tokens_per_step": effective * context_length,
        "total_tokens": effective * context_length * max_steps,
    }
