"""Tables of model scores: loss, evaluation, sampling filters and drawing.

Scores come as one row of logits per prediction (``row_id``, ``logits``) or as candidates
(``row_id``, ``token_id``, ``logit``). Filters drop candidates, as a logit of minus infinity would.
All candidate windows are keyed by ``row_id``, whose groups are as large as the vocabulary, so a
chain of filters shares one shuffle, that of the compact arrays. The history of a row meets its
logits there too, so the penalty moves no candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.tables import SPECIAL_IDS


def candidates(
    scores: DataFrame,
    row_id: str = "row_id",
    logits: str = "logits",
    history: DataFrame | None = None,
    penalty: float = 1.0,
) -> DataFrame:
    """One row per candidate. Rows are placed by ``row_id`` while they are still compact arrays; a
    repetition ``penalty`` for the tokens of ``history`` is applied to the arrays."""
    values = F.transform(F.col(logits), lambda x: x.cast("double"))
    placed = scores.select(F.col(row_id).alias("row_id"), values.alias("logits")).repartition("row_id")
    if history is not None and penalty != 1.0:
        seen = history.groupBy("row_id").agg(F.array_sort(F.collect_set("token_id")).alias("_seen"))
        joined = placed.join(seen, "row_id", "left")
        placed = joined.withColumn("logits", penalized(F.col("logits"), F.col("_seen"), penalty))
    return placed.select("row_id", F.posexplode("logits").alias("token_id", "logit")).withColumn(
        "logit", F.col("logit").cast("double")
    )


def penalized(logits: Column, seen: Column, penalty: float) -> Column:
    """``logits`` with those at the ascending places ``seen`` divided (positive) or multiplied by the
    penalty. The array is cut at these places and joined again, so the work is one step per logit
    and place."""
    n = F.size(logits)
    at = F.filter(seen, lambda i: (i >= 0) & (i < n))
    adjusted = F.transform(at, lambda i: _penalty(F.get(logits, i.cast("int")), penalty))

    def piece(k: Column) -> Column:
        before = F.when(k == 0, F.lit(-1)).otherwise(F.get(at, k - 1).cast("int"))
        here = F.when(k == F.size(at), n).otherwise(F.get(at, k).cast("int"))
        own = F.when(k == F.size(at), F.array().cast("array<double>")).otherwise(F.array(F.get(adjusted, k)))
        return F.concat(F.slice(logits, before + 2, here - before - 1), own)

    joined = F.flatten(F.transform(F.sequence(F.lit(0), F.size(at)), piece))
    return F.when(F.size(F.coalesce(at, F.array())) == 0, logits).otherwise(joined)


def _penalty(logit: Column, penalty: float) -> Column:
    return F.when(logit > 0, logit / penalty).otherwise(logit * penalty)


def row_loss(logits: Column, target: Column) -> Column:
    """Negative log-softmax of the target, with the largest logit taken out first."""
    values = F.transform(logits, lambda x: x.cast("double"))
    top = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return top + F.log(total) - F.get(values, target.cast("int"))


def cross_entropy(scores: DataFrame, logits: str = "logits", target: str = "target") -> DataFrame:
    """One row: ``loss``, the mean over all predictions, and ``n``."""
    return scores.agg(
        F.avg(row_loss(F.col(logits), F.col(target))).alias("loss"), F.count("*").alias("n")
    )


def evaluate(scored: DataFrame, max_batches: int = 25) -> DataFrame:
    """``val_loss``: the mean of the batch means of the first batches in ``batch_no`` order; 0 if
    there is no batch. ``scored`` has ``batch_no`` and ``loss``."""
    first = scored.select("batch_no").distinct().orderBy("batch_no").limit(max_batches)
    means = scored.join(F.broadcast(first), "batch_no", "left_semi").groupBy("batch_no").agg(F.avg("loss").alias("loss"))
    return means.agg(F.coalesce(F.avg("loss"), F.lit(0.0)).alias("val_loss"), F.count("*").alias("n_batches"))


def repetition_penalty(cand: DataFrame, history: DataFrame, penalty: float = 1.1) -> DataFrame:
    """Divide the positive and multiply the other logits of tokens already generated for the row.
    For sparse candidates; ``candidates`` does it for arrays of logits, without moving candidates."""
    if penalty == 1.0:
        return cand
    seen = history.select("row_id", "token_id").distinct().withColumn("_seen", F.lit(True))
    return (
        cand.join(seen, ["row_id", "token_id"], "left")
        .withColumn("logit", F.when(F.col("_seen"), _penalty(F.col("logit"), penalty)).otherwise(F.col("logit")))
        .drop("_seen")
    )


def temperature(cand: DataFrame, t: float = 0.8) -> DataFrame:
    """Divide logits by ``t``. At 0 or below only the best candidate of each row stays, the lowest
    id on ties."""
    if t > 0:
        return cand.withColumn("logit", F.col("logit") / t)
    best = F.max(F.struct("logit", (-F.col("token_id")).alias("neg"))).alias("b")
    return cand.groupBy("row_id").agg(best).select(
        "row_id", (-F.col("b.neg")).alias("token_id"), F.col("b.logit").alias("logit")
    )


def top_k(cand: DataFrame, k: int = 0) -> DataFrame:
    """Keep logits at or above the k-th largest of the row, ties included; 0 keeps all."""
    if k <= 0:
        return cand
    by_logit = Window.partitionBy("row_id").orderBy(F.desc("logit"))
    return cand.withColumn("_rank", F.rank().over(by_logit)).where(F.col("_rank") <= k).drop("_rank")


def softmax(cand: DataFrame, name: str = "prob") -> DataFrame:
    row = Window.partitionBy("row_id")
    weighed = cand.withColumn("_w", F.exp(F.col("logit") - F.max("logit").over(row)))
    return weighed.withColumn(name, F.col("_w") / F.sum("_w").over(row)).drop("_w")


def top_p(cand: DataFrame, p: float = 0.95) -> DataFrame:
    """Drop a candidate when the mass of the better ones exceeds ``p``; the best always stays."""
    if p >= 1.0:
        return cand
    better = (
        Window.partitionBy("row_id")
        .orderBy(F.desc("logit"), "token_id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    mass = F.coalesce(F.sum("_prob").over(better), F.lit(0.0))
    return softmax(cand, "_prob").withColumn("_mass", mass).where(F.col("_mass") <= p).drop("_prob", "_mass")


def uniform(seed: int, *parts: str) -> Column:
    """A number in (0, 1) fixed by the seed and the columns, from the first 52 bits of their MD5."""
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts]).cast("binary"))
    return (F.conv(F.substring(mark, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def sample(cand: DataFrame, seed: int = 42) -> DataFrame:
    """One ``token_id`` per row, drawn from the softmax of its candidates (largest logit plus
    Gumbel noise)."""
    noisy = cand.withColumn("_g", F.col("logit") - F.log(-F.log(uniform(seed, "row_id", "token_id"))))
    return noisy.groupBy("row_id").agg(F.max_by("token_id", F.struct("_g", "token_id")).alias("token_id"))


def next_token(
    scores: DataFrame,
    history: DataFrame | None = None,
    penalty: float = 1.0,
    t: float = 0.8,
    k: int = 0,
    p: float = 0.95,
    seed: int = 42,
) -> DataFrame:
    """Penalty, temperature, top-k, top-p, then a draw; greedy at temperature 0. ``scores`` has arrays
    of ``logits``, or is a candidate table."""
    if "logits" in scores.columns:
        cand = candidates(scores, history=history, penalty=penalty)
    else:
        cand = scores if history is None else repetition_penalty(scores, history, penalty)
    cand = temperature(cand, t)
    if t <= 0:
        return cand.select("row_id", "token_id")
    return sample(top_p(top_k(cand, k), p), seed)


def truncate_prompts(prompts: DataFrame, context_length: int, ids: str = "ids") -> DataFrame:
    """Keep the last ``context_length - 1`` ids and flag what was cut."""
    keep = context_length - 1
    long = F.size(ids) > keep
    return prompts.withColumn("truncated", long).withColumn(
        ids, F.when(long, F.slice(ids, -keep, keep)).otherwise(F.col(ids))
    )


def cut_at_stop(generated: DataFrame, stop_ids: list[int] | None = None, ids: str = "ids") -> DataFrame:
    """The ids ahead of the first stop id; the end id always stops."""
    stops = sorted({SPECIAL_IDS["eos"], *(stop_ids or [])})
    first = [F.nullif(F.array_position(ids, s), F.lit(0)) for s in stops]
    at = F.array_min(F.array(*first))
    return generated.withColumn(
        ids, F.when(at.isNull(), F.col(ids)).otherwise(F.slice(ids, F.lit(1), (at - 1).cast("int")))
    )


def extract_response(texts: DataFrame, full: str = "full", prompt: str = "prompt") -> DataFrame:
    """Add ``response``: what follows the prompt's length in the full text."""
    return texts.withColumn("response", F.substring(F.col(full), F.length(prompt) + 1, F.length(full)))
