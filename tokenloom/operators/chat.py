"""Chat conversations as ids or as text. Messages are rows of ``conv_id``, ``turn``, ``role``, ``text``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.tables import ROLES, SPECIAL_IDS, SPECIALS


def _in_turn_order(value: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("turn", value.alias("v")))), lambda m: m["v"])


def encode_chat(
    messages: DataFrame, ids_of: Callable[[Column], Column], add_generation_prompt: bool = True
) -> DataFrame:
    """One row per conversation: the start id, then a role marker and the content ids of each
    message, then the assistant marker. An unknown or null role has no marker; its content stays. A null
    text has no content ids; its marker stays."""
    marker = F.lit(None).cast("int")
    for role in ROLES:
        marker = F.when(F.col("role") == role, SPECIAL_IDS[role]).otherwise(marker)
    content = F.coalesce("content_ids", F.array().cast("array<int>"))
    message_ids = F.concat(F.array_compact(F.array(marker)), content)
    bodies = (
        messages.withColumn("content_ids", ids_of(F.col("text")))
        .groupBy("conv_id")
        .agg(F.flatten(_in_turn_order(message_ids)).alias("body"))
    )
    tail = F.array(F.lit(SPECIAL_IDS["assistant"])) if add_generation_prompt else F.array().cast("array<int>")
    return bodies.select("conv_id", F.concat(F.array(F.lit(SPECIAL_IDS["bos"])), "body", tail).alias("ids"))


def render_chat(messages: DataFrame) -> DataFrame:
    """One text per conversation: ``<|role|>``, newline, content, newline for each message, then
    the assistant marker. A missing role counts as user, missing content as empty."""
    line = F.concat(
        F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n")
    )
    return messages.groupBy("conv_id").agg(
        F.concat(F.array_join(_in_turn_order(line), ""), F.lit(SPECIALS["assistant"] + "\n")).alias("prompt")
    )
