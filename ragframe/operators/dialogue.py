"""Conversations: history, carried entities, titles (survey E14, E15, E19, E20, C20, H32)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragframe.functions import fixed, intent
from ragframe.functions.text import sanitise_history, stripped

ENTITIES = ("subject", "tipo", "grupo", "subgrupo")


def carried(turns: DataFrame, lookback: int = 6) -> DataFrame:
    """Each user turn (conv_id, turn, text) with `enriched`: a follow-up gets what it lacks from the last user turns.

    An as-of join per entity, written as one window over a conversation's user turns.
    """
    users = turns.filter("role = 'user'").withColumn("found", intent.entities(F.col("text")))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-lookback, -1)
    for e in ENTITIES:
        users = users.withColumn(f"last_{e}", F.last(f"found.{e}", ignorenulls=True).over(before))
    more = [F.when(F.col(f"found.{e}").isNull(), F.col(f"last_{e}")) for e in ENTITIES]
    added = F.array_join(F.filter(F.array(*more), lambda x: x.isNotNull()), " ")
    follow = intent.is_followup(F.col("text"), F.col("found"))
    enriched = F.when(follow & (F.length(added) > 0), F.concat(stripped(F.col("text")), F.lit(" "), added)).otherwise(F.col("text"))
    return users.select("conv_id", "turn", "text", enriched.alias("enriched"))


def history(turns: DataFrame, max_turns: int) -> DataFrame:
    """The last 2 * max_turns messages before the current one, without the greeting; answers are sanitised."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.withColumn("__i", F.row_number().over(order)).withColumn("__n", F.count("*").over(Window.partitionBy("conv_id")))
    rows = rows.filter((F.col("__i") > 1) & (F.col("__i") < F.col("__n")) & (F.col("__n") > 2))
    rows = rows.withColumn("text", F.when(F.col("role") == "assistant", sanitise_history(F.col("text"))).otherwise(F.col("text"))).filter(F.length(stripped(F.col("text"))) > 0)
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return rows.withColumn("__back", back).filter(F.col("__back") <= 2 * max_turns).select("conv_id", "turn", "role", "text")


def titles(turns: DataFrame) -> DataFrame:
    """The first user message, cut to 40 characters and an ellipsis."""
    first = turns.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return first.select("conv_id", F.when(F.length("text") > 40, F.concat(F.substring("text", 1, 40), F.lit("..."))).otherwise(F.col("text")).alias("title"))


def closings(turns: DataFrame) -> DataFrame:
    """A closing phrase for each assistant turn, never the one of the turn before; by hash, not by chance."""
    n = len(fixed.CLOSINGS)
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.filter("role = 'assistant'").withColumn("__step", F.pmod(F.crc32(F.concat_ws(":", "conv_id", "turn").cast("binary")), F.lit(n - 1)) + 1)
    place = F.pmod(F.sum("__step").over(order), F.lit(n))  # steps of 1 to n-1: two turns in a row differ
    return rows.select("conv_id", "turn", F.element_at(F.array(*map(F.lit, fixed.CLOSINGS)), (place + 1).cast("int")).alias("closing"))
