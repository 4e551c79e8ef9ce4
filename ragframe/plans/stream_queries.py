"""Queries that run the tables as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragframe.sources import store
from ragframe.streaming import conversations

from .dialogue_queries import _questions
from .registry import ORACLE, query, table


def _in_two_runs(spark, turns, step):
    """step over a stream of turns: the first turns of all conversations, then, in a query started anew, the others."""
    path = store.scratch(spark, "turns")
    stream = lambda: spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 64).parquet(f"{path}/in")
    for part in ("turn < 3", "turn >= 3 or turn is null"):
        turns.filter(part).write.mode("append").parquet(f"{path}/in")
        conversations.started(step(stream()), path).awaitTermination()
    return spark.read.parquet(f"{path}/rows")


@query(ORACLE["entity_carry"])
def entity_carry_stream(spark, sf_dir):
    """E14, C20 and per-session state: the rows of entity_carry, from a stream that is broken off and goes on."""
    suffix = F.when(F.col("turn") % 5 == 0, " grupo B").when(F.col("turn") % 5 == 2, " grupo C teoría").otherwise("")
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", F.nullif(F.upper(F.regexp_extract(F.concat("text", suffix), " grupo ([A-H])( |$)", 1)), F.lit("")).alias("own"))
    rows = _in_two_runs(spark, turns, lambda s: conversations.last_named(s, "conv_id", ("own",)))
    return rows.select("conv_id", "turn", "own", F.col("last_own").alias("carried"))


def enriched_stream(spark, sf_dir):
    """H32 whole, on a stream of every turn with one of the phrases before its text; the batch form is its test."""
    turns = _questions(spark, sf_dir).select("conv_id", "turn", F.lit("user").alias("role"), "text")
    return _in_two_runs(spark, turns, conversations.carried)


query(None)(enriched_stream)
