"""Scoring answers against an evaluation set, and summaries of scores (survey K13, D13-D17, D20, C21, B24)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragframe.functions import fixed
from ragframe.functions.text import is_abstention, matches, percent


def scored(rows: DataFrame) -> DataFrame:
    """Rows (id, type, should_refuse, expected_sources, expected_keywords, answer, urls) with their scores."""
    answer = F.lower("answer")
    refused = is_abstention(F.col("answer"))
    hit = F.exists("expected_sources", lambda e: F.exists("urls", lambda u: F.contains(F.lower(F.coalesce(u, F.lit(""))), F.lower(e))))
    hits = F.size(F.filter("expected_keywords", lambda k: F.contains(answer, F.lower(k))))
    wanted = F.size("expected_keywords")
    correct = F.when(F.col("should_refuse"), refused).when(wanted > 0, ~refused & (hits == wanted)).otherwise(~refused)
    return rows.select(
        "id", F.coalesce("type", F.lit("factual")).alias("type"), refused.alias("refused"), matches(answer, *fixed.LEAKS).alias("leaked"),
        F.when(F.size("expected_sources") > 0, hit).alias("retrieval_hit"), F.when(wanted > 0, F.concat_ws("/", hits.cast("string"), wanted.cast("string"))).otherwise("-").alias("kw_coverage"), correct.alias("answer_correct"),
    )


def summary(scores: DataFrame) -> DataFrame:
    """One row of counts and percentages; "-" where nothing counts."""
    yes = lambda c: F.sum(F.when(c, 1).otherwise(0))
    factual, correct = F.col("type") != "no_info", F.col("answer_correct")
    return scores.agg(
        F.count("*").alias("n"), percent(yes(correct), F.count("*")).alias("answer_accuracy"), percent(yes(F.coalesce("retrieval_hit", F.lit(False))), F.count("retrieval_hit")).alias("retrieval_recall"),
        percent(yes(factual & correct), yes(factual)).alias("factual_accuracy"), percent(yes(~factual & correct), yes(~factual)).alias("noinfo_correct"),
        yes(factual & F.col("refused")).alias("false_refusals"), yes(F.col("leaked")).alias("leaks"),
    )


def p95(rows: DataFrame, value: str) -> DataFrame:
    """The element at int(0.95 n) of the ascending list (its last at most), not an interpolation.

    The values below a bound are counted in partial aggregates: a row per distinct value, then running sums
    by range, so that no task sorts everything.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    bucket = F.floor(F.log2(F.abs("value") + 1) * 64 * F.signum("value"))
    sized = counts.withColumn("bucket", bucket)
    total = sized.groupBy("bucket").agg(F.sum("n").alias("in_bucket"))  # some thousands of buckets whatever the input
    above = total.select("bucket", (F.sum("in_bucket").over(Window.orderBy("bucket")) - F.col("in_bucket")).alias("before"), F.sum("in_bucket").over(Window.partitionBy()).alias("total"))
    upto = sized.join(above, "bucket").withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("bucket").orderBy("value")))
    place = F.least(F.col("total") - 1, F.floor(F.lit(0.95) * F.col("total"))) + 1
    return upto.filter(F.col("upto") >= place).agg(F.min("value").alias("p95"))


def nan_mean(value: Column) -> Column:
    """The mean of the numbers, NaN and null left out."""
    return F.avg(F.when(~F.isnan(value), value))


def ragas_eligible(rows: DataFrame) -> DataFrame:
    """Answered questions that have contexts and ought to be answered."""
    return rows.filter((F.col("type") != "no_info") & ~F.coalesce("should_refuse", F.lit(False)) & ~F.coalesce("refused", F.lit(False)) & (F.size("retrieved_contexts") > 0))


def baseline_summary(scores: DataFrame) -> DataFrame:
    """As `summary`, with the share of unanswerable questions that were answered anyway."""
    noinfo = F.col("type") == "no_info"
    yes = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return scores.agg(F.count("*").alias("n"), percent(yes(F.col("answer_correct")), F.count("*")).alias("answer_accuracy"), percent(yes(noinfo & ~F.col("refused")), yes(noinfo)).alias("hallucination_rate"))


def ragas_results(evaluated: DataFrame, scores: DataFrame, metrics: list[str]) -> DataFrame:
    """Id, type and each metric of the evaluated questions (id, type), in which NaN becomes null and a missing score too.

    The judge's rows come by id, where the survey's come by position.
    """
    held = [F.when(~F.isnan(m), F.col(m)).alias(m) if m in scores.columns else F.lit(None).cast("double").alias(m) for m in metrics]
    return evaluated.select("id", "type").join(scores.select("id", *held), "id", "left")
