"""Exact deduplication with a heavy-hitter split.

Texts are equal when they are identical after every run of ASCII white space became one space.
A Misra-Gries summary finds the digests that a large share of the rows may have; their exact
counts are taken in a second pass, and the verified ones (at most `counters` rows) are broadcast,
so that copies of a frequent text are settled where they are read.  The other digests, none of
which can have more than n / (counters + 1) rows, go through one ordinary shuffle.

Defined results.  Null text counts as empty; empty texts are equal to each other.  Of equal texts
the smallest doc_id stays, a null doc_id only where all of the group are null.  Rows with the same
doc_id and equal texts are one document: they are marked alike, and `drop_copies` leaves one row.
An empty table gives an empty result; further columns are carried by `drop_copies` and left out of
the report.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parted, saved

#: Counters of a summary: digests in more than 1 / (COUNTERS + 1) of the rows are found for sure.
COUNTERS = 1024
#: Summaries that one merging task reads.
FAN_IN = 32


def normalised(text="text"):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def digest(text="text"):
    return F.sha2(normalised(text).cast("binary"), 256)


def shrink(counts: pd.Series, counters: int) -> pd.Series:
    """The Misra-Gries step for many rows at once: takes the (counters+1)-th largest count from all."""
    if len(counts) <= counters:
        return counts
    counts = counts.sort_values(ascending=False, kind="stable")
    counts = counts - counts.iloc[counters]
    return counts[counts > 0]


def _summary(counters: int):
    def run(batches):
        held = pd.Series(dtype="int64")
        for x in batches:
            held = shrink(held.add(x.groupby("digest").n.sum(), fill_value=0), counters)
        yield pd.DataFrame({"digest": held.index.astype(object), "n": held.to_numpy("int64")})

    return run


def frequent(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Candidates (digest, n) for the frequent values of a column: at most `counters` rows.

    Summaries of tasks merge in rounds of FAN_IN, so the driver never reads more than FAN_IN of them.
    """
    schema = "digest string, n long"
    run = _summary(counters)
    out = saved(digests.select("digest", F.lit(1).cast("long").alias("n")).mapInPandas(run, schema), "frequent")
    while (rows := out.count()) > counters * FAN_IN:
        left = max(2, rows // (counters * FAN_IN))
        # dealt by digest: the counters of one value meet in one task
        out = saved(out.repartition(left, "digest").mapInPandas(run, schema), "frequent")
    merged = shrink(out.toPandas().groupby("digest").n.sum(), counters)
    return digests.sparkSession.createDataFrame([(str(k), int(v)) for k, v in merged.items()], schema)


def winners(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Exact (digest, keep_id, group_size) of the frequent digests that have copies: at most `counters` rows."""
    found = frequent(digests, counters).select("digest")
    counted = digests.join(F.broadcast(found), "digest").groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return saved(counted.filter("group_size > 1"), "winners")


def _grouped(digests: DataFrame, counters: int) -> DataFrame:
    """doc_id, digest, keep_id and group_size of every row of digests."""
    marked = digests.join(F.broadcast(winners(digests, counters)), "digest", "left")
    group = Window.partitionBy("digest")
    rest = marked.filter("group_size is null").select("doc_id", "digest", F.min("doc_id").over(group).alias("keep_id"), F.count("*").over(group).alias("group_size"))
    return marked.filter("group_size is not null").select("doc_id", "digest", "keep_id", "group_size").unionByName(rest)


def report(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = saved(docs.select("doc_id", digest().alias("digest")), "digests")
    both = _grouped(digests, counters)
    return both.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The rows of docs, with all their columns, without copies: of equal texts one row stays.

    Copies are told on ids and digests.  Only rows whose id may be that of a copy are dealt with their texts.
    """
    digests = saved(docs.select("doc_id", digest().alias("digest")), "digests")
    groups = _grouped(digests, counters).filter("group_size > 1").groupBy("doc_id", "digest").agg(F.count("*").alias("n"), F.min("keep_id").alias("keep_id"))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    # a row here for each copy to drop and for each repeated row; most documents have none
    told = groups.filter(~stays | (F.col("n") > 1)).select(F.col("doc_id").alias("owner"), F.col("digest").alias("told"), F.when(stays, "once").otherwise("drop").alias("fate"))
    told = saved(told, "told")
    clear, rest = parted(docs, told.select(F.col("owner").alias("doc_id")).filter("doc_id is not null").distinct(), "doc_id")
    # a row as one column, so that its names can't clash
    rows = rest.select("doc_id", digest().alias("digest"), F.struct(*docs.columns).alias("row"))
    rows = rows.join(told, (F.col("digest") == F.col("told")) & F.col("doc_id").eqNullSafe(F.col("owner")), "left").filter("fate is null or fate = 'once'")
    # `once` takes one row of each key; the others are each a key of their own
    rows = rows.withColumn("single", F.when(F.col("fate").isNull(), F.monotonically_increasing_id()))
    first = F.row_number().over(Window.partitionBy("digest", "doc_id", "single").orderBy("single"))
    return clear.unionByName(rows.withColumn("place", first).filter("place = 1").select("row.*"))
