"""A training corpus from raw documents: five stages, each written and read again.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents.  Rejected and duplicate documents go, secrets are replaced in the text, and what is left is
packed into sequences.

Defined results.  A null text scores, copies, and packs as an empty one; it stays null until it is packed.
Empty texts are copies of each other.  A very long text is treated as any other and cut only when packed.
Where the classifier has nothing to learn from, every document scores 0.5 and stays.  Of equal and of near
texts the smallest doc_id stays; rows that repeat an id and its text become one row, rows without id stay
unless they copy one that has an id.  Further columns come along, whatever their names; the last stage
leaves them out.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ragframe.llm import exact_dedup, near_dedup, packing, quality, secrets
from ragframe.llm.common import saved, small_batches, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from labelled documents of the corpus itself."""
    small_batches(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    small_batches(spark)
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: shingles of five words, a similarity of 0.8 or more."""
    small_batches(spark)
    return near_dedup.drop_near_copies(docs, k=5, percent=80)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    small_batches(spark)
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("secrets", secret_stage), ("packing", packing_stage)]

#: The model-based stages can't be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
