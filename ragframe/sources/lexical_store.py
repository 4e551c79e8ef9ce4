"""A lexical index that grows by batches (survey A23, D1, incremental index).

    path/postings/batch=<id>/bucket=<hash of term>   term, id, tf, dl; sorted by term within a file
    path/terms/batch=<id>/bucket=...                 term, df within the batch
    path/ids/batch=<id>                              id, dl
    path/totals/batch=<id>                           n, length; written last: a batch without it doesn't exist

Statistics add up: df, the number of texts and their length are sums over batches, and idf follows from the sums
when the index is read, so an append touches nothing that is there.  Appending a batch again replaces it, and ids
that another batch holds are left out, so that neither a repeated batch nor a repeated text counts twice.  A search
reads only the buckets of its terms.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragframe.functions.text import bm25_tokens
from ragframe.operators.search import Bm25Index, bm25_search, counted_terms, weighted_terms

from .store import materialised

#: Buckets of terms, postings that one task sorts and writes (a bucket of more is written in parts), and tasks of a small batch.
BUCKETS, TASK_POSTINGS, LEAST_TASKS = 64, 1 << 20, 16
_TABLES = {"postings": "term string, id {id}, tf long, dl int", "terms": "term string, df long", "ids": "id {id}, dl int", "totals": "n long, length long"}


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _read(spark: SparkSession, path: str, name: str, kind: str) -> DataFrame:
    """A table of all committed batches, with batch and, for tables of terms, bucket."""
    schema = _TABLES[name].format(id=kind) + (", bucket int" if name in ("postings", "terms") else "") + ", batch string"
    rows = spark.read.schema(schema).parquet(f"{path}/{name}")
    if name == "totals":
        return rows
    return rows.join(F.broadcast(_read(spark, path, "totals", kind).select("batch")), "batch", "left_semi")  # a row a batch


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def append(docs: DataFrame, key: str, text: Column, path: str, batch: str) -> None:
    """Adds the texts of docs whose key no other batch holds; a key that docs repeats counts once, null keys don't count.

    The batch's former rows are replaced.  An append that breaks off leaves the index as it was before, without
    this batch; it can be made again.  One writer at a time.
    """
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
        raise ValueError(f"not a batch id: {batch!r}")
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.coalesce(text, F.lit("")).alias("text")).filter("id is not null")
    if _exists(spark, f"{path}/totals"):
        rows = rows.join(_read(spark, path, "ids", kind).filter(F.col("batch") != batch).select("id"), "id", "left_anti")
        spark.createDataFrame([], "n long, length long").coalesce(1).write.mode("overwrite").parquet(f"{path}/totals/batch={batch}")  # the batch is open until its totals are there
    # copies of a key are told apart by where they lie: texts are counted where they are, and only counts of keys are shuffled
    marked = rows.select(F.struct("id", F.monotonically_increasing_id().alias("mark")).alias("id"), "text")
    counted = materialised(counted_terms(marked, "id", F.col("text")).select("term", "id.id", "tf", "dl", "id.mark"), "counted")
    again = materialised(counted.filter("tf = 0").groupBy("id").agg(F.min("mark").alias("first"), F.count("*").alias("n")).filter("n > 1").select("id", "first"), "again")
    if not again.isEmpty():
        counted = counted.join(again, "id", "left").filter("first is null or mark = first").select(*counted.columns)
    postings = counted.filter("term is not null").select("term", "id", "tf", "dl", bucket(F.col("term")).alias("bucket"))
    tasks = max(LEAST_TASKS, -(-counted.count() // TASK_POSTINGS))
    if tasks <= BUCKETS:  # a task writes neighbouring buckets
        task = F.floor(F.col("bucket") * tasks / BUCKETS)
    else:  # or a part of one
        parts = -(-tasks // BUCKETS)
        tasks, task = BUCKETS * parts, F.col("bucket") * parts + F.pmod(F.xxhash64("id"), F.lit(parts))
    dealt = postings.repartitionById(tasks, task.cast("int")).sortWithinPartitions("bucket", "term")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/batch={batch}")
    # what was written lies by term, so that a task deals one row for most of its terms
    df = spark.read.schema(_TABLES["postings"].format(id=kind) + ", bucket int").parquet(f"{path}/postings/batch={batch}").groupBy("bucket", "term").agg(F.count("*").alias("df"))
    df.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms/batch={batch}")
    counted.filter("tf = 0").select("id", "dl").write.mode("overwrite").parquet(f"{path}/ids/batch={batch}")  # a row a text
    ids = spark.read.schema(_TABLES["ids"].format(id=kind)).parquet(f"{path}/ids/batch={batch}")
    ids.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("length")).write.mode("overwrite").parquet(f"{path}/totals/batch={batch}")


def load(spark: SparkSession, path: str, kind: str = "bigint", buckets: list[int] | None = None) -> Bm25Index:
    """The index as the sum of its batches; with buckets only the postings of these (statistics are always those of all)."""
    postings, ids = _read(spark, path, "postings", kind), _read(spark, path, "ids", kind)
    if buckets is not None:
        postings = postings.filter(F.col("bucket").isin(buckets))
    counts = _read(spark, path, "terms", kind).groupBy("term").agg(F.sum("df").alias("df"))
    totals = _read(spark, path, "totals", kind).agg(F.sum("n").alias("n"), (F.sum("length") / F.sum("n")).alias("avgdl"))
    return Bm25Index(postings.select("term", "id", "tf", "dl"), ids.select("id", "dl"), weighted_terms(counts, totals), totals, materialised, apart=True)


def search(path: str, queries: DataFrame, query: str, text: Column, k: int, kind: str = "bigint") -> DataFrame:
    """bm25_search over the buckets that hold the queries' terms: at most BUCKETS numbers come to the driver first."""
    asked = queries.select(F.explode(bm25_tokens(text)).alias("term")).select(bucket(F.col("term")).alias("bucket")).distinct().collect()
    index = load(queries.sparkSession, path, kind, sorted(r.bucket for r in asked))
    return bm25_search(index, queries, query, text, k)
