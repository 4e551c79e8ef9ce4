"""A cache of context sentences by key, in buckets of which only the touched ones are written anew (survey A24, C8, C9)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import fresh_contexts, materialised, with_contexts

BUCKETS = 256  # a cache keeps the number it began with
_SCHEMA = "key string, context string, bucket int"


def bucket(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.crc32(key.cast("binary")), F.lit(buckets)).cast("int")


def read(spark: SparkSession, path: str) -> DataFrame:
    """key, context, bucket. A file that can't be read costs its keys only; a cache that isn't there is empty."""
    try:
        rows = spark.read.schema(_SCHEMA).option("ignoreCorruptFiles", True).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _SCHEMA)
    return rows.filter("key is not null and context is not null")


def merge(fresh: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Adds rows (key, context), each key once, newer ones in place of older. Buckets without new keys are neither read nor written.

    A bucket is replaced as a whole when the job commits: a run that breaks off leaves old buckets beside new ones, all
    of them whole, and the same merge again completes it.
    """
    new = materialised(fresh.select("key", "context", bucket(F.col("key"), buckets).alias("bucket")), "contexts")
    touched = new.select("bucket").distinct()  # `buckets` rows at most
    old = read(fresh.sparkSession, path).join(F.broadcast(touched), "bucket", "left_semi").join(new, "key", "left_anti")
    rows = materialised(old.select("key", "context", "bucket").unionByName(new), "buckets")  # a bucket is read before it is replaced
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def contextualised(chunks: DataFrame, documents: DataFrame, path: str, model, max_chars: int = 6000, buckets: int = BUCKETS) -> DataFrame:
    """chunks (chunk_id, source_url, text, others) with a context before the text; what the cache lacked is asked and kept.

    Where the model fails, or a text is null, the text stays as it is and is asked again next time.
    """
    spark = chunks.sparkSession
    fresh = materialised(fresh_contexts(chunks, documents, read(spark, path), model, max_chars), "asked")
    if not fresh.isEmpty():
        merge(fresh, path, buckets)
    return with_contexts(chunks, read(spark, path))
