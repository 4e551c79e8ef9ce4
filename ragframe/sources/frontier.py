"""A crawl with quotas and politeness that goes on where it broke off (survey A4, A20, C12, incremental persistence).

    path/level=<n>    url, category, priority, depth, host, slot

One table is the manifest, the set of what was seen, and (its last level) the frontier.  A level is written by one
job, whose marker of success makes it count: a level without it is made again, with the same rows, since what
it follows from is on disk.  So a level counts exactly once, whenever the crawl is stopped.

A level: links of the frontier that `keep` accepts for the category that found them and that no level holds; of
several categories that reach a url and have room, the one of the smallest priority owns it; of a category's urls the
first by name up to what is left of its quota.  A slot is a url's turn at its host within the level: fetch it
slot * delay seconds after the level begins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .web import host

LEVEL = "url string, category string, priority int, depth int, host string, slot int"


def _complete(spark: SparkSession, path: str, level: int) -> bool:
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/level={level}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def levels(spark: SparkSession, path: str) -> int:
    """How many levels count."""
    n = 0
    while _complete(spark, path, n):
        n += 1
    return n


def read(spark: SparkSession, path: str, first: int = 0, last: int | None = None) -> DataFrame:
    """The rows of the levels that count, from first to last."""
    n = levels(spark, path) if last is None else last + 1
    paths = [f"{path}/level={i}" for i in range(first, n)]
    return spark.read.schema(LEVEL).parquet(*paths) if paths else spark.createDataFrame([], LEVEL)


def _write(rows: DataFrame, path: str, level: int) -> None:
    turn = F.row_number().over(Window.partitionBy("host").orderBy("url")) - 1  # of one level, which the quotas bound
    named = rows.select("url", "category", "priority", F.lit(level).alias("depth"), host(F.col("url")).alias("host"))
    named.withColumn("slot", turn).write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{path}/level={level}")


def _owned(candidates: DataFrame, left: DataFrame, most: int) -> DataFrame:
    """Of candidates (url, category) those that an owner has room for; left: category, priority, left."""
    open_ = candidates.join(F.broadcast(left.filter("left > 0")), "category")  # a row a category
    own = open_.groupBy("url").agg(F.min(F.struct("priority", "category", "left")).alias("o")).select("url", "o.*")
    place = F.row_number().over(Window.partitionBy("category").orderBy("url"))
    # the constant bound lets every partition cut its own rows before they are dealt
    return own.withColumn("place", place).filter(F.col("place") <= most).filter("place <= left")


def crawl(seeds: DataFrame, quotas: DataFrame, link_table: DataFrame, keep: Callable[[Column, Column], Column], path: str, depth: int) -> DataFrame:
    """The rows of all levels up to depth (see LEVEL).

    seeds: url, category; they bypass `keep`, and not the quotas (category, priority, quota; a category without one gets
    nothing).  link_table: url, link.  Levels that count already are not made again, whatever the arguments.
    """
    spark = seeds.sparkSession
    quotas = quotas.select("category", F.col("priority").cast("int").alias("priority"), F.col("quota").cast("long").alias("quota"))
    most = quotas.agg(F.max("quota")).first()[0] or 0
    done = levels(spark, path)
    for level in range(done, depth + 1):
        if level == 0:
            found, left = seeds.select("url", "category").filter("url is not null").distinct(), quotas.withColumn("left", F.col("quota"))
        else:
            frontier = read(spark, path, level - 1, level - 1)
            if frontier.isEmpty():
                break
            seen = read(spark, path, 0, level - 1)
            reached = frontier.select("url", "category").join(link_table.select("url", "link"), "url").select(F.col("link").alias("url"), "category").distinct()
            found = reached.filter("url is not null").filter(keep(F.col("category"), F.col("url"))).join(seen.select("url"), "url", "left_anti")
            left = quotas.join(seen.groupBy("category").agg(F.count("*").alias("had")), "category", "left").withColumn("left", F.col("quota") - F.coalesce("had", F.lit(0)))
        _write(_owned(found, left, most), path, level)
    return read(spark, path, 0, min(depth, levels(spark, path) - 1))


def schedule(rows: DataFrame, delay: float) -> DataFrame:
    """The crawl's rows with `after`, the seconds from the beginning of a url's level to its fetch."""
    return rows.withColumn("after", F.col("slot") * F.lit(float(delay)))
