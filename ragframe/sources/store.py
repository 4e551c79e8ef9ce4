"""Reading and writing the corpus and its indexes (survey A14-A30)."""

from __future__ import annotations

import tempfile
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ragframe.functions.text import content_hash, preview
from ragframe.operators.search import Bm25Index

CORPUS = "url string, title string, category string, source_type string, text string, char_count long, fetched_at string, metadata map<string,string>"
EVAL_SET = "id string, query string, category string, type string, expected_sources array<string>, expected_keywords array<string>, should_refuse boolean"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of its own for a run on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="ragframe-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Bytes of a batch for Python while a table is written.
ARROW_BYTES = 1 << 21


@contextmanager
def small_batches(spark: SparkSession):
    """Batches for Python are of ARROW_BYTES at most; the session's own setting comes back."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(limit)
    spark.conf.set(limit, ARROW_BYTES)
    try:
        yield
    finally:
        spark.conf.set(limit, before)


def materialised(df: DataFrame, name: str = "rows") -> DataFrame:
    """df, written to the shared folder and read back; what runs in Python for it gets small batches."""
    path = scratch(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_corpus(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The corpus's JSON lines; a bad line fails the job, or ends up in _corrupt_record."""
    if strict:
        return spark.read.schema(CORPUS).option("mode", "FAILFAST").json(path)
    return spark.read.schema(CORPUS + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def documents(corpus: DataFrame) -> DataFrame:
    """A corpus's rows with defaults; rows without url, text or a readable time go."""
    at = F.try_to_timestamp("fetched_at")
    return corpus.select("url", F.coalesce("source_type", F.lit("html")).alias("source_type"), "title", "text", F.coalesce("category", F.lit("general")).alias("category"), at.alias("fetched_at"), F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata")).filter("url is not null and text is not null and fetched_at is not null")


def write_corpus(docs: DataFrame, path: str) -> None:
    """Parquet by category."""
    docs.write.mode("overwrite").partitionBy("category").parquet(path)


def export_jsonl(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").json(path)


def export_csv(docs: DataFrame, path: str) -> None:
    """Six columns, without texts."""
    docs.select("url", "title", "category", "source_type", "char_count", "fetched_at").write.mode("overwrite").option("header", True).csv(path)


def review_rows(docs: DataFrame, order: str, text: Column, *columns: str, width: int = 200) -> DataFrame:
    """Rows for review, numbered, with a preview.

    Numbers come from counts by range, so that no task sorts the corpus: rows are sorted in ranges, and a
    range's number starts after those before it.
    """
    ranged = docs.select(order, *columns, preview(text, width).alias("preview")).repartitionByRange(order).withColumn("__range", F.spark_partition_id())
    ranged = materialised(ranged, "review")  # ranges come from a sample: both uses must see the same ones
    counts = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = counts.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))  # a row for each range
    place = F.row_number().over(Window.partitionBy("__range").orderBy(order))
    return ranged.join(before, "__range").select((F.col("__before") + place).alias("row_no"), order, *columns, "preview")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A19."""
    return spark.read.option("header", True).csv(path)


def save_index(index: Bm25Index, path: str) -> None:
    """Four Parquet tables."""
    for name in ("postings", "lengths", "terms", "totals"):
        getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load_index(spark: SparkSession, path: str) -> Bm25Index:
    return Bm25Index(*[spark.read.parquet(f"{path}/{name}") for name in ("postings", "lengths", "terms", "totals")])


def save_vectors(chunks: DataFrame, path: str) -> None:
    """Vectors and metadata, both keyed by chunk_id."""
    chunks.select("chunk_id", "vector").write.mode("overwrite").parquet(f"{path}/vectors")
    chunks.drop("vector").write.mode("overwrite").parquet(f"{path}/chunks")


def append_vectors(chunks: DataFrame, path: str) -> int:
    """Incremental indexing: adds the chunks whose chunk_id the index lacks, and returns how many; a batch counts an id once."""
    spark = chunks.sparkSession
    fresh = materialised(chunks.dropDuplicates(["chunk_id"]).join(spark.read.parquet(f"{path}/chunks").select("chunk_id"), "chunk_id", "left_anti").select(*chunks.columns), "fresh")
    fresh.select("chunk_id", "vector").write.mode("append").parquet(f"{path}/vectors")
    fresh.drop("vector").write.mode("append").parquet(f"{path}/chunks")
    return fresh.count()


def index_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Chunks, dimension and bytes of the vectors of a saved index; one row."""
    return spark.read.parquet(f"{path}/vectors").agg(F.count("*").alias("chunks"), F.max(F.size("vector")).alias("dimension"), F.sum(4 * F.size("vector")).alias("vector_bytes"))


def remove_versioned(docs: DataFrame, doomed: Column, path: str, version: str) -> DataFrame:
    """The corpus without the doomed rows, as a new version beside a backup of the removed ones; returns the version."""
    gone = F.coalesce(doomed, F.lit(False))
    docs.filter(gone).write.mode("overwrite").parquet(f"{path}/{version}-removed")
    docs.filter(~gone).write.mode("overwrite").parquet(f"{path}/{version}")
    return docs.sparkSession.read.schema(docs.schema).parquet(f"{path}/{version}")


def append_manifest(level: DataFrame, path: str) -> None:
    """A level's rows (url, status, category, type, bytes, depth) with the time, added to the crawl's manifest."""
    level.withColumn("timestamp", F.current_timestamp()).write.mode("append").json(path)


def report_lines(manifest: DataFrame) -> DataFrame:
    """A crawl's report, a line for each status and for each category of what was fetched; write it with the text sink."""
    by = lambda column, name, rows: rows.groupBy(column).agg(F.count("*").alias("n")).select(F.concat(F.lit(name), F.coalesce(F.col(column), F.lit("-")), F.lit(": "), F.col("n").cast("string")).alias("line"))
    return by("status", "status ", manifest).unionByName(by("category", "category ", manifest.filter("status = 'ok'")))


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/chunks").join(spark.read.parquet(f"{path}/vectors"), "chunk_id")


def fresh_contexts(chunks: DataFrame, documents_: DataFrame, cache: DataFrame, model, max_chars: int = 6000) -> DataFrame:
    """Key, context of the texts that the cache (key, context) lacks; those for which the model fails are left out.

    A text that several documents hold is asked once, with the document of the smallest url.
    """
    from ragframe import seams
    from ragframe.functions.text import sanitise_context

    keyed = chunks.select(content_hash(F.col("text"), 24).alias("key"), "source_url", "text").filter("key is not null")
    todo = keyed.join(cache.select("key"), "key", "left_anti").groupBy("key").agg(F.min("source_url").alias("source_url"), F.first("text").alias("text"))
    whole = documents_.select(F.col("url").alias("source_url"), F.coalesce(F.substring("text", 1, max_chars), "title", F.lit("")).alias("whole"))
    asked = todo.join(whole, "source_url", "left").select("key", seams.generate(F.coalesce("whole", F.lit("")), F.col("text"), model).alias("context"))
    return asked.filter(F.col("context").isNotNull()).select("key", sanitise_context(F.col("context")).alias("context"))


def with_contexts(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Chunks with the cache's context before the text."""
    from ragframe.functions.text import with_context

    held = cache.select(F.col("key").alias("__key"), F.col("context").alias("__context"))
    rows = chunks.withColumn("__key", content_hash(F.col("text"), 24)).join(held, "__key", "left")
    return rows.withColumn("text", with_context(F.coalesce("__context", F.lit("")), F.col("text"))).drop("__key", "__context")


def contextualised(chunks: DataFrame, documents_: DataFrame, cache: DataFrame | None, model, max_chars: int = 6000) -> tuple[DataFrame, DataFrame]:
    """Chunks (chunk_id, source_url, text) with a context sentence before the text, and the new cache (key, context)."""
    old = cache if cache is not None else chunks.sparkSession.createDataFrame([], "key string, context string")
    held = old.unionByName(fresh_contexts(chunks, documents_, old, model, max_chars))
    return with_contexts(chunks, held), held


def observed_write(rows: DataFrame, kept: Column, path: str, counts: dict[str, Column]) -> dict[str, float]:
    """Writes the kept rows to path and counts, in the same pass, how often each condition holds over all rows.

    Returns the counts with `rows`, `seconds` and `rows_per_second`; only these go to the driver.
    """
    seen = Observation("written")
    begun = time.monotonic()
    found = [F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in counts.items()]
    rows.observe(seen, F.count("*").alias("rows"), *found).filter(F.coalesce(kept, F.lit(False))).write.mode("overwrite").parquet(path)
    seconds = time.monotonic() - begun
    return {**seen.get, "seconds": seconds, "rows_per_second": seen.get["rows"] / max(seconds, 1e-9)}


def events(rows: DataFrame, module: str, event: str, at: Column, *fields: str) -> DataFrame:
    """A structured log: timestamp, level, module, event and the other fields as JSON."""
    return rows.select(at.alias("timestamp"), F.lit("INFO").alias("level"), F.lit(module).alias("module"), F.lit(event).alias("event"), F.to_json(F.struct(*fields)).alias("extras"))


def export_ragas(rows: DataFrame, path: str) -> None:
    """One JSON line for each question, with what was retrieved and answered."""
    rows.select("id", "type", F.coalesce("should_refuse", F.lit(False)).alias("should_refuse"), "refused", F.col("query").alias("user_input"), F.col("answer").alias("response"), "retrieved_contexts", F.coalesce("expected_keywords", F.array().cast("array<string>")).alias("expected_keywords")).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_ragas(spark: SparkSession, path: str) -> DataFrame:
    """The exported lines again."""
    return spark.read.schema("id string, type string, should_refuse boolean, refused boolean, user_input string, response string, retrieved_contexts array<string>, expected_keywords array<string>").json(path)


def read_eval_set(spark: SparkSession, path: str) -> DataFrame:
    """A28."""
    return spark.read.schema(EVAL_SET).json(path)


