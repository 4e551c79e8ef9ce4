"""From hits to a checked answer (survey K11, K12, E10-E13, C13-C15, D4, D11, F9, H8-H13)."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ragframe import seams
from ragframe.functions import fixed
from ragframe.functions.text import clean_answer, is_decline, is_meta, is_no_info, markdown_lists, markers, salient_tokens, sources_block, without_markers

SYSTEM = "Responda solo con el contexto y cite cada dato con su marcador [n]. Si el contexto no lo contiene, responda exactamente: " + fixed.ABSTENTION
NO_CONTEXT = "No hay contexto para esta consulta. Responda exactamente: " + fixed.ABSTENTION


def presented(hits: DataFrame) -> DataFrame:
    """Hits (query_id, rank, source_url, position, ...) with `place` (from 1) and `marker`.

    Chunks of a document stand together by position, documents by their best rank; then the even places go
    first and the odd ones last, backwards; markers number the documents as they then appear.
    """
    per_query = Window.partitionBy("query_id")
    rows = hits.withColumn("__doc", F.min("rank").over(Window.partitionBy("query_id", "source_url")))
    rows = rows.withColumn("__i", F.row_number().over(per_query.orderBy("__doc", "position", "rank")) - 1).withColumn("__n", F.count("*").over(per_query))
    odd = F.col("__i") % 2
    order = [F.when(F.col("__n") <= 2, 0).otherwise(odd), F.when((odd == 0) | (F.col("__n") <= 2), F.col("__i")).otherwise(-F.col("__i"))]
    rows = rows.withColumn("place", F.row_number().over(per_query.orderBy(*order)))
    rows = rows.withColumn("__first", F.min("place").over(Window.partitionBy("query_id", "source_url")))
    return rows.withColumn("marker", F.dense_rank().over(per_query.orderBy("__first"))).drop("__doc", "__i", "__n", "__first")


def source_map(shown: DataFrame) -> DataFrame:
    """One chunk for each marker, the first shown."""
    first = F.min_by(F.struct("title", F.col("source_url").alias("url")), "place")
    return shown.groupBy("query_id", "marker").agg(first.alias("source")).select("query_id", "marker", F.coalesce(F.nullif(F.col("source.title"), F.lit("")), F.lit("Sin título")).alias("title"), "source.url")


def messages(queries: DataFrame, shown: DataFrame) -> DataFrame:
    """query_id, system, user."""
    head = F.concat(F.lit("["), F.col("marker").cast("string"), F.lit("]"), F.when(F.length("title") > 0, F.concat(F.lit(" "), F.col("title"))).otherwise(F.lit("")), F.lit(" (Fuente: "), F.coalesce("source_url", F.lit("")), F.lit(")"))
    block = F.concat_ws("\n", F.lit("<fragmento>"), head, F.col("text"), F.lit("</fragmento>"))
    ordered = F.array_sort(F.collect_list(F.struct("place", block.alias("block"))))
    context = shown.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x.block), "\n").alias("context"))
    rows = queries.select("query_id", "text").join(context, "query_id", "left")
    user = F.concat(F.lit("<contexto>\n"), F.col("context"), F.lit("\n</contexto>\n\n<pregunta>\n"), F.col("text"), F.lit("\n</pregunta>"))
    return rows.select("query_id", F.when(F.col("context").isNull(), NO_CONTEXT).otherwise(SYSTEM).alias("system"), F.coalesce(user, F.col("text")).alias("user"))


def citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """query_id, valid, invalid, clean_text and sources (array of marker, title, url) of answers (query_id, answer)."""
    known = sources.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("marker", "title", "url"))).alias("known"))
    rows = answers.select("query_id", "answer", markers(F.col("answer")).alias("found")).join(known, "query_id", "left")
    numbers = F.coalesce(F.transform("known", lambda s: s.marker), F.expr("cast(array() as array<int>)"))
    rows = rows.withColumn("valid", F.array_intersect("found", numbers)).withColumn("invalid", F.array_except("found", numbers))
    kept = F.coalesce(F.filter("known", lambda s: F.array_contains(F.col("valid"), s.marker)), F.expr("cast(array() as array<struct<marker:int,title:string,url:string>>)"))
    return rows.select("query_id", "valid", "invalid", without_markers(F.col("answer"), F.col("invalid")).alias("clean_text"), kept.alias("sources"))


def coverage(answers: DataFrame, chunks: DataFrame, threshold: float = fixed.RECOVER_THRESHOLD) -> DataFrame:
    """For each answer (query_id, answer) and url the best share of the answer's tokens that a chunk (query_id, chunk_id, source_url, text) has."""
    own = answers.select("query_id", salient_tokens(F.col("answer")).alias("tokens"))
    rows = chunks.select("query_id", "chunk_id", "source_url", salient_tokens(F.col("text")).alias("t")).join(own, "query_id")
    rows = rows.withColumn("shared", F.size(F.array_intersect("t", "tokens"))).filter((F.col("shared") >= fixed.MIN_SHARED) & (F.size("tokens") > 0))
    rows = rows.withColumn("score", F.round(F.col("shared") / F.size("tokens"), 6)).filter(F.col("score") >= threshold)
    best = rows.groupBy("query_id", "source_url").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "source_url")))


def _salient(text: str) -> set[str]:
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    plain = re.sub(r"(\d{1,2}):\d{2}", r"\1", re.sub(r"\[\d+\]", " ", plain))
    return {t for t in re.findall("[a-z0-9]+", plain) if t not in fixed.STOPWORDS and (t.isdigit() or len(t) >= 3)}


def without_repeats(text: str, threshold: float = fixed.DEDUP_THRESHOLD) -> str:
    """Sentences that repeat an earlier kept one go; those with other numbers never do."""
    if not text.strip():
        return text
    kept: list[tuple[str, set[str], set[str]]] = []
    for sentence in re.split(r"(?<=[.!?])\s+", text.strip()):
        tokens = _salient(sentence)
        numbers = {t for t in tokens if t.isdigit()}
        again = any(numbers == n and len(tokens & t) >= fixed.MIN_SHARED and len(tokens & t) / len(tokens | t) >= threshold for _, t, n in kept)
        if sentence.strip() and not again:
            kept.append((sentence.strip(), tokens, numbers))
    return " ".join(s for s, *_ in kept)


def sentence_dedup(text: Column, threshold: float = fixed.DEDUP_THRESHOLD) -> Column:
    """The greedy fold over a text's sentences; it depends on their order, so it runs in Arrow batches."""

    def run(x: pa.Array) -> pa.Array:
        return pa.array((None if (t := v.as_py()) is None else without_repeats(t, threshold) for v in x), pa.string())

    run.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, StringType())(text)


def answer(queries: DataFrame, hits: DataFrame, generator=seams.extractive_answer, ui: bool = True) -> DataFrame:
    """query_id, answer, valid, invalid, sources, block. ui: with sentence dedup and lists; else the evaluation's chain."""
    shown = presented(hits)
    prompts = messages(queries, shown)
    text = clean_answer(F.coalesce(seams.generate(F.col("system"), F.col("user"), generator), F.lit(fixed.ABSTENTION)))
    if ui:
        text = sentence_dedup(text)
    rows = prompts.select("query_id", text.alias("answer"))
    if ui:
        rows = rows.withColumn("answer", markdown_lists(F.col("answer")))
    checked = citations(rows, source_map(shown)).join(queries.select("query_id", F.col("text").alias("__q")), "query_id")
    # an answer without markers gets the sources that cover it, unless it isn't about documents
    bare = checked.filter((F.size("sources") == 0) & ~is_no_info(F.col("clean_text")) & ~is_meta(F.col("__q")) & ~is_decline(F.col("clean_text")))
    found = coverage(bare.select("query_id", F.col("clean_text").alias("answer")), hits).join(source_map(shown).withColumnRenamed("url", "source_url"), ["query_id", "source_url"])
    found = found.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "marker", "title", F.col("source_url").alias("url")))), lambda s: F.struct(s.marker.alias("marker"), s.title.alias("title"), s.url.alias("url"))).alias("__found"))
    rows = checked.join(found, "query_id", "left").withColumn("sources", F.coalesce("__found", "sources"))
    return rows.select("query_id", F.col("clean_text").alias("answer"), "valid", "invalid", "sources", sources_block(F.col("sources")).alias("block"))
