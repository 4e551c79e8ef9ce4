"""The retrieval cascade over batches of queries (survey K6, K8-K10, C3-C7, B18-B20, E9, F5, F6, H36).

queries: query_id, text, vector.  chunks: chunk_id, text, title, source_url, position, category, tipo,
siglas, is_summary, curso, vector.  Both ids are numbers.  Every step keeps query_id, so a batch is one plan; what a step adds or
drops is a join or a filter, and only the choice of diverse results, over a bounded pool, runs in Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragframe import seams
from ragframe.functions import fixed, intent
from ragframe.functions.text import is_meta, java, matches

from .search import bm25_index, bm25_search, inner, knn, mmr, ranked, rrf, shuffled


@dataclass
class Config:
    """Production values; a reranker is a function of (query, text), a sequence of models, each the fallback of those before, or None."""

    k_candidates: int = fixed.K_CANDIDATES
    k_final: int = fixed.K_FINAL
    k_listing: int = fixed.K_FINAL_LISTING
    threshold: float = fixed.SIMILARITY_THRESHOLD
    mmr_weight: float = fixed.MMR_LAMBDA
    rrf_k: int = fixed.RRF_K
    hybrid: bool = True
    reranker: object = seams.lexical_score
    penalty: float = fixed.OFF_CATEGORY_PENALTY
    keep: object = None  # writes a DataFrame and reads it back, for what several steps read


def understood(queries: DataFrame) -> DataFrame:
    """What the rules say about each query."""
    text = F.col("text")
    return queries.select(
        "query_id", "text", "vector", intent.routes(text).alias("route"), intent.is_listing(text).alias("listing"), intent.subjects(text).alias("subjects"),
        intent.wanted_type(text).alias("wanted"), intent.course(text).alias("course"), matches(text, r"asignaturas?|materias?|qué\s+se\s+imparte").alias("about_subjects"),
        F.regexp_extract_all(text, F.lit(java(fixed.SIGLA, "")), F.lit(1)).alias("short_forms"),
    )


def chunk_subjects(tipo: Column, siglas: Column, summary: Column, title: Column, text: Column) -> Column:
    """The subjects that a chunk is about; none for catalogues, which no filter drops."""
    own = F.coalesce(siglas, F.expr("cast(array() as array<string>)"))
    derived = intent.subjects(F.coalesce(F.nullif(title, F.lit("")), F.split_part(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(1))))
    catalogue = F.coalesce(summary, F.lit(False)) | F.coalesce(tipo == "plan_estudios", F.lit(False))
    return F.when(catalogue, F.expr("cast(array() as array<string>)")).when(F.size(own) > 0, own).otherwise(derived)


def structured_boost(tipo: Column, siglas: Column, summary: Column, short_forms: Column, about_subjects: Column) -> Column:
    """K9: timetable records of a named subject, and summaries where subjects are asked for, count more."""
    named = F.when(F.arrays_overlap(siglas, short_forms), fixed.SIGLA_BOOST).otherwise(1.0)
    listed = F.when(F.coalesce(summary, F.lit(False)) & about_subjects, fixed.SUMMARY_BOOST).otherwise(1.0)
    return F.when(F.coalesce(tipo == "horario", F.lit(False)), named * listed).otherwise(F.lit(1.0))


def candidates(queries: DataFrame, chunks: DataFrame, config: Config) -> DataFrame:
    """query, id, score: the dense ranking, fused with the lexical one, scored densely."""
    asked = queries.select(F.col("query_id").alias("chunk_id"), "vector")
    dense = knn(chunks, "chunk_id", "vector", asked, config.k_candidates)
    if not config.hybrid:
        return dense.select("query", "id", "score")
    index = bm25_index(chunks, "chunk_id", F.concat_ws("\n", F.nullif(F.col("title"), F.lit("")), F.col("text")), config.keep)
    lexical = bm25_search(index, queries, "query_id", F.col("text"), config.k_candidates)
    fused = rrf(dense.select("query", "id", "rank").unionByName(lexical.select("query", "id", "rank")), config.rrf_k).filter(F.col("rank") <= config.k_candidates)
    vectors = chunks.select(F.col("chunk_id").alias("id"), F.col("vector").alias("v"))
    scored = fused.select("query", "id").join(shuffled(vectors), "id").join(shuffled(queries.select(F.col("query_id").alias("query"), F.col("vector").alias("q"))), "query")
    return scored.select("query", "id", inner("v", "q").alias("score"))


def retrieve(queries: DataFrame, chunks: DataFrame, config: Config | None = None) -> DataFrame:
    """query_id, rank, chunk_id, score, source_url, title, position, text, category; queries without hits are absent."""
    config = config or Config()
    if config.keep:  # vectors come from a model: no step computes them again
        queries, chunks = config.keep(queries), config.keep(chunks)
    told = understood(queries)
    meta = chunks.select(F.col("chunk_id").alias("id"), "text", "title", "source_url", "position", "category", "tipo", "siglas", F.coalesce("is_summary", F.lit(False)).alias("is_summary"), "curso", "vector")
    keep = config.keep or (lambda rows: rows)
    pool = keep(candidates(queries, chunks, config))
    about = told.select(F.col("query_id").alias("query"), *[c for c in told.columns if c not in ("query_id", "text", "vector")], F.col("text").alias("query_text"), F.col("vector").alias("q"))
    k = F.when(F.col("listing"), config.k_listing).otherwise(config.k_final)

    # routed categories add their best chunks
    # beyond the pool's own, which are k_candidates at most, no more than twice the final number is taken
    wanted = about.select(F.col("query").alias("id"), F.col("q").alias("vector"), F.explode(F.map_keys("route.categories")).alias("category"))
    more = knn(meta.select("id", "category", "vector"), "id", "vector", wanted, config.k_candidates + 2 * max(config.k_listing, config.k_final), by="category")
    more = ranked(more.drop("rank").join(shuffled(pool.select("query", "id")), ["query", "id"], "left_anti"), "query").join(shuffled(about.select("query", k.alias("k"))), "query")
    more = keep(more.filter(F.col("rank") <= 2 * F.col("k")).select("query", "id", "score"))
    rows = pool.unionByName(more).join(shuffled(meta), "id").join(shuffled(about), "query")
    routed = F.size("route.categories") > 0
    boost = F.coalesce(F.element_at("route.categories", F.col("category")), F.lit(1.0))  # C5
    rows = rows.withColumn("score", F.col("score") * boost).withColumn("score", F.col("score") * structured_boost(F.col("tipo"), F.col("siglas"), F.col("is_summary"), F.col("short_forms"), F.col("about_subjects")))

    # coherence of subject and type (B19, B20); null types stay
    own = chunk_subjects(F.col("tipo"), F.col("siglas"), F.col("is_summary"), F.col("title"), F.col("text"))
    rows = rows.filter((F.size("subjects") == 0) | (F.size(own) == 0) | F.arrays_overlap(own, F.col("subjects")))
    rows = rows.filter(F.col("wanted").isNull() | F.col("tipo").isNull() | ~F.col("tipo").isin("horario", "calendario") | (F.col("tipo") == F.col("wanted")))

    # listings get the summaries they are about, whatever their score
    fits = (~routed | F.map_contains_key("route.categories", F.coalesce("category", F.lit("")))) & (F.col("course").isNull() | F.col("curso").isNull() | (F.col("curso") == F.col("course")))
    listing = F.col("listing") & F.col("about_subjects")
    # joined on a routed category, or on "" where nothing is routed and every category fits
    keys = F.when(routed, F.map_keys("route.categories")).otherwise(F.array(F.lit("")))
    held = meta.filter("is_summary").withColumn("__key", F.explode(F.array_distinct(F.array(F.coalesce("category", F.lit("")), F.lit("")))))
    asking = about.filter(listing).withColumn("__key", F.explode(keys))
    if config.reranker is None and config.mmr_weight == 1:  # only the best can be chosen: as many as remain beside those that are there
        most = max(config.k_listing, config.k_final)
        of = lambda rows, id_, v, years: rows.select(F.col(id_).alias("id"), F.col(v).alias("vector"), F.explode(F.transform(years, lambda y: F.concat("__key", F.lit("|"), y))).alias("__key"))
        year = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))  # noqa: E731  years: any, own or none
        best = knn(of(held, "id", "vector", F.array(F.lit("*"), year("curso"))), "id", "vector", of(asking, "query", "q", F.when(F.col("course").isNull(), F.array(F.lit("*"))).otherwise(F.array(year("course"), F.lit("-")))), config.k_candidates + 3 * most, by="__key", digits=9)
        summaries = best.select("query", "id").join(shuffled(meta), "id").join(shuffled(about), "query")
    else:
        summaries = held.join(asking, "__key").filter(fits).drop("__key")
    summaries = summaries.join(shuffled(rows.select("query", "id")), ["query", "id"], "left_anti")
    summaries = summaries.withColumn("score", inner("vector", "q"))
    rows = rows.unionByName(summaries.select(*rows.columns))
    floor = config.threshold * (fixed.HYBRID_FACTOR if config.hybrid else 1.0)
    rows = rows.filter((F.round("score", 6) >= floor) | (listing & F.col("is_summary") & fits))

    if config.reranker is not None:  # the penalty is on the reranker's scale (V8)
        models = [seams.pairwise(config.reranker)] if callable(config.reranker) else config.reranker
        scored = rows.withColumn("ce", seams.rerank(F.col("query_text"), F.col("text"), models))
        penalty = F.when(routed & ~F.map_contains_key("route.categories", F.coalesce("category", F.lit(""))), config.penalty).otherwise(0.0)
        one = Window.partitionBy("query")  # where a pair has no score, or models on scales of their own gave them, all scores stay
        failed = F.max(F.col("ce.score").isNull()).over(one) | (F.min("ce.model").over(one) != F.max("ce.model").over(one))
        rows = scored.withColumn("score", F.when(failed, F.col("score")).otherwise(F.col("ce.score") - penalty)).drop("ce")
    chosen = mmr(rows.select("query", "id", "score", "vector"), config.k_listing, config.mmr_weight)
    chosen = chosen.join(shuffled(about.select("query", k.alias("k"))), "query").filter(F.col("rank") <= F.col("k"))
    return chosen.join(shuffled(meta), "id").select(F.col("query").alias("query_id"), "rank", F.col("id").alias("chunk_id"), F.round("score", 6).alias("score"), "source_url", "title", "position", "text", "category", "tipo")


def in_scope(queries: DataFrame, hits: DataFrame, reranked: bool = True, arbiter=None, high: float = fixed.GATE_HIGH, low: float = fixed.GATE_LOW) -> DataFrame:
    """K8: query_id, in_scope. arbiter(text) -> verdict decides the doubtful; without one, or if it fails, they are in."""
    top = hits.groupBy("query_id").agg(F.max("score").alias("top"))
    rows = queries.select("query_id", "text").join(top, "query_id", "left")
    text = F.col("text")
    routed = F.size(intent.routes(text)["categories"]) > 0
    asked = seams.generate(F.lit("scope"), text, lambda _, t: arbiter(t)) if arbiter else F.lit(None).cast("string")
    doubtful = ~F.contains(F.upper(F.coalesce(asked, F.lit("DENTRO"))), F.lit("FUERA"))
    verdict = F.when(is_meta(text) | matches(text, fixed.ANAPHORIC), True).when(F.col("top").isNull(), False)
    if reranked:
        verdict = verdict.when(F.col("top") >= high, True).when((F.col("top") <= low) & ~routed, False)
    return rows.select("query_id", verdict.otherwise(doubtful).alias("in_scope"))
