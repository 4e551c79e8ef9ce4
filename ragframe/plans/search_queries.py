"""Queries of lexical and dense search, fusion, boosts and the whole retrieval cascade."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ragframe import seams
from ragframe.operators import retrieve as r
from ragframe.operators import search
from ragframe.sources import lexical_store, store

from .registry import query, table

_TOKENS = "regexp_extract_all(lower(text), '[a-záéíóúüñ0-9]+')"
_BM25 = f"""
WITH tok AS MATERIALIZED (SELECT doc_id AS id, {_TOKENS} AS ts FROM documents),
dl AS (SELECT id, len(ts) AS dl FROM tok), tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
tf AS MATERIALIZED (SELECT term, id, count(*) AS tf FROM (SELECT id, unnest(ts) AS term FROM tok) GROUP BY 1, 2),
raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM tf, tot GROUP BY term),
terms AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)
"""


def _index(spark, sf_dir):
    return search.bm25_index(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), lambda d: store.materialised(d, "postings"))


@query(f"{_BM25} SELECT term, df, round(idf, 6) AS idf FROM terms")
def bm25_term_stats(spark, sf_dir):
    """D1."""
    index = _index(spark, sf_dir)
    return index.terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"""{_BM25},
q AS (SELECT query, term, count(*) AS times FROM (SELECT item_id AS query, unnest({_TOKENS}) AS term FROM benchmark) GROUP BY 1, 2),
s AS (SELECT query, id, round(sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
      FROM tf JOIN q USING (term) JOIN terms USING (term) JOIN dl USING (id), tot GROUP BY 1, 2)
SELECT * FROM (SELECT query, id, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS rank FROM s WHERE score > 0) WHERE rank <= 10
""")
def bm25_topk(spark, sf_dir):
    """The ten best documents for each benchmark text."""
    return search.bm25_search(_index(spark, sf_dir), table(spark, sf_dir, "benchmark"), "item_id", F.col("text"), 10)


def _grown(spark, sf_dir):
    """An index of all documents, appended in three batches, one of them twice, and one with texts that are there already."""
    docs, path = table(spark, sf_dir, "documents"), store.scratch(spark, "lexical")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    for batch, rows in (("b0", docs.filter(part == 0)), ("b1", docs.filter(part == 1)), ("b1", docs.filter(part == 1)), ("b2", docs.filter(part > 0))):
        lexical_store.append(rows, "doc_id", F.col("text"), path, batch)
    return path


@query(f"{_BM25} SELECT term, df, round(idf, 6) AS idf FROM terms")
def bm25_grown_stats(spark, sf_dir):
    """D1, incremental index: statistics added up over batches."""
    return lexical_store.load(spark, _grown(spark, sf_dir)).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"""{_BM25},
q AS (SELECT query, term, count(*) AS times FROM (SELECT item_id AS query, unnest({_TOKENS}) AS term FROM benchmark) GROUP BY 1, 2),
s AS (SELECT query, id, round(sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
      FROM tf JOIN q USING (term) JOIN terms USING (term) JOIN dl USING (id), tot GROUP BY 1, 2)
SELECT * FROM (SELECT query, id, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS rank FROM s WHERE score > 0) WHERE rank <= 10
""")
def bm25_grown_topk(spark, sf_dir):
    """A search of the batches that reads the buckets of its terms only."""
    return lexical_store.search(_grown(spark, sf_dir), table(spark, sf_dir, "benchmark"), "item_id", F.col("text"), 10)


_V = "WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 100 = 0)"
_KNN = f"""{_V},
s AS (SELECT q.vec_id AS query, v.vec_id AS id, round(list_dot_product(q.e, v.e), 6) AS score FROM q JOIN v ON q.vec_id <> v.vec_id),
dense AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS rank FROM s)
"""


def _vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return rows, rows.filter(F.col("vec_id") % 100 == 0)


def _dense(spark, sf_dir, k):
    rows, asked = _vectors(spark, sf_dir)
    return search.knn(rows, "vec_id", "embedding", asked, k, exclude_self=True)


@query(f"{_KNN} SELECT query, id, score, rank FROM dense WHERE rank <= 10")
def knn_exact(spark, sf_dir):
    """The stated query set (ids divisible by 100) against all vectors."""
    return _dense(spark, sf_dir, 10)


@query(f"{_KNN} SELECT query, id, score FROM dense WHERE rank <= 50 AND score >= 0.35 * 0.7")
def knn_threshold(spark, sf_dir):
    """B18."""
    return _dense(spark, sf_dir, 50).filter(F.col("score") >= 0.35 * 0.7).select("query", "id", "score")


@query("""
SELECT vec_id, round(sqrt(list_sum([CAST(x AS DOUBLE) * x FOR x IN embedding])), 6) AS norm,
 array_to_string([CAST(CAST(floor(x / sqrt(list_sum([CAST(y AS DOUBLE) * y FOR y IN embedding])) * 10000) AS INTEGER) AS VARCHAR) FOR x IN embedding], ' ') AS unit FROM embeddings
""")
def vector_norms(spark, sf_dir):
    """All components of the unit vector, in ten-thousandths."""
    v = F.col("embedding")
    parts = F.transform(search.unit(v), lambda x: F.floor(x * 10000).cast("int").cast("string"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(search.inner(v, v)), 6).alias("norm"), F.array_join(parts, " ").alias("unit"))


@query("SELECT label, CAST(i AS INTEGER) AS component, count(*) AS n, round(avg(x), 6) AS mean FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY ALL")
def centroids(spark, sf_dir):
    """Means of a label's vectors: all components."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("component", "x"))
    return rows.groupBy("label", "component").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("mean"))


#: A second ranking of the same candidates, by label and id, for fusion.
_FUSE = f"""{_KNN},
d AS (SELECT query, id, rank FROM dense WHERE rank <= 50),
l AS (SELECT query, id, CAST(row_number() OVER (PARTITION BY query ORDER BY (id * 7919) % 1009, id) AS INTEGER) AS rank FROM dense WHERE rank <= 80)
"""


def _rankings(spark, sf_dir):
    dense = _dense(spark, sf_dir, 80)
    order = Window.partitionBy("query").orderBy((F.col("id") * 7919) % 1009, "id")
    return dense.filter("rank <= 50").select("query", "id", "rank"), dense.select("query", "id", F.row_number().over(order).alias("rank"))


@query(f"""{_FUSE}, f AS (SELECT query, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT * FROM d UNION ALL SELECT * FROM l) GROUP BY 1, 2)
SELECT query, id, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS rank FROM f
""")
def rrf_fuse(spark, sf_dir):
    """K5, C2, D2, E8, F3."""
    a, b = _rankings(spark, sf_dir)
    return search.rrf(a.unionByName(b))


@query(f"""{_FUSE}
SELECT coalesce(d.query, l.query) AS query, coalesce(d.id, l.id) AS id, round(coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + l.rank), 0), 9) AS score FROM d FULL JOIN l ON d.query = l.query AND d.id = l.id
""")
def rrf_full_outer(spark, sf_dir):
    """C2 as the join that it stands for."""
    a, b = _rankings(spark, sf_dir)
    part = lambda c: F.coalesce(1.0 / (60 + F.col(c)), F.lit(0.0))
    both = a.withColumnRenamed("rank", "ra").join(b.withColumnRenamed("rank", "rb"), ["query", "id"], "full")
    return both.select("query", "id", F.round(part("ra") + part("rb"), 9).alias("score"))


def _rounds(k: int) -> str:
    """K7 unrolled: each round takes the best of weight * score - (1 - weight) * nearness to what is chosen."""
    out = [f"{_KNN}, p AS MATERIALIZED (SELECT query, id, score FROM dense WHERE rank <= 20)", "r0 AS (SELECT query, id, score, 0.0::DOUBLE AS near FROM p)"]
    for i in range(1, k + 1):
        out.append(f"c{i} AS (SELECT query, id, score, {i} AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(0.7::DOUBLE * score - (1 - 0.7::DOUBLE) * near, 9) DESC, score DESC, id) AS k FROM r{i - 1}) WHERE k = 1)")
        near = "list_dot_product(a.e, b.e)" if i == 1 else "greatest(r.near, list_dot_product(a.e, b.e))"
        out.append(f"r{i} AS MATERIALIZED (SELECT r.query, r.id, r.score, {near} AS near FROM r{i - 1} r JOIN c{i} c ON r.query = c.query AND r.id <> c.id JOIN v a ON a.vec_id = r.id JOIN v b ON b.vec_id = c.id)")
    return ",\n".join(out) + "\n" + " UNION ALL ".join(f"SELECT query, id, score, CAST(rank AS INTEGER) AS rank FROM c{i}" for i in range(1, k + 1))


def _mmr(spark, sf_dir, weight):
    rows, _ = _vectors(spark, sf_dir)
    found = _dense(spark, sf_dir, 20).join(rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), "id")
    return search.mmr(found, 5, weight)


@query(_rounds(5))
def mmr_select(spark, sf_dir):
    """Five of the twenty nearest."""
    return _mmr(spark, sf_dir, 0.7)


@query(f"{_KNN} SELECT query, id, score, rank FROM dense WHERE rank <= 5")
def mmr_lambda1_is_topk(spark, sf_dir):
    return _mmr(spark, sf_dir, 1.0)


_ROUTED = f"{_KNN}, b AS (SELECT * FROM (VALUES (1, 2.5::DOUBLE), (3, 1.5::DOUBLE), (7, 1.2::DOUBLE)) x(label, boost))"


def _boosts(spark):
    return spark.createDataFrame([(1, 2.5), (3, 1.5), (7, 1.2)], "label int, boost double")


@query(f"{_ROUTED}, s2 AS (SELECT query, id, round(score * coalesce(boost, 1), 9) AS score FROM dense JOIN embeddings e ON e.vec_id = id LEFT JOIN b ON b.label = e.label WHERE rank <= 30) SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS rank FROM s2")
def category_boost(spark, sf_dir):
    """Labels are the categories."""
    rows, _ = _vectors(spark, sf_dir)
    labels = rows.select(F.col("vec_id").alias("id"), "label")
    boosted = _dense(spark, sf_dir, 30).drop("rank").join(labels, "id").join(F.broadcast(_boosts(spark)), "label", "left")
    return search.ranked(boosted.select("query", "id", F.round(F.col("score") * F.coalesce("boost", F.lit(1.0)), 9).alias("score")), "query")


@query(f"{_ROUTED}, s2 AS (SELECT d.query, d.id, d.score FROM dense d JOIN embeddings e ON e.vec_id = d.id JOIN b ON b.label = e.label WHERE d.rank > 30) SELECT query, id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS rank FROM s2) WHERE rank <= 10")
def category_inject(spark, sf_dir):
    """The ten best of the routed labels that the pool lacks."""
    rows, asked = _vectors(spark, sf_dir)
    routed = rows.join(F.broadcast(_boosts(spark)), "label", "left_semi")
    pool = _dense(spark, sf_dir, 30).select("query", "id")
    more = search.knn(routed, "vec_id", "embedding", asked, 40, exclude_self=True).join(pool, ["query", "id"], "left_anti").select("query", "id", "score")
    return search.ranked(more, "query", 10)


@query(f"{_ROUTED} SELECT query, id, round(score - CASE WHEN b.label IS NULL THEN 1.5 ELSE 0 END, 6) AS score FROM dense JOIN embeddings e ON e.vec_id = id LEFT JOIN b ON b.label = e.label WHERE rank <= 30")
def off_category_penalty(spark, sf_dir):
    """H36."""
    rows, _ = _vectors(spark, sf_dir)
    labels = rows.select(F.col("vec_id").alias("id"), "label")
    all_ = _dense(spark, sf_dir, 30).join(labels, "id").join(F.broadcast(_boosts(spark)), "label", "left")
    return all_.select("query", "id", F.round(F.col("score") - F.when(F.col("boost").isNull(), 1.5).otherwise(0.0), 6).alias("score"))


@query(f"{_KNN} SELECT query, max(score) AS top, max(score) >= 0.4 AS in_scope FROM dense WHERE rank <= 10 GROUP BY query")
def scope_gate_max(spark, sf_dir):
    """D19, K8's test on the best score."""
    return _dense(spark, sf_dir, 10).groupBy("query").agg(F.max("score").alias("top"), (F.max("score") >= 0.4).alias("in_scope"))


def retrieval_cascade(spark, sf_dir):
    """K6 whole: benchmark texts as queries over all documents, with the stand-in models of seams."""
    chunks = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), "text", F.lit("").alias("title"), F.concat(F.lit("https://x.es/"), "doc_id").alias("source_url"), F.lit(0).alias("position"), F.col("source").alias("category"),
        F.lit(None).cast("string").alias("tipo"), F.expr("cast(null as array<string>)").alias("siglas"), F.lit(False).alias("is_summary"), F.lit(None).cast("int").alias("curso"), seams.embed(F.col("text")).alias("vector"),
    )
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text", seams.embed(F.col("text"), passage=False).alias("vector"))
    return r.retrieve(asked, chunks, r.Config(keep=store.materialised)).select("query_id", "rank", "chunk_id", "score")


query(None)(retrieval_cascade)


_SET = "list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[\\pL\\pN_]+'))"


@query(f"""WITH p AS (SELECT u.conv_id, u.turn, u.text AS q, a.text AS t FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')
SELECT conv_id, turn, CASE WHEN length(coalesce(t, '')) > 300 THEN 'small' ELSE 'large' END AS model, CASE WHEN length(coalesce(t, '')) > 300 THEN 'absent: no weights; large: too long; ' ELSE 'absent: no weights; ' END AS error,
 round(8 * len(list_intersect({_SET.format('q')}, {_SET.format('t')}))::DOUBLE / greatest(1, len({_SET.format('q')})) - 4, 6) AS score FROM p""")
def rerank_fallback(spark, sf_dir):
    """F7, the reranker's seam: every question with its answer, by a model that doesn't load, one that fails on long texts, and a last one."""
    turns = table(spark, sf_dir, "conversations")
    answers = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    pairs = turns.filter("role = 'user'").select("conv_id", "turn", "text").join(answers, ["conv_id", "turn"])

    def absent():
        raise OSError("no weights")

    def large():
        def score(pairs):
            if any(len(t) > 300 for _, t in pairs):
                raise ValueError("too long")
            return [seams.lexical_score(q, t) for q, t in pairs]

        return score

    small = lambda: lambda pairs: [seams.lexical_score(q, t) for q, t in pairs]
    models = [seams.Reranker("absent", absent), seams.Reranker("large", large), seams.Reranker("small", small)]
    return pairs.select("conv_id", "turn", seams.rerank(F.col("text"), F.col("answer"), models).alias("r")).select("conv_id", "turn", "r.*")


#: Questions for typed chunks, and what the rules say about each: listing, about subjects, wanted type, subjects, year, boosts.
TYPED_QUESTIONS = (
    ("¿Qué asignaturas hay en tercer curso?", True, True, None, (), 3, {"plan_estudios": 2.5, "presentacion_grado": 1.5, "horarios": 1.3}),
    ("¿Cuándo es el examen de IA?", False, False, "calendario", ("IA",), None, {"calendario": 2.0, "tramites": 1.2}),
    ("clases de DI", False, False, "horario", ("DI",), None, {"horarios": 2.5, "calendario": 1.2}),
    ("hola", False, False, None, (), None, {}),
    ("¿Qué asignaturas hay?", True, True, None, (), None, {}),
    ("¿Qué asignaturas de DI hay en horario de clase?", True, True, "horario", ("DI",), None, {"horarios": 2.5, "calendario": 1.2}),
)
_TYPED_CHUNKS = {
    "category": "CASE vec_id % 4 WHEN 0 THEN 'horarios' WHEN 1 THEN 'calendario' WHEN 2 THEN 'plan_estudios' ELSE 'otra' END",
    "tipo": "CASE WHEN vec_id % 7 = 0 THEN 'plan_estudios' WHEN vec_id % 3 = 0 THEN 'horario' WHEN vec_id % 3 = 1 THEN 'calendario' END",
    "siglas": "CASE vec_id % 5 WHEN 0 THEN {0}'IA'{1} WHEN 1 THEN {0}'DI'{1} WHEN 2 THEN {0}'IA', 'DI'{1} END",
    "is_summary": "vec_id % 13 = 0",
    "curso": "CASE WHEN vec_id % 6 < 4 THEN CAST(vec_id % 6 + 1 AS INTEGER) END",
    "title": "CASE WHEN vec_id % 8 = 3 THEN 'Apuntes de DI' ELSE '' END",
}


def typed_sql(off: str = "") -> str:
    """The SQL of retrieval_typed; off: routes, structured, subjects, types or summaries, to leave a step out."""
    one = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    facts = ", ".join(f"({j}, {listing}, {about}, {one(wanted)}, {list(subjects)}::VARCHAR[], {one(year)}, {list(boosts)}::VARCHAR[], {list(boosts.values())}::DOUBLE[])" for j, (_, listing, about, wanted, subjects, year, boosts) in enumerate(TYPED_QUESTIONS))
    columns = ", ".join(f"{sql.format('[', ']')} AS {name}" for name, sql in _TYPED_CHUNKS.items())
    boost = "1.0::DOUBLE" if off == "routes" else "coalesce(boosts[list_position(routed, category)], 1.0::DOUBLE)"
    structured = "1.0::DOUBLE" if off == "structured" else "CASE WHEN tipo = 'horario' THEN (CASE WHEN list_has_any(siglas, subjects) THEN 1.6::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN is_summary AND about THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END) ELSE 1.0::DOUBLE END"
    subjects = "true" if off == "subjects" else "(len(subjects) = 0 OR len(own) = 0 OR list_has_any(own, subjects))"
    types = "true" if off == "types" else "(wanted IS NULL OR tipo IS NULL OR tipo NOT IN ('horario', 'calendario') OR tipo = wanted)"
    listed = "false" if off == "summaries" else "listing AND about AND is_summary AND (len(routed) = 0 OR list_contains(routed, category)) AND (year IS NULL OR curso IS NULL OR curso = year)"
    return f"""
WITH facts(j, listing, about, wanted, subjects, year, routed, boosts) AS (VALUES {facts}),
chunks AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, {columns} FROM embeddings WHERE embedding IS NOT NULL),
c AS (SELECT *, CASE WHEN is_summary OR coalesce(tipo = 'plan_estudios', false) THEN []::VARCHAR[] WHEN siglas IS NOT NULL THEN siglas WHEN title <> '' THEN ['DI'] ELSE []::VARCHAR[] END AS own FROM chunks),
p AS MATERIALIZED (SELECT q.id * 10 + j AS query, CASE WHEN listing THEN 10 ELSE 5 END AS k, facts.*, c.*, list_dot_product(c.v, q.v) AS exact, round(list_dot_product(c.v, q.v), 6) AS dense
  FROM (SELECT id, v FROM chunks WHERE id % 100 = 0) q, facts, c),
pool AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY dense DESC, id) <= 50 AS near FROM p),
more AS (SELECT *, near OR (list_contains(routed, category) AND row_number() OVER (PARTITION BY query, near, list_contains(routed, category) ORDER BY dense DESC, id) <= 2 * k) AS taken FROM pool),
coherent AS (SELECT *, taken AND {subjects} AND {types} AS held, {listed} AS listed FROM more),
scored AS (SELECT query, k, id, listed, CASE WHEN held THEN dense * {boost} * ({structured}) ELSE exact END AS score FROM coherent WHERE held OR listed)
SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id FROM (SELECT query AS query_id, k, id AS chunk_id, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, score DESC, id) AS rank
  FROM scored WHERE listed OR round(score, 6) >= 0.35) WHERE rank <= k"""


@query(typed_sql())
def retrieval_typed(spark, sf_dir):
    """The cascade over typed chunks, with dense candidates, no reranker and no diversity, which SQL can't express."""
    rows = table(spark, sf_dir, "embeddings").filter("embedding is not null")
    types = [F.expr(sql.format("array(", ")")).alias(name) for name, sql in _TYPED_CHUNKS.items()]
    text = F.concat(F.lit("registro "), F.col("vec_id"))
    chunks = rows.select(F.col("vec_id").alias("chunk_id"), text.alias("text"), text.alias("source_url"), F.lit(0).alias("position"), *types, F.col("embedding").alias("vector"))
    asked = F.posexplode(F.array(*[F.lit(q) for q, *_ in TYPED_QUESTIONS])).alias("j", "text")
    queries = rows.filter("vec_id % 100 = 0").select("vec_id", F.col("embedding").alias("vector"), asked).select((F.col("vec_id") * 10 + F.col("j")).alias("query_id"), "text", "vector")
    return r.retrieve(queries, chunks, r.Config(hybrid=False, reranker=None, mmr_weight=1.0, keep=store.materialised)).select("query_id", "rank", "chunk_id")
