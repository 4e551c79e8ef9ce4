"""Queries of stores, audits, fetching and answers' parts: what is written is read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragframe.functions import fixed, text
from ragframe.operators import corpus, evaluate, search
from ragframe.sources import context_cache, fetch, metadata, store

from .registry import query, table

_CORPUS = "SELECT 'https://s.es/' || doc_id AS url, source AS title, lang AS category, CASE WHEN doc_id % 3 = 0 THEN 'pdf' END AS source_type, text, n_chars AS char_count FROM documents"


def _corpus(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.concat(F.lit("https://s.es/"), "doc_id").alias("url"), F.col("source").alias("title"), F.col("lang").alias("category"), F.when(F.col("doc_id") % 3 == 0, "pdf").alias("source_type"), "text", F.col("n_chars").alias("char_count"), F.lit("2024-11-26T00:00:00+00:00").alias("fetched_at"))


@query(f"SELECT url, coalesce(source_type, 'html') AS source_type, title, coalesce(category, 'general') AS category, md5(text) AS digest, '2024-11-26' AS day FROM ({_CORPUS}) WHERE text IS NOT NULL")
def corpus_jsonl(spark, sf_dir):
    """All documents as JSON lines and back, strictly, with defaults."""
    path = store.scratch(spark, "corpus")
    store.export_jsonl(_corpus(spark, sf_dir), path)
    docs = store.documents(store.read_corpus(spark, path))
    return docs.select("url", "source_type", "title", "category", F.md5(F.col("text").cast("binary")).alias("digest"), F.date_format("fetched_at", "yyyy-MM-dd").alias("day"))


@query(f"SELECT doc_id % 10 = 0 AS bad, count(*) AS n FROM documents GROUP BY 1")
def corpus_jsonl_tolerant(spark, sf_dir):
    """Every tenth line broken; the good ones are read, the bad ones reported."""
    path = store.scratch(spark, "lines")
    docs = table(spark, sf_dir, "documents")
    whole = F.to_json(F.struct(F.col("doc_id").cast("string").alias("url"), "text"))
    docs.select(F.when(F.col("doc_id") % 10 == 0, F.substring(whole, 1, 12)).otherwise(whole).alias("value")).write.text(path)
    found = store.materialised(store.read_corpus(spark, path, strict=False), "tolerant")
    return found.groupBy(F.col("_corrupt_record").isNotNull().alias("bad")).agg(F.count("*").alias("n"))


@query(f"SELECT url, coalesce(title, '') AS title, coalesce(category, '') AS category, coalesce(source_type, '') AS source_type, char_count FROM ({_CORPUS})")
def csv_summary(spark, sf_dir):
    """The six-column summary, written and read as CSV."""
    path = store.scratch(spark, "csv")
    store.export_csv(_corpus(spark, sf_dir), path)
    rows = store.read_csv(spark, path)
    return rows.select("url", *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "category", "source_type")], F.col("char_count").cast("long").alias("char_count"))


@query("SELECT count(*) AS docs, sum(len(ts)) AS tokens, sum(list_unique(ts)) AS postings FROM (SELECT regexp_extract_all(lower(text), '[a-záéíóúüñ0-9]+') AS ts FROM documents)")
def bm25_saved(spark, sf_dir):
    """The inverted index of all documents, saved and loaded."""
    path = store.scratch(spark, "bm25")
    store.save_index(search.bm25_index(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), lambda d: store.materialised(d, "postings")), path)
    index = store.load_index(spark, path)
    return index.lengths.agg(F.count("*").alias("docs"), F.sum("dl").alias("tokens")).join(F.broadcast(index.postings.agg(F.count("*").alias("postings"))), how="cross")  # one row each


@query("SELECT count(*) AS chunks, 64 AS dimension, CAST(count(*) * 256 AS BIGINT) AS vector_bytes, CAST(sum(label) AS BIGINT) AS labels FROM embeddings WHERE embedding IS NOT NULL")
def vectors_saved(spark, sf_dir):
    """A22, D22 and incremental indexing: half of the vectors saved, all appended, loaded and measured."""
    path = store.scratch(spark, "vectors")
    chunks = table(spark, sf_dir, "embeddings").filter("embedding is not null").select(F.col("vec_id").cast("string").alias("chunk_id"), "label", F.col("embedding").alias("vector"))
    store.save_vectors(chunks.filter("label % 2 = 0"), path)
    store.append_vectors(chunks, path)
    loaded = store.load_vectors(spark, path).agg(F.sum("label").cast("long").alias("labels"))
    return store.index_metrics(spark, path).join(F.broadcast(loaded), how="cross")  # one row each


@query(f"SELECT c AS category FROM (VALUES {', '.join(f'({c!r})' for c in (*fixed.EXPECTED_CATEGORIES, 'en', 'de'))}) v(c) WHERE c NOT IN (SELECT lang FROM documents WHERE lang IS NOT NULL)")
def missing_categories(spark, sf_dir):
    """D21, G4."""
    return corpus.missing_categories(table(spark, sf_dir, "documents"), (*fixed.EXPECTED_CATEGORIES, "en", "de"), "lang")


_EXPECTED = [(".pdf", "PDF"), ("/fr/", "French pages"), ("example.net", "Pages of net"), ("?page=2", "Second pages"), ("/nowhere/", "Lost")]


@query(f"WITH e AS (SELECT * FROM (VALUES {', '.join(map(str, _EXPECTED))}) v(fragment, label)), u AS (SELECT DISTINCT url FROM pages) SELECT fragment, label, count(url) AS n, count(url) = 0 AS missing FROM e LEFT JOIN u ON contains(url, fragment) GROUP BY 1, 2")
def missing_urls(spark, sf_dir):
    """C22."""
    return corpus.missing_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(_EXPECTED, "fragment string, label string"))


@query("SELECT page_id FROM pages WHERE NOT (page_id % 2 = 0 AND ends_with(regexp_replace(lower(url), '/+$', ''), '5'))")
def index_pages_dropped(spark, sf_dir):
    """B10, with another ending."""
    kind = F.when(F.col("page_id") % 2 == 0, "html").otherwise("pdf").alias("source_type")
    return corpus.without_index_pages(table(spark, sf_dir, "pages").select("page_id", "url", kind), "5").select("page_id")


@query("WITH p AS (SELECT page_id, url, 'T' || page_id AS title FROM pages), l AS (SELECT url, min('L' || page_id) AS label FROM pages WHERE page_id % 7 = 0 GROUP BY url) SELECT page_id, coalesce(label, title) AS title FROM p LEFT JOIN l USING (url)")
def url_labels(spark, sf_dir):
    """C10."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.concat(F.lit("T"), "page_id").alias("title"))
    labels = pages.filter("page_id % 7 = 0").select("url", F.concat(F.lit("L"), "page_id").alias("label"))
    return corpus.with_labels(pages, labels).select("page_id", "title")


@query("SELECT page_id, url, 'page' AS category FROM pages UNION ALL SELECT page_id, url || '#x', 'extra' FROM pages WHERE page_id % 3 = 0 AND NOT contains(url, '/fr/')")
def extra_documents(spark, sf_dir):
    """Extra urls bypass all filters but the global exclusions and keep their category."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.lit("page").alias("category"))
    extra = pages.filter("page_id % 3 = 0").select("page_id", F.concat("url", F.lit("#x")).alias("url"), F.lit("extra").alias("category"))
    return corpus.extra_documents(pages, extra, F.contains("url", F.lit("/fr/")))


def _client(url: str, timeout: float) -> tuple[int, str, bytes]:
    """A stand-in for the network, by a page's number: every 11th fails, every 13th isn't found, every 5th is plain text, every 7th a PDF."""
    n = int(url.rsplit("=", 1)[1])
    if n % 11 == 0:
        raise OSError("no route")
    if n % 13 == 0:
        return 404, "text/html", b""
    if n % 5 == 0:
        return 200, "text/plain", f"Titel {n}\nZeile\n".encode()
    if n % 7 == 0:
        return 200, "application/pdf", str(n).encode()
    return 200, "text/html", f"<html><head><title>Seite {n}</title></head><body><main><p>Absatz {n}</p></main></body></html>".encode()


_FETCHED = "SELECT page_id AS n, 'https://s.es/?id=' || page_id AS url, CASE WHEN page_id % 11 = 0 OR page_id % 13 = 0 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN page_id % 11 = 0 OR page_id % 13 = 0 THEN NULL WHEN page_id % 5 = 0 THEN 'txt' WHEN page_id % 7 = 0 THEN 'pdf' ELSE 'html' END AS source_type FROM pages"


def _fetched(spark, sf_dir):
    urls = table(spark, sf_dir, "pages").select(F.concat(F.lit("https://s.es/?id="), "page_id").alias("url"))
    return fetch.fetch(urls, _client, wait=lambda seconds: None)


@query(f"SELECT url, status, source_type, CASE WHEN status = 'ok' THEN 1 ELSE 3 END AS attempts FROM ({_FETCHED})")
def fetched(spark, sf_dir):
    """A1, A3: with a client that fails for some."""
    return _fetched(spark, sf_dir).select("url", "status", "source_type", "attempts")


@query(f"SELECT url, source_type, CASE source_type WHEN 'txt' THEN 'Titel ' || n WHEN 'pdf' THEN 'PDF ' || n WHEN 'html' THEN 'Seite ' || n END AS title, CASE WHEN source_type IS NULL THEN 'nothing fetched' END AS error FROM ({_FETCHED})")
def parsed_by_type(spark, sf_dir):
    """The registry of parsers, with one for PDF put in."""
    pdf = lambda url, content: (f"PDF {content.decode()}", "x")
    return fetch.parse(_fetched(spark, sf_dir), {"pdf": pdf}).select("url", "source_type", "title", "error")


@query(f"SELECT url, title, 'web' AS category, source_type, text FROM (SELECT url, source_type, CASE source_type WHEN 'txt' THEN 'Titel ' || n ELSE 'Seite ' || n END AS title, CASE source_type WHEN 'txt' THEN 'Titel ' || n || chr(10) || 'Zeile' ELSE 'Absatz ' || n END AS text FROM ({_FETCHED})) WHERE source_type IN ('txt', 'html') AND length(text) >= 9")
def ingested(spark, sf_dir):
    """Fetched, parsed, cleaned; what has no parser or is too short goes."""
    urls = table(spark, sf_dir, "pages").select(F.concat(F.lit("https://s.es/?id="), "page_id").alias("url"))
    return fetch.ingest(urls, _client, "web", least=9, wait=lambda seconds: None)


@query(f"WITH f AS ({_FETCHED}), m AS (SELECT status, 'c' || n % 3 AS category FROM f) SELECT 'status ' || status || ': ' || count(*) AS line FROM m GROUP BY status UNION ALL SELECT 'category ' || category || ': ' || count(*) FROM m WHERE status = 'ok' GROUP BY category")
def crawl_report(spark, sf_dir):
    """The manifest appended in two levels and read back, and the report's lines."""
    path = store.scratch(spark, "manifest")
    n = F.regexp_extract("url", "([0-9]+)$", 1).cast("long")
    rows = store.materialised(_fetched(spark, sf_dir).select("url", "status", F.concat(F.lit("c"), (n % 3).cast("string")).alias("category"), F.col("source_type").alias("type"), F.octet_length("content").alias("bytes"), (n % 2).alias("depth")), "level")
    for level in (0, 1):
        store.append_manifest(rows.filter(F.col("depth") == level), path)
    return store.report_lines(spark.read.schema("url string, status string, category string").json(path))


@query("SELECT 'kept' AS part, count(*) AS n, sum(n_chars) AS chars FROM documents WHERE NOT n_chars <= 300 UNION ALL SELECT 'removed', count(*), sum(n_chars) FROM documents WHERE n_chars <= 300")
def removal_versions(spark, sf_dir):
    """A new version of the corpus, and a backup of what went."""
    path = store.scratch(spark, "versions")
    store.remove_versioned(table(spark, sf_dir, "documents"), F.col("n_chars") <= 300, path, "v2")
    both = [spark.read.parquet(f"{path}/{name}").agg(F.lit(part).alias("part"), F.count("*").alias("n"), F.sum("n_chars").alias("chars")) for part, name in (("kept", "v2"), ("removed", "v2-removed"))]
    return both[0].unionByName(both[1])


@query("SELECT CAST(item_id AS VARCHAR) AS id, CASE WHEN item_id % 4 = 0 THEN 'no_info' ELSE 'factual' END AS type, item_id % 4 = 0 AS should_refuse, text AS user_input, substr(text, 1, 50) AS response, [text, 'b'] AS retrieved_contexts, CASE WHEN item_id % 2 = 0 THEN ['k'] ELSE [] END AS expected_keywords FROM benchmark")
def ragas_export(spark, sf_dir):
    """All questions of the benchmark as the judge's lines, written and read."""
    path = store.scratch(spark, "ragas")
    item = F.col("item_id")
    rows = table(spark, sf_dir, "benchmark").select(item.cast("string").alias("id"), F.when(item % 4 == 0, "no_info").otherwise("factual").alias("type"), (item % 4 == 0).alias("should_refuse"), F.lit(False).alias("refused"), F.col("text").alias("query"), F.substring("text", 1, 50).alias("answer"), F.array("text", F.lit("b")).alias("retrieved_contexts"), F.when(item % 2 == 0, F.array(F.lit("k"))).alias("expected_keywords"))
    store.export_ragas(rows, path)
    return store.read_ragas(spark, path).drop("refused")


@query("SELECT item_id AS id, CAST(item_id % 2 AS VARCHAR) AS type, CASE WHEN item_id % 5 <> 0 AND item_id % 3 <> 0 THEN round(item_id / 7.0::DOUBLE, 6) END AS faithfulness, CAST(NULL AS DOUBLE) AS answer_relevancy FROM benchmark")
def ragas_results(spark, sf_dir):
    """The judge's scores beside the questions; NaN and missing ones become null."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), (F.col("item_id") % 2).cast("string").alias("type"))
    score = F.when(F.col("id") % 3 == 0, F.lit(float("nan"))).otherwise(F.round(F.col("id") / 7, 6)).alias("faithfulness")
    return evaluate.ragas_results(asked, asked.filter("id % 5 <> 0").select("id", score), ["faithfulness", "answer_relevancy"])


@query("SELECT conv_id, turn, '| ' || role || ' | turn |  |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| ' || conv_id || ' | ' || turn || ' | a b |' AS md FROM conversations")
def markdown_tables(spark, sf_dir):
    """A ragged table with a blank row from each turn."""
    s = lambda c: F.col(c).cast("string")
    rows = F.array(F.array(F.lit(""), F.lit(" ")), F.array(s("role"), F.lit("turn")), F.array(s("conv_id"), s("turn"), F.lit("a\nb")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.markdown_table(rows).alias("md"))


@query("SELECT doc_id, chr(10) || '---' || chr(10) || '**Fuentes:**' || chr(10) || '- [1] ' || source || ' — [' || lang || '](' || lang || ')' || chr(10) || '- x — [y](y)' AS block FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL")
def sources_blocks(spark, sf_dir):
    """H13."""
    row = lambda m, t, u: F.struct(m.alias("marker"), t.alias("title"), u.alias("url"))
    docs = table(spark, sf_dir, "documents").filter("source is not null and lang is not null")
    return docs.select("doc_id", text.sources_block(F.array(row(F.lit(1), F.col("source"), F.col("lang")), row(F.lit(None).cast("int"), F.lit("x"), F.lit("y")))).alias("block"))


@query(r"SELECT conv_id, turn, CASE WHEN c <> '' THEN c || chr(10) || chr(10) || role ELSE role END AS text FROM (SELECT conv_id, turn, role, regexp_replace(trim(regexp_replace('«' || text || '»  ', '[\x20\x09-\x0D]+', ' ', 'g')), '^[\"''«»]+|[\"''«»]+$', '', 'g') AS c FROM conversations)".replace('\\"', '"'))
def contexts(spark, sf_dir):
    """A context sentence of one line without its quotes, before a chunk's text."""
    own = text.sanitise_context(F.concat(F.lit("«"), "text", F.lit("»  ")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.with_context(own, F.col("role")).alias("text"))


_WORDS = "list_distinct(regexp_extract_all(lower({}), '[a-záéíóúüñ0-9]+'))"


@query(f"SELECT a.doc_id, round(len(list_intersect(a.w, b.w)) / greatest(len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)), 1)::DOUBLE, 6) AS jaccard FROM (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents) a JOIN (SELECT doc_id - 1 AS doc_id, {_WORDS.format('text')} AS w FROM documents) b USING (doc_id)")
def jaccard_neighbours(spark, sf_dir):
    """The token overlap of each document and the next by id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(text.bm25_tokens(F.col("text"))).alias("w"))
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"))
    return docs.join(after, "doc_id").select("doc_id", F.round(text.jaccard(F.col("w"), F.col("v")), 6).alias("jaccard"))


@query("SELECT count(*) AS n, count(*) AS ids, 12 AS width FROM conversations")
def query_ids(spark, sf_dir):
    """Twelve hex digits for each turn; random, so that only their number and form can be compared."""
    rows = store.materialised(table(spark, sf_dir, "conversations").select(text.query_id().alias("id")), "ids")
    return rows.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.max(F.when(F.col("id").rlike("^[0-9a-f]{12}$"), F.length("id"))).alias("width"))


_EXTRAS = "'{\"event_id\": -1, \"user\": {\"id\": ' || user_id || '}, ' || substring(props, 2)"


@query("""SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, user_id AS owner, CAST(json_object('k', CAST(props->>'$.k' AS BIGINT), 'user', json_object('id', user_id)) AS VARCHAR) AS extras
 FROM events WHERE CAST(props->>'$.k' AS BIGINT) >= 50""")
def metadata_variant(spark, sf_dir):
    """The events' properties, with a nested field and one that would override a column, kept as VARIANT and filtered by path."""
    path = store.scratch(spark, "variant")
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(_EXTRAS).alias("props"))
    metadata.with_extras(rows, "props").write.parquet(path)
    kept = spark.read.parquet(path).filter(metadata.field(F.col("extras"), "$.k", "long") >= 50)
    return kept.select("event_id", metadata.field(F.col("extras"), "$.k", "long").alias("k"), metadata.field(F.col("extras"), "$.user.id", "long").alias("owner"), F.to_json("extras").alias("extras"))


@query("""WITH d AS (SELECT doc_id, text, left(sha256(text), 24) AS key FROM documents), first AS (SELECT DISTINCT key FROM d WHERE doc_id % 2 = 0 AND key IS NOT NULL)
SELECT doc_id, left(CASE WHEN text IS NULL THEN NULL ELSE CASE WHEN key IN (FROM first) THEN 'uno' ELSE 'dos' END || ' ' || length(text) || ' ' || least(length(text), 6000) || chr(10) || chr(10) || text END, 40) AS head FROM d""")
def context_cache_runs(spark, sf_dir):
    """Contexts for half the documents, then for all; a third run has a model that always fails and finds them all kept."""
    path = store.scratch(spark, "cache")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("source_url"), "text")
    whole = docs.select(F.col("doc_id").alias("url"), "text", F.lit("").alias("title"))

    def down(whole_text, text):
        raise OSError("no model")

    model = lambda name: lambda whole_text, text: f"{name} {len(text)} {len(whole_text)}"
    context_cache.contextualised(docs.filter("doc_id % 2 = 0"), whole, path, model("uno"))
    context_cache.contextualised(docs, whole, path, model("dos"))
    rows = context_cache.contextualised(docs, whole, path, down)
    return rows.select("doc_id", F.substring("text", 1, 40).alias("head"))
