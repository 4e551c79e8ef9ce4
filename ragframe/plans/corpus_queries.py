"""Queries of cleaning, filtering, deduplication, curation and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragframe.functions import fixed
from ragframe.functions import text as t
from ragframe.operators import chunks, corpus
from ragframe.sources import store

from .registry import ORACLE, query, table

#: White space of Java's and Python's Unicode classes, for RE2.
_WS = r"[\t\n\x0B\f\r\x1C-\x1F \x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


_LINES = "string_split(text, chr(10))"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, CAST(greatest(1, length(text) // 4) AS INTEGER) AS n_tokens FROM documents")
def doc_lengths(spark, sf_dir):
    """H7."""
    return _docs(spark, sf_dir).select("doc_id", F.length("text").cast("long").alias("n_chars"), t.token_length(F.col("text")).alias("n_tokens"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS content_hash, substr(sha256(text), 1, 24) AS cache_key FROM documents")
def content_hash(spark, sf_dir):
    """H37."""
    return _docs(spark, sf_dir).select("doc_id", t.content_hash(F.col("text")).alias("content_hash"), t.content_hash(F.col("text"), 24).alias("cache_key"))


@query("SELECT min(doc_id) AS doc_id, substr(sha256(text), 1, 16) AS content_hash FROM documents GROUP BY 2")
def dedup_exact_keep_first(spark, sf_dir):
    """C11 with V1's default."""
    return corpus.keep_first(_docs(spark, sf_dir), "doc_id").select("doc_id", "content_hash")


@query("""
WITH d AS (SELECT page_id, url, row_number() OVER (PARTITION BY substr(sha256(html), 1, 16) ORDER BY length(url), page_id) AS k FROM pages)
SELECT page_id, url FROM d WHERE k = 1
""")
def dedup_keep_shortest_url(spark, sf_dir):
    """C11 with the configuration's wording (V1)."""
    return corpus.keep_first(table(spark, sf_dir, "pages"), "page_id", text="html", keep="shortest_url").select("page_id", "url")


@query("SELECT substr(sha256(text), 1, 16) AS content_hash, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_groups(spark, sf_dir):
    """D9."""
    return corpus.duplicate_groups(_docs(spark, sf_dir))


_KEYS = f"[{_strip('x')} FOR x IN {_LINES}]"
_REPEAT = "(i > 1 AND k[i] = k[i - 1] AND k[i] <> '')"


@query(f"""
WITH d AS (SELECT doc_id, {_LINES} AS l, {_KEYS} AS k FROM documents)
SELECT doc_id, array_to_string([l[i] FOR i IN range(1, len(l) + 1) IF NOT ({_REPEAT} AND NOT starts_with(k[i], '|'))], chr(10)) AS text FROM d
""")
def collapse_repeated_lines(spark, sf_dir):
    """E2, the cleaner's version."""
    return _docs(spark, sf_dir).select("doc_id", t.collapse_repeats(F.col("text")).alias("text"))


@query(f"""
WITH d AS (SELECT doc_id, [regexp_replace(x, '{_WS}+$', '') FOR x IN {_LINES}] AS l, {_KEYS} AS k FROM documents)
SELECT doc_id, array_to_string([l[i] FOR i IN range(1, len(l) + 1) IF NOT {_REPEAT}], chr(10)) AS text FROM d
""")
def collapse_repeated_lines_parser(spark, sf_dir):
    """E1, the parser's version."""
    return _docs(spark, sf_dir).select("doc_id", t.collapse_repeats(F.col("text"), keep_tables=False).alias("text"))


@query(f"""
WITH d AS (SELECT {_KEYS} AS k FROM documents)
SELECT CAST(sum(len(k)) AS BIGINT) AS lines, CAST(sum(len([i FOR i IN range(1, len(k) + 1) IF {_REPEAT}])) AS BIGINT) AS repeats,
       sum(len([i FOR i IN range(1, len(k) + 1) IF {_REPEAT}])) / greatest(sum(len(k)), 1) AS share FROM d
""")
def dup_line_ratio(spark, sf_dir):
    """D18."""
    return corpus.line_repeats(_docs(spark, sf_dir))


_BOILER = r"(?i)Aceptar cookies?|Pol[ií]tica de privacidad|© Universidad de Granada|Aviso legal|Mapa del sitio|Breadcrumb|Ir al contenido principal"


@query(f"""
SELECT doc_id, array_to_string([x FOR x IN string_split(text || chr(10) || 'AVISO LEGAL y más' || chr(10) || 'Inicio > x', chr(10)) IF NOT (regexp_matches(x, '{_BOILER}') OR regexp_matches(x, '^Inicio\\s*>'))], chr(10)) AS text FROM documents
""")
def boilerplate_lines(spark, sf_dir):
    """B28; two such lines are put after each text."""
    whole = F.concat("text", F.lit("\nAVISO LEGAL y más\nInicio > x"))
    return _docs(spark, sf_dir).select("doc_id", t.without_boilerplate(whole).alias("text"))


_MESSY = "nfc_normalize(chr(9) || replace(text, ' ', '   ') || repeat(chr(10), 4))"
_SQUEEZED = _strip(f"regexp_replace(regexp_replace({_MESSY}, '{_WS.replace(chr(92) + 'n', '')}+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


@query(f"SELECT doc_id, {_SQUEEZED} AS text FROM documents")
def normalise_text(spark, sf_dir):
    """H1, H2, on texts with non-breaking spaces and blank lines put in."""
    messy = F.concat(F.lit("\t"), F.replace("text", F.lit(" "), F.lit("   ")), F.lit("\n\n\n\n"))
    return _docs(spark, sf_dir).select("doc_id", t.collapse_spaces(t.normalised(messy)).alias("text"))


@query("SELECT doc_id, strip_accents(lower(text)) AS text FROM documents")
def strip_accents(spark, sf_dir):
    """H3."""
    return _docs(spark, sf_dir).select("doc_id", t.strip_accents(F.lower("text")).alias("text"))


@query(f"""
WITH n AS (SELECT doc_id, nfc_normalize(text) AS text FROM documents),
b AS (SELECT doc_id, array_to_string([x FOR x IN {_LINES} IF NOT (regexp_matches(x, '{_BOILER}') OR regexp_matches(x, '^Inicio\\s*>'))], chr(10)) AS text FROM n),
d AS (SELECT doc_id, {_LINES} AS l, {_KEYS} AS k FROM b),
c AS (SELECT doc_id, array_to_string([l[i] FOR i IN range(1, len(l) + 1) IF NOT ({_REPEAT} AND NOT starts_with(k[i], '|'))], chr(10)) AS text FROM d),
s AS (SELECT doc_id, {_strip(f"regexp_replace(regexp_replace(text, '{_WS.replace(chr(92) + 'n', '')}+', ' ', 'g'), '{chr(92)}n{{3,}}', chr(10) || chr(10), 'g')")} AS text FROM c)
SELECT doc_id, text FROM s WHERE length(text) >= 80
""")
def clean_documents(spark, sf_dir):
    """The cleaning chain, documents of 80 characters at least."""
    return t.cleaned(_docs(spark, sf_dir).select("doc_id", "text")).filter(F.length("text") >= 80)


_INDEX = "(st = 'html' AND (n < 600 OR (n < 1500 AND (len(ls) = 0 OR (len(ls) > 3 AND len([x FOR x IN ls IF length(x) < 60]) / greatest(len(ls), 1) > 0.7)))))"
_FORM = r"len(regexp_extract_all(substr(text, 1, 500), '(?im)D\.N\.I\.|Apellido\s*1|Firma\s+del|Firma$|Impreso\s+de\s+solicitud|Modelo\s+de\s+solicitud')) >= 2"
_D = f"WITH d AS (SELECT doc_id, text, length(text) AS n, CASE WHEN doc_id % 7 = 0 THEN 'pdf' ELSE 'html' END AS st, list_filter({_KEYS}, lambda x: x <> '') AS ls FROM documents)"


def _typed(spark, sf_dir):
    return _docs(spark, sf_dir).withColumn("source_type", F.when(F.col("doc_id") % 7 == 0, "pdf").otherwise("html"))


@query(f"{_D} SELECT doc_id, {_INDEX} AS is_index, {_FORM} AS is_form FROM d")
def index_page_flag(spark, sf_dir):
    """B8, B9."""
    return _typed(spark, sf_dir).select("doc_id", corpus.is_index_page(F.col("text"), F.col("source_type")).alias("is_index"), corpus.is_form(F.col("text")).alias("is_form"))


@query(f"{_D} SELECT coalesce(CASE WHEN n < 80 THEN 'empty' WHEN n < 200 THEN 'short' WHEN {_FORM} THEN 'form' WHEN {_INDEX} THEN 'index' END, 'kept') AS reason, count(*) AS n FROM d GROUP BY 1")
def reject_reason_counts(spark, sf_dir):
    """D12, B6, B7."""
    reason = F.coalesce(corpus.reject_reason(F.col("text"), F.col("source_type")), F.lit("kept"))
    return _typed(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(ORACLE["reject_reason_counts"])
def cleaning_metrics(spark, sf_dir):
    """The same counts, observed while the kept documents are written, in one scan of the table."""
    docs = _typed(spark, sf_dir)
    reason = F.coalesce(corpus.reject_reason(F.col("text"), F.col("source_type")), F.lit("kept"))
    reasons = ("empty", "short", "form", "index", "kept")
    seen = store.observed_write(docs.withColumn("__reason", reason), F.col("__reason") == "kept", store.scratch(spark, "cleaned"), {r: F.col("__reason") == r for r in reasons})
    return spark.createDataFrame([(r, seen[r]) for r in reasons if seen[r]], "reason string, n long")


@query("SELECT source, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(length(text)) // greatest(count(*), 1) AS BIGINT) AS mean_chars, CAST(grouping(source) AS INTEGER) AS is_total FROM documents GROUP BY ROLLUP (source)")
def corpus_rollup(spark, sf_dir):
    """D5, D6 in one pass."""
    return corpus.summary(_docs(spark, sf_dir), "source", F.length("text"))


@query("SELECT lang, count(*) AS n, avg(length(text)) AS mean_chars, CAST(min(length(text)) AS INTEGER) AS least, CAST(max(length(text)) AS INTEGER) AS most FROM documents GROUP BY lang")
def corpus_by_lang(spark, sf_dir):
    """D7, D8."""
    n = F.length("text")
    return _docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.avg(n).alias("mean_chars"), F.min(n).alias("least"), F.max(n).alias("most"))


@query("SELECT doc_id, CAST(length(text) AS INTEGER) AS size FROM documents ORDER BY length(text) DESC, doc_id LIMIT 5")
def longest5(spark, sf_dir):
    """F8."""
    return corpus.extremes(_docs(spark, sf_dir), F.length("text"), "doc_id").select("doc_id", "size")


@query("SELECT doc_id, CAST(length(text) AS INTEGER) AS size FROM documents ORDER BY length(text), doc_id LIMIT 5")
def shortest5(spark, sf_dir):
    return corpus.extremes(_docs(spark, sf_dir), F.length("text"), "doc_id", longest=False).select("doc_id", "size")


@query("SELECT doc_id FROM documents WHERE contains(lower(source), lower('SRC1')) OR contains(lower(text), lower('tHe oF'))")
def search_contains(spark, sf_dir):
    """B14."""
    return _docs(spark, sf_dir).filter(corpus.contains_query("SRC1", F.col("source")) | corpus.contains_query("tHe oF", F.col("text"))).select("doc_id")


@query("SELECT page_id FROM pages WHERE length(html) <= 1200 OR contains(lower(url), 'utm_source')")
def remove_preview(spark, sf_dir):
    """B15, A27 as a dry run."""
    doomed = corpus.removal(F.col("url"), F.col("html"), max_chars=1200, query="utm_source")
    return corpus.remove(table(spark, sf_dir, "pages").withColumn("text", F.col("html")), doomed, dry_run=True).select("page_id")


@query("""
WITH new AS (SELECT item_id * 3 AS doc_id, text FROM benchmark)
SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM new) UNION ALL SELECT doc_id, text FROM new
""")
def upsert_by_key(spark, sf_dir):
    """A25."""
    new = table(spark, sf_dir, "benchmark").select((F.col("item_id") * 3).alias("doc_id"), "text")
    return corpus.upsert(_docs(spark, sf_dir).select("doc_id", "text"), new, "doc_id")


@query("""
WITH new AS (SELECT item_id * 50 AS doc_id, text FROM benchmark)
SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, text FROM new WHERE doc_id NOT IN (SELECT doc_id FROM documents)
""")
def antijoin_append(spark, sf_dir):
    """A26, A7, G1, G2."""
    new = table(spark, sf_dir, "benchmark").select((F.col("item_id") * 50).alias("doc_id"), "text")
    return corpus.append_absent(_docs(spark, sf_dir).select("doc_id", "text"), new, "doc_id")


@query(r"SELECT doc_id, length(text) < 100 AS tiny, trim(source) = '' AS untitled, regexp_matches(source, '(?i)blanco') AS suspicious FROM documents")
def quality_flags(spark, sf_dir):
    """B23."""
    return _docs(spark, sf_dir).select("doc_id", corpus.quality_flags(F.col("source"), F.col("text")).alias("f")).select("doc_id", "f.*")


@query("SELECT row_number() OVER (ORDER BY doc_id) AS row_no, doc_id, lang, substr(replace(text, chr(10), ' '), 1, 200) AS preview FROM documents")
def review_rows(spark, sf_dir):
    """A18, H15."""
    return store.review_rows(_docs(spark, sf_dir), "doc_id", F.col("text"), "lang").withColumn("row_no", F.col("row_no").cast("long"))


_PATHS = ("/a/Horarios%20GII.pdf", "/Plan-Estudios", "/presentacion/secretaria", "/presentacion/", "/y", "/CalendarioExamenes%2024-25.pdf", "/CalendarioExamenes_25-26.pdf", "/una_hoja.v2.pdf")
_TITLES = ("x", "", "Presentación del Grado", "Protección de datos", "Plan de Estudios 2025")
_NOISE = " OR ".join(f"contains(lower(coalesce({c}, '')), '{k}')" for c in ("title", "url", "left(html, 300)") for k in fixed.NOISE_KEYWORDS)


@query(rf"""
WITH v AS (SELECT page_id, html, 'https://' || CASE page_id % 3 WHEN 0 THEN 'etsiit.x.es' ELSE 'x.es' END || '/p' || page_id || {list(_PATHS)}[page_id % 8 + 1] AS url, CASE WHEN page_id % 7 < 5 THEN {list(_TITLES)}[page_id % 7 + 1] END AS title, 'c' || page_id % 2 AS category FROM pages)
SELECT page_id, CASE WHEN contains(lower(url), 'horario') OR contains(lower(coalesce(title, '')), 'horario') THEN 'horarios'
  WHEN contains(lower(url), 'plan-estudios') OR contains(lower(coalesce(title, '')), 'plan de estudios') THEN 'plan_estudios'
  WHEN contains(lower(url), '/secretaria') AND contains(lower(url), 'etsiit') THEN 'tramites'
  WHEN regexp_matches(lower(url), '/presentacion/?$') OR contains(lower(coalesce(title, '')), 'presentación del grado') THEN 'presentacion_grado' ELSE category END AS category,
  contains(url, 'CalendarioExamenes') AND NOT contains(url, '25-26') AS old_exam, {_NOISE} AS noise,
  CASE WHEN length(title) > 1 THEN title ELSE replace(regexp_replace(regexp_extract(replace(url, '%20', ' '), '([^/]*)/*$', 1), '(.)\.[^.]*$', '\1'), '_', ' ') END AS title
FROM v""")
def refine_category(spark, sf_dir):
    """Every page, under names by rule."""
    i = F.col("page_id")
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    address = F.concat(F.lit("https://"), F.when(i % 3 == 0, "etsiit.x.es").otherwise("x.es"), F.lit("/p"), i, pick(_PATHS, i % 8))
    rows = table(spark, sf_dir, "pages").select("page_id", "html", address.alias("url"), F.when(i % 7 < 5, pick(_TITLES, i % 7)).alias("title"), F.concat(F.lit("c"), i % 2).alias("category"))
    url, name = F.col("url"), F.col("title")
    return rows.select("page_id", corpus.refine_category(url, name, F.col("category")).alias("category"), corpus.old_exam(url).alias("old_exam"), corpus.is_noise(name, url, F.col("html")).alias("noise"), corpus.title(F.lit(None).cast("string"), name, url).alias("title"))


@query("SELECT doc_id, CAST(i AS INTEGER) AS position, substr(text, CAST(i AS BIGINT) * 2048 + 1, 2048) AS chunk, substr(sha256(doc_id || ':::' || i), 1, 16) AS chunk_id FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 2048 + 1)) AS i FROM documents WHERE length(text) > 0)")
def hard_chunks(spark, sf_dir):
    """K2's last resort, E5, H37."""
    rows = chunks.fixed_chunks(_docs(spark, sf_dir), "doc_id", 2048)
    return rows.withColumn("chunk_id", t.chunk_id(F.col("doc_id").cast("string"), F.col("position")))


_LIST = f"(SELECT doc_id, {_LINES} AS l FROM documents)"


@query(f"SELECT doc_id, array_to_string([CASE WHEN i = 1 THEN l[i] ELSE right(l[i - 1], 20) || ' ' || l[i] END FOR i IN range(1, len(l) + 1)], '|') AS grown FROM {_LIST}")
def chunk_overlap_tail(spark, sf_dir):
    """E3, on lines."""
    return _docs(spark, sf_dir).select("doc_id", F.array_join(chunks.with_overlap(F.split("text", "\n", -1), 20), "|").alias("grown"))


@query(f"""
WITH e AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS x FROM {_LIST}),
g AS (SELECT *, sum(CASE WHEN i = 1 OR length(x) >= 120 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM e),
m AS (SELECT doc_id, k, string_agg(x, ' ' ORDER BY i) AS piece FROM g GROUP BY doc_id, k)
SELECT doc_id, string_agg(piece, '|' ORDER BY k) AS merged FROM m GROUP BY doc_id
""")
def merge_short(spark, sf_dir):
    """E4, on lines: a fold here, running groups in the SQL."""
    return _docs(spark, sf_dir).select("doc_id", F.array_join(chunks.merged_short(F.split("text", "\n", -1), 120), "|").alias("merged"))


#: Headings by rule of the document and line, before every third line.
_HEADED = """
WITH e AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
h AS (SELECT *, CASE WHEN i % 3 = 1 THEN 1 + (doc_id + i) % 4 END AS lv, 'T' || (doc_id * i) % 3 AS name FROM e),
p AS (SELECT *, {last} FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
v AS (SELECT *, concat_ws(' > ', {valid}) AS path FROM p),
c AS (SELECT *, CASE WHEN path <> lag(path, 1, '') OVER (PARTITION BY doc_id ORDER BY i) THEN 1 ELSE 0 END AS other FROM v),
k AS (SELECT *, sum(other) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM c),
b AS (SELECT doc_id, k, nullif(any_value(path), '') AS path, trim(string_agg(x, chr(10) ORDER BY i), ' ' || chr(10) || chr(9) || chr(13)) AS body FROM k GROUP BY doc_id, k)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS position, path, body FROM b WHERE body <> ''
""".format(
    last=", ".join(f"coalesce(max(CASE WHEN lv = {n} THEN i END) OVER w, -1) AS p{n}, arg_max(name, CASE WHEN lv = {n} THEN i END) OVER w AS n{n}" for n in range(1, 5)),
    valid=", ".join(f"CASE WHEN p{n} > greatest(-1{''.join(f', p{m}' for m in range(1, n))}) THEN n{n} END" for n in range(1, 5)),
)


@query(_HEADED)
def heading_sections(spark, sf_dir):
    """A fold here; forward fill of each level by windows, void once a higher one came, in the SQL."""
    d = F.col("doc_id")
    head = lambda i: F.concat(F.lit("§H"), (1 + (d + i) % 4).cast("string"), F.lit("§ T"), ((d * i) % 3).cast("string"), F.lit("\n"))
    text = F.array_join(F.transform(F.split("text", "\n", -1), lambda x, i: F.when(i % 3 == 1, F.concat(head(i), x)).otherwise(x)), "\n")
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(chunks.sections(text)).alias("position", "s")).select("doc_id", "position", "s.path", "s.body")


def recursive_chunks(spark, sf_dir):
    """K2, K3, E6 over all documents."""
    return chunks.chunk_documents(_docs(spark, sf_dir), key="doc_id")


query(None)(recursive_chunks)


_RECORD_DAYS, _YEARS = ["Lunes", "Martes", "Miércoles", "Jueves", "Viernes"], ["Primer", "Segundo", "Tercer", "Cuarto"]
_RECORDS = f"""
WITH b AS (SELECT 'https://x.es/' || conv_id || '/' || turn AS url, (conv_id + turn) % 3 AS kind, CAST(1 + (conv_id + turn) % 4 AS INTEGER) AS c, CAST(1 + turn % 2 AS INTEGER) AS t, {_RECORD_DAYS}[conv_id % 5 + 1] AS dia,
   (8 + conv_id % 6) || ':30-' || (9 + conv_id % 6) || ':30' AS hora, (1 + turn % 3) || '.' || (conv_id % 9) AS aula, {list("ABCD")}[conv_id % 4 + 1] AS g, {_YEARS}[1 + (conv_id + turn) % 4] AS word FROM conversations),
r AS (SELECT url, 'horario' AS tipo, 0 AS position, c || 'º Grado en Ingeniería Informática (Computación), ' || t || 'º cuatrimestre — ' || dia || ' ' || hora || ': Derecho Informático (DI), aula ' || aula || '.' AS text,
   'horarios' AS category, false AS is_summary, c AS curso, NULL AS grupo, 'Computación' AS especialidad, t AS cuatrimestre, dia, hora, aula, NULL AS evento, 'DI' AS siglas FROM b WHERE kind = 0
 UNION ALL SELECT url, 'horario', 1, 'Asignaturas de ' || c || 'º ' || g || ', primer cuatrimestre: Redes (FR); Servidores (IS).', 'horarios', true, c, g, NULL, 1, NULL, NULL, NULL, NULL, 'FR,IS' FROM b WHERE kind = 0
 UNION ALL SELECT url, 'calendario', 0, 'Calendario TFG 2025-2026 | Defensa ' || g || ': 3 de julio, a las ' || hora, 'calendario', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'Defensa ' || g, NULL FROM b WHERE kind = 1
 UNION ALL SELECT url, 'plan_estudios', 0, 'Plan | ' || word || ' curso, especialidad Sistemas (CSI): Aprendizaje (AA), Redes (FR)', 'plan_estudios', true, c, NULL, 'CSI', NULL, NULL, NULL, NULL, NULL, 'CSI,AA,FR' FROM b WHERE kind = 2)
SELECT *, left(sha256(url || ':::' || position), 16) AS chunk_id FROM r"""


@query(_RECORDS)
def structured_records(spark, sf_dir):
    """Records by rule for every turn, beside a comment with its own text and a line that is too short."""
    conv, turn = F.col("conv_id"), F.col("turn")
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    year, group, hours = 1 + (conv + turn) % 4, pick("ABCD", conv % 4), F.concat(8 + conv % 6, F.lit(":30-"), 9 + conv % 6, F.lit(":30"))
    lesson = F.concat(year, F.lit("º Grado en Ingeniería Informática (Computación), "), 1 + turn % 2, F.lit("º cuatrimestre — "), pick(_RECORD_DAYS, conv % 5), F.lit(" "), hours, F.lit(": Derecho Informático (DI), aula "), 1 + turn % 3, F.lit("."), conv % 9, F.lit("."))
    subjects = F.concat(F.lit("Asignaturas de "), year, F.lit("º "), group, F.lit(", primer cuatrimestre: Redes (FR); Servidores (IS)."))
    note = F.concat(F.lit("# "), F.translate(F.coalesce("text", F.lit("")), "\n", " "))
    event = F.concat(F.lit("Calendario TFG 2025-2026 | Defensa "), group, F.lit(": 3 de julio, a las "), hours)
    plan = F.concat(F.lit("Plan | "), pick(_YEARS, year - 1), F.lit(" curso, especialidad Sistemas (CSI): Aprendizaje (AA), Redes (FR)"))
    kind = (conv + turn) % 3
    tipo = F.when(kind == 0, "horario").when(kind == 1, "calendario").otherwise("plan_estudios")
    text = F.concat_ws("\n", note, F.when(kind == 0, lesson).when(kind == 1, event).otherwise(plan), F.lit("breve"), F.when(kind == 0, subjects))
    docs = table(spark, sf_dir, "conversations").select(F.concat(F.lit("https://x.es/"), conv, F.lit("/"), turn).alias("url"), text.alias("text"), tipo.alias("tipo"))
    return chunks.chunk_records(docs).withColumn("siglas", F.array_join("siglas", ","))
