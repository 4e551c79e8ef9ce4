"""Queries of query understanding, conversations, prompts, citations and answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ragframe import seams
from ragframe.functions import fixed, intent
from ragframe.functions import records as rec
from ragframe.functions import text as t
from ragframe.operators import answers, dialogue, overlap
from ragframe.sources import store

from .registry import query, table

#: Questions for the rule-based operators, put before every turn of the conversations, in whose invented words no rule fires.
QUESTIONS = (
    "¿Qué asignaturas hay en tercer curso?", "¿Cuándo es el examen de IA?", "clases de DI", "plazo de entrega del TFG", "horario de la secretaría", "horarios de clase de Cálculo", "beca erasmus", "normativa de permanencia",
    "prácticas en empresa", "guía docente de Estructura de Datos", "¿Quién eres?", "y el grupo 1ºD?", "¿en qué aula es Derecho Informático?", "lista de optativas", "hola", "todos los grupos de primero",
)


def _spread(phrases, name: str) -> str:
    """The SQL of _phrased."""
    return f"WITH {name} AS (SELECT conv_id, turn, [{', '.join(f"'{p}'" for p in phrases)}][(conv_id * 7 + turn) % {len(phrases)} + 1] || ' ' || coalesce(text, '') AS text FROM conversations)"


def _phrased(spark, sf_dir, phrases):
    """conv_id, turn, text of all turns of the conversations, each with one of the phrases before its own text."""
    phrase = F.get(F.array(*[F.lit(p) for p in phrases]), ((F.col("conv_id") * 7 + F.col("turn")) % len(phrases)).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(phrase, F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"))


_Q = _spread(QUESTIONS, "q")


def _questions(spark, sf_dir):
    return _phrased(spark, sf_dir, QUESTIONS)


def _re2(pattern: str) -> str:
    """A fixed pattern for RE2: letters count in word boundaries there only if they are ASCII, so \\b is spelled out."""
    return pattern.replace("'", "''").replace(r"\b", r"(?:^|$|[^\pL\pN_])")


def _unless(begin: str, not_: str) -> str:
    """SQL: does some match of `begin` stand before a word and not before `not_`? RE2 has no look-ahead, so what follows each match is tested."""
    parts = f"regexp_split_to_array(text, '(?i){begin}')"
    return f"len(list_filter(range(2, len({parts}) + 1), lambda i: regexp_matches({parts}[i], '^[\\pL\\pN_]') AND NOT regexp_matches(array_to_string({parts}[i:], ' '), '(?i)^{not_}'))) > 0"


_LOOKING_AHEAD = " OR ".join([
    r"regexp_matches(text, '(?i)(?:a\s+qué\s+hora|(?:qué|en\s+qué)\s+aula|horarios?\s+de\s+(?:las?\s+)?(?:clase|asignatura))')",
    _unless(r"clases?\s+de\s+", r"la\s+secretar"), _unless(r"horarios?\s+de\s+", r"[^\n]*(?:secretar|ex[áa]men)"),
])
_FIRED = ", ".join(f"CASE WHEN {_LOOKING_AHEAD if '(?!' in p else f"regexp_matches(text, '(?i){_re2(p)}')"} THEN '{name}' END" for name, p, _ in fixed.ROUTES)
_BOOSTS = ", ".join(f"('{name}', '{category}', {float(boost)}::DOUBLE)" for name, _, boosts in fixed.ROUTES for category, boost in boosts.items())


@query(f"{_Q} SELECT conv_id, turn, array_to_string(list_filter([{_FIRED}], lambda x: x IS NOT NULL), ',') AS rules FROM q")
def route_queries(spark, sf_dir):
    """The rules that fire."""
    return _questions(spark, sf_dir).select("conv_id", "turn", F.array_join(intent.routes(F.col("text"))["rules"], ",").alias("rules"))


@query(f"""{_Q}, boosts(rule, category, boost) AS (VALUES {_BOOSTS})
SELECT conv_id, turn, category, max(boost) AS boost FROM (SELECT conv_id, turn, unnest(list_filter([{_FIRED}], lambda x: x IS NOT NULL)) AS rule FROM q) JOIN boosts USING (rule) GROUP BY conv_id, turn, category""")
def route_boosts(spark, sf_dir):
    """A row for each query and category, with the largest boost of the rules that fire."""
    return _questions(spark, sf_dir).select("conv_id", "turn", F.explode(intent.routes(F.col("text"))["categories"]).alias("category", "boost"))


def _any(patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches(text, '(?i){_re2(p)}')" for p in patterns) + ")"


_TT, _EX = _any([fixed.TIMETABLE_INTENT]), _any([fixed.EXAM_INTENT])


@query(f"""{_Q} SELECT conv_id, turn, {_any(fixed.LISTING)} AS listing, CASE WHEN {_TT} AND NOT {_EX} THEN 'horario' WHEN {_EX} AND NOT {_TT} THEN 'calendario' END AS wanted,
 {_any([fixed.META])} AS meta, {_any([fixed.ANAPHORIC])} AS anaphoric,
 CAST(coalesce(CASE lower(regexp_extract(text, '(?i)(?:^|[^\\pL\\pN_])(primer|segund|tercer|cuart)', 1)) WHEN 'primer' THEN '1' WHEN 'segund' THEN '2' WHEN 'tercer' THEN '3' WHEN 'cuart' THEN '4' END,
   nullif(regexp_extract(text, '(?:^|[^\\pL\\pN_])([1-4])\\s*º?(?:$|[^\\pL\\pN_])', 1), '')) AS VARCHAR) AS course FROM q""")
def listing_intent(spark, sf_dir):
    """H29, H30, H24, H10's questions about the assistant."""
    text = F.col("text")
    return _questions(spark, sf_dir).select("conv_id", "turn", intent.is_listing(text).alias("listing"), intent.wanted_type(text).alias("wanted"), t.is_meta(text).alias("meta"), t.matches(text, fixed.ANAPHORIC).alias("anaphoric"), intent.course(text).cast("string").alias("course"))


def _subjects_sql(text: str) -> str:
    """SQL: short forms that are whole words, then full names, without accents."""
    short = f"list_filter(regexp_extract_all({text}, '[\\pL\\pN_]+'), lambda t: list_contains({list(fixed.SUBJECTS)}, t))"
    names = {t.lower().translate(str.maketrans("áéíóúüñ", "aeiouun")): sigla for sigla, t in fixed.SUBJECTS.items()}
    found = f"regexp_extract_all(strip_accents(lower({text})), '\\b(?:{'|'.join(sorted(names, key=len, reverse=True))})\\b')"
    both = f"list_concat({short}, list_transform({found}, lambda n: {list(names.values())}[list_position({list(names)}, n)]))"
    return f"list_filter({both}, lambda x, i: list_position({both}, x) = i)"


_SPELLED = "list_transform(words, lambda w: CASE WHEN list_contains({keys}, rtrim(w, '?.,;:!')) THEN rtrim(w, '?.,;:!') || ' (' || {names}[list_position({keys}, rtrim(w, '?.,;:!'))] || ')' || w[length(rtrim(w, '?.,;:!')) + 1:] ELSE w END)".format(keys=list(fixed.SUBJECTS), names=list(fixed.SUBJECTS.values()))


@query(f"""{_Q}, w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\s\\x{{A0}}]+'), lambda x: x <> '') AS words FROM q),
f AS (SELECT *, array_to_string({_SPELLED}, ' ') AS spelled, {_subjects_sql('text')} AS found,
  coalesce(nullif(replace(regexp_extract(text, '(?i){_re2(fixed.GROUP)}', 1), ' ', ''), ''), nullif(replace(regexp_extract(text, '{_re2(fixed.GROUP_BARE)}', 1), ' ', ''), ''), nullif(upper(regexp_extract(text, '(?i){_re2(fixed.GROUP_LETTER)}', 1)), '')) AS g,
  regexp_matches(text, '(?i){_re2(fixed.SUBGROUP)}') AS sub, CASE WHEN {_any([fixed.PRACTICE])} THEN 'prácticas' WHEN {_any([fixed.THEORY])} THEN 'teoría' END AS tipo, {_any([fixed.ANAPHORIC])} AS anaphoric FROM w),
s AS (SELECT *, {_subjects_sql('spelled')} AS named FROM f)
SELECT conv_id, turn, spelled || array_to_string(list_transform(list_filter(named, lambda x: NOT list_contains(list_transform(words, lambda w: rtrim(w, '?.,;:!')), x)), lambda x: ' (' || x || ')'), '') AS expanded,
  array_to_string(found, ',') AS subjects, 'grupo ' || g AS grupo, tipo, anaphoric OR (len(words) <= 6 AND len(found) = 0 AND (g IS NOT NULL OR sub OR tipo IS NOT NULL)) AS followup FROM s""")
def query_expansion(spark, sf_dir):
    """H18, H19, H25, H31."""
    text = F.col("text")
    found = intent.entities(text)
    return _questions(spark, sf_dir).select("conv_id", "turn", intent.expanded(text).alias("expanded"), F.array_join(intent.subjects(text), ",").alias("subjects"), found["grupo"].alias("grupo"), found["tipo"].alias("tipo"), intent.is_followup(text, found).alias("followup"))

_ANSWERS = (
    "No dispongo de información sobre eso.", "Lo siento, no hay datos.", "No se menciona el plazo.", "El examen es el 3 de julio [1].", "No puedo recomendar una.", "Según la información disponible, es en junio [2] [9] [5.1-3].",
    "La respuesta es: aula 1.4.\nEspero que esto ayude.", "Tras revisar los fragmentos.\nEl plazo es el lunes [1][3].", "Hay * uno * dos", "El plazo acaba el lunes 3. El plazo acaba el lunes 3 de verdad. El plazo acaba el martes 4.",
)
_A = _spread(_ANSWERS, "a")


def _answers(spark, sf_dir):
    return _phrased(spark, sf_dir, _ANSWERS)


@query(f"{_A} SELECT conv_id, turn, {_any([fixed.ABSTENTION_START])} AS abstention, {_any([fixed.NO_INFO])} AS no_info, {_any([fixed.DECLINE])} AS decline, {_any(fixed.LEAKS)} AS leak FROM a")
def abstention_flag(spark, sf_dir):
    """Both detectors, and the others."""
    x = F.col("text")
    return _answers(spark, sf_dir).select("conv_id", "turn", t.is_abstention(x).alias("abstention"), t.is_no_info(x).alias("no_info"), t.is_decline(x).alias("decline"), t.matches(x, *fixed.LEAKS).alias("leak"))


def answer_cleaning(spark, sf_dir):
    """H8, H9, C15, E18."""
    return _answers(spark, sf_dir).select("conv_id", "turn", t.clean_answer(F.col("text")).alias("clean"), answers.sentence_dedup(F.col("text")).alias("deduped"), t.markdown_lists(F.col("text")).alias("lists"))


query(None)(answer_cleaning)


@query(r"""
WITH d AS (SELECT doc_id, text || ' [' || (doc_id % 7) || '][3] x [12] [5.1-3] , y' AS text FROM documents),
m AS (SELECT doc_id, text, list_sort(list_distinct([CAST(x AS INTEGER) FOR x IN regexp_extract_all(text, '\[(\d+)\]', 1)])) AS ms FROM d)
SELECT doc_id, array_to_string(ms, ',') AS markers, array_to_string([x FOR x IN ms IF x <= 4], ',') AS valid, array_to_string([x FOR x IN ms IF x > 4], ',') AS invalid FROM m
""")
def citation_markers(spark, sf_dir):
    """Markers put after each text; 0 to 4 are known."""
    marked = F.concat("text", F.lit(" ["), (F.col("doc_id") % 7).cast("string"), F.lit("][3] x [12] [5.1-3] , y"))
    rows = table(spark, sf_dir, "documents").select("doc_id", t.markers(marked).alias("m"))
    known = F.array(*[F.lit(i) for i in range(5)])
    return rows.select("doc_id", F.array_join("m", ",").alias("markers"), F.array_join(F.array_intersect("m", known), ",").alias("valid"), F.array_join(F.array_except("m", known), ",").alias("invalid"))


_STOP = ", ".join(f"'{w}'" for w in fixed.STOPWORDS)
_SALIENT = rf"list_distinct(list_filter(regexp_extract_all(regexp_replace(regexp_replace(strip_accents(lower({{}})), '\[\d+\]', ' ', 'g'), '(\d{{{{1,2}}}}):\d{{{{2}}}}', '\1', 'g'), '[a-z0-9]+'), lambda x: NOT list_contains([{_STOP}], x) AND (regexp_matches(x, '^[0-9]+$') OR length(x) >= 3)))"


@query(f"SELECT doc_id, CAST(len({_SALIENT.format('text')}) AS INTEGER) AS n, array_to_string(list_sort({_SALIENT.format('text')}), ' ') AS tokens FROM documents")
def salient_tokens(spark, sf_dir):
    """H5."""
    rows = table(spark, sf_dir, "documents").select("doc_id", t.salient_tokens(F.col("text")).alias("s"))
    return rows.select("doc_id", F.size("s").alias("n"), F.array_join(F.array_sort("s"), " ").alias("tokens"))


_SENTENCES = r"list_filter(string_split(regexp_replace(trim(text, chr(32) || chr(9) || chr(10)), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')"


@query(f"SELECT doc_id, CAST(i AS INTEGER) AS place, s[i + 1] AS sentence FROM (SELECT doc_id, {_SENTENCES} AS s, unnest(range(len({_SENTENCES}))) AS i FROM documents)")
def sentence_split(spark, sf_dir):
    """H6."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(t.sentences(F.col("text"))).alias("place", "sentence"))


def sentence_dedup(spark, sf_dir):
    """C15, E18 over all documents."""
    return table(spark, sf_dir, "documents").select("doc_id", answers.sentence_dedup(F.col("text")).alias("text"))


query(None)(sentence_dedup)

_COVER = f"""
WITH a AS (SELECT item_id AS query_id, {_SALIENT.format('text')} AS ts FROM benchmark),
d AS (SELECT doc_id, lang AS source_url, {_SALIENT.format('text')} AS t FROM documents),
ae AS (SELECT query_id, len(ts) AS n, unnest(ts) AS x FROM a), de AS (SELECT doc_id, source_url, unnest(t) AS x FROM d),
s AS (SELECT query_id, doc_id, source_url, count(*) AS shared, any_value(n) AS n FROM ae JOIN de USING (x) GROUP BY 1, 2, 3 HAVING count(*) >= 3),
c AS (SELECT query_id, doc_id, source_url, CAST(shared AS INTEGER) AS shared, round(shared / n, 6) AS score FROM s WHERE round(shared / n, 6) >= 0.3)
"""


def _covered(spark, sf_dir, *columns):
    """C14 for queries and chunks that aren't paired yet."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), t.salient_tokens(F.col("text")).alias("tokens"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", *columns)
    return overlap.overlap_texts(asked, docs, "text", fixed.RECOVER_THRESHOLD, fixed.MIN_SHARED, lambda d: store.materialised(d, "overlap"))


@query(f"{_COVER} SELECT query_id, doc_id, shared, score FROM c")
def answer_coverage(spark, sf_dir):
    """C14."""
    return _covered(spark, sf_dir).select("query_id", "doc_id", "shared", "score")


@query(f"{_COVER}, b AS (SELECT query_id, source_url, max(score) AS score FROM c GROUP BY 1, 2) SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_url) AS INTEGER) AS rank FROM b")
def recover_sources_best(spark, sf_dir):
    """The best coverage of each source (here: language)."""
    best = _covered(spark, sf_dir, F.col("lang").alias("source_url")).groupBy("query_id", "source_url").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("source_url"))))


#: Hits for the presentation operators: documents stand for chunks, sources for documents, a language is a query.
_HITS = "WITH h AS (SELECT lang AS query_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR))) AS INTEGER) AS rank, doc_id AS position, source AS source_url FROM documents)"
_SHOWN = f"""{_HITS},
p AS (SELECT *, min(rank) OVER (PARTITION BY query_id, source_url) AS g, count(*) OVER (PARTITION BY query_id) AS n FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY g, position, rank) - 1 AS i FROM p),
m AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n <= 2 THEN 0 ELSE i % 2 END, CASE WHEN i % 2 = 0 OR n <= 2 THEN i ELSE -i END) AS place FROM o),
f AS (SELECT *, min(place) OVER (PARTITION BY query_id, source_url) AS first FROM m),
s AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY first) AS marker FROM f)
"""


def _hits(spark, sf_dir):
    order = Window.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")))
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("query_id"), F.row_number().over(order).alias("rank"), F.col("doc_id").alias("position"), F.col("source").alias("source_url"), F.col("source").alias("title"), "text")


@query(f"{_SHOWN} SELECT query_id, rank, position, CAST(place AS INTEGER) AS place, CAST(marker AS INTEGER) AS marker FROM s")
def lost_in_middle(spark, sf_dir):
    """E10-E12."""
    return answers.presented(_hits(spark, sf_dir)).select("query_id", "rank", "position", "place", "marker")


@query(f"{_SHOWN} SELECT DISTINCT query_id, CAST(marker AS INTEGER) AS marker, source_url AS title, source_url AS url FROM s")
def marker_per_url(spark, sf_dir):
    """E12, E13."""
    return answers.source_map(answers.presented(_hits(spark, sf_dir)))


def answer_pipeline(spark, sf_dir):
    """An answer for each benchmark text from its best documents, with the stand-in generator."""
    from .search_queries import bm25_topk

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("title"), F.concat(F.lit("https://x.es/"), "source").alias("source_url"), F.lit(0).alias("position"))
    hits = bm25_topk(spark, sf_dir).join(docs, "id").withColumnRenamed("query", "query_id").withColumnRenamed("id", "chunk_id")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    out = answers.answer(asked, hits, seams.extractive_answer)
    return out.select("query_id", "answer", F.array_join("valid", ",").alias("valid"), F.size("sources").alias("n_sources"), "block")


query(None)(answer_pipeline)


@query("""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM o WHERE i > 1 AND i < n AND n > 2 AND trim(text) <> '')
SELECT conv_id, turn, role FROM k WHERE b <= 6
""")
def history_last_n(spark, sf_dir):
    """E15, H11."""
    return dialogue.history(table(spark, sf_dir, "conversations"), 3).select("conv_id", "turn", "role")


@query("SELECT conv_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 40) || '...' ELSE text END AS title FROM (SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY 1)")
def conv_title(spark, sf_dir):
    """E19."""
    return dialogue.titles(table(spark, sf_dir, "conversations"))


@query("SELECT role, count(*) AS n, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY role")
def role_counts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("conversations"))


_GROUPED = "text || CASE turn % 5 WHEN 0 THEN ' grupo B' WHEN 2 THEN ' grupo C teoría' ELSE '' END"


@query(f"""
WITH u AS (SELECT conv_id, turn, nullif(upper(regexp_extract({_GROUPED}, ' grupo ([A-H])( |$)', 1)), '') AS g FROM conversations WHERE role = 'user')
SELECT conv_id, turn, g AS own, last_value(g IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS carried FROM u
""")
def entity_carry(spark, sf_dir):
    """The last group named in the six user turns before; groups are put after some turns."""
    suffix = F.when(F.col("turn") % 5 == 0, " grupo B").when(F.col("turn") % 5 == 2, " grupo C teoría").otherwise("")
    rows = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", F.nullif(F.upper(F.regexp_extract(F.concat("text", suffix), " grupo ([A-H])( |$)", 1)), F.lit("")).alias("own"))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-6, -1)
    return rows.withColumn("carried", F.last("own", ignorenulls=True).over(before))


def history_enrichment(spark, sf_dir):
    """H32, E20."""
    turns = table(spark, sf_dir, "conversations")
    return dialogue.carried(turns).join(dialogue.closings(turns).withColumn("turn", F.col("turn") - 1), ["conv_id", "turn"], "left")


query(None)(history_enrichment)


@query("""
WITH s AS (SELECT conv_id, turn, coalesce(text, '') AS text, i, ['Lunes', 'Martes'][CAST((conv_id + i) // 3 % 2 AS INTEGER) + 1] AS day, 8 + i + CASE WHEN (conv_id + turn + i) % 3 = 0 THEN 1 ELSE 0 END AS h,
   CASE WHEN turn % 2 = 0 THEN '' ELSE ' (aula 1.' || ((conv_id + i) // 2 % 2) || ')' END AS room FROM conversations, range(5) r(i)),
b AS (SELECT *, CASE WHEN lag(day || room) OVER w = day || room AND lag(h) OVER w + 1 = h THEN 0 ELSE 1 END AS begins FROM s WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)),
n AS (SELECT *, sum(begins) OVER (PARTITION BY conv_id, turn ORDER BY i) AS island FROM b),
m AS (SELECT conv_id, turn, text, island, any_value(day) || ' ' || min(h) || ':30-' || (max(h) + 1) || ':30' || any_value(room) AS slot FROM n GROUP BY conv_id, turn, text, island)
SELECT conv_id, turn, string_agg(slot, ', ' ORDER BY island) || ' ' || text AS merged FROM m GROUP BY conv_id, turn, text""")
def slot_merging(spark, sf_dir):
    """Five slots by rule before every turn's text, a fold here and islands in the SQL; turns without rooms and with."""

    def slot(i):
        at = F.col("conv_id") + i
        day = F.when(F.floor(at / 3) % 2 == 0, "Lunes").otherwise("Martes")
        hour = 8 + i + F.when((at + F.col("turn")) % 3 == 0, 1).otherwise(0)
        room = F.when(F.col("turn") % 2 == 0, "").otherwise(F.concat(F.lit(" (aula 1."), (F.floor(at / 2) % 2).cast("string"), F.lit(")")))
        return F.concat(day, F.lit(" "), hour.cast("string"), F.lit(":30-"), (hour + 1).cast("string"), F.lit(":30"), room)

    slots = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(4)), slot), ", ")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", rec.merged_slots(F.concat(slots, F.lit(" "), F.coalesce("text", F.lit("")))).alias("merged"))
