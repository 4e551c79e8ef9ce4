"""Chunking, search, retrieval, answers, curation and sources on small literals."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragframe import seams
from ragframe.operators import answers, chunks, corpus, dialogue, evaluate, retrieve, search
from ragframe.sources import store, timetable, web
from ragframe.streaming import events


@pytest.mark.parametrize("text", ["Frase corta. " * 400, "x" * 9000, ("parrafo " * 300 + "\n\n") * 3, "", "uno"])
def test_split_bound_and_content(text):
    pieces = list(chunks.split(text))
    assert all(chunks.tokens(p) <= 512 for p in pieces)
    bare = lambda x: "".join(x.replace(".", "").split())  # noqa: E731  a separator between pieces goes
    assert bare("".join(pieces)) == bare(text)


def test_sections_and_chunks(spark):
    text = "intro\n§H1§ Grado\nuno\n§H3§ Hondo\ndos\n§H2§ Medio\ntres\nPrimer curso\ncuatro\n§H1§ Otro\n§H1§ Grado\ncinco\n§H1§ Grado\nseis\n§H2§ vacío\n  "
    docs = spark.createDataFrame([("a", text), ("b", None), ("c", ""), ("d", "§H0§ x"), ("e", "Contenido académico relevante. " * 800)], "url string, text string")
    got = {r.url: [(x.path, x.body) for x in r.s] for r in docs.select("url", chunks.sections(F.col("text")).alias("s")).collect()}
    assert got["a"] == [(None, "intro"), ("Grado", "uno"), ("Grado > Hondo", "dos"), ("Grado > Medio", "tres"), ("Grado > Primer curso", "Primer curso\ncuatro"), ("Grado", "cinco\nseis")]
    assert got["b"] == got["c"] == got["d"] == [] and len(got["e"]) == 1
    rows = [r for r in chunks.chunk_documents(docs).orderBy("position").collect() if r.url == "e"]
    raw = list(chunks.split(("Contenido académico relevante. " * 800).strip()))
    assert len(rows) > 1 and all(chunks.tokens(r.text) <= 1024 for r in rows)
    assert rows[1].text == raw[0][-200:] + " " + raw[1] and rows[0].text == raw[0]


def test_chunk_documents_and_records(spark):
    docs = spark.createDataFrame([("u", "§H1§ A\nhola"), ("v", None)], "url string, text string")
    assert [(r.url, r.position, r.text) for r in chunks.chunk_documents(docs).collect()] == [("u", 0, "[A]\nhola")]
    lines = "1º Grado A — Lunes 9:30-10:30: Cálculo (CA), aula 1.1\n# nota\ncorta\n1º Grado A — Martes 9:30-10:30: Cálculo (CA), aula 1.2"
    rows = chunks.chunk_records(spark.createDataFrame([("x/horarios", lines, None)], "url string, text string, tipo string")).orderBy("position").collect()
    assert [(r.position, r.curso, r.dia) for r in rows] == [(0, 1, "Lunes"), (1, 1, "Martes")]


TEXTS = ["normativa de permanencia", "trabajo fin de grado normativa del grado", "clases de IC", "horario de clases", "plazo de matrícula", "beca erasmus", "guía docente", "secretaría"]


def test_bm25(spark):
    docs = spark.createDataFrame([(f"chunk_{i}", x) for i, x in enumerate(TEXTS)], "id string, text string")
    asked = spark.createDataFrame([(0, "Trabajo Fin de Grado normativa"), (1, "IC"), (2, "desconocida"), (3, "")], "q int, text string")
    index = search.bm25_index(docs, "id", F.col("text"))
    rows = search.bm25_search(index, asked, "q", F.col("text"), 3).collect()
    by = {q: [r.id for r in sorted(rows, key=lambda r: r.rank) if r.query == q] for q in range(4)}
    assert by[0][0] == "chunk_1" and by[1] == ["chunk_2"] and by[2] == by[3] == []


def test_knn_rrf_mmr(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(30, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, [float(x) for x in e]) for i, e in enumerate(v)], "id long, v array<double>").repartition(3)
    got = search.knn(rows, "id", "v", rows.filter("id < 2"), 40).collect()
    assert len(got) == 60 and all(r.id == r.query and r.score > 0.99 for r in got if r.rank == 1)
    assert [search.mmr_select(np.array([0.3, 0.9, 0.5, 0.7, 0.1]), v[:5], 3, 1.0), search.mmr_select(np.array([0.3, 0.9]), v[:2], 1, 0.0)] == [[1, 3, 2], [0]]
    assert search.mmr_select(np.zeros(0), v[:0], 3) == [] and sorted(search.mmr_select(np.ones(4), v[:4], 9)) == [0, 1, 2, 3]
    ranks = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (0, "b", 1), (0, "c", 2)], "query int, id string, rank int")
    assert [r.id for r in search.rrf(ranks).orderBy("rank").collect()] == ["b", "a", "c"]


def test_bm25_edges_and_kept_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "uno dos uno"), (4, "dos"), (4, "dos")], "id int, text string")
    asked = spark.createDataFrame([(0, "uno"), (1, None)], "q int, text string")
    kept = search.bm25_index(docs, "id", F.col("text"), lambda d: store.materialised(d, "postings"))
    plain = search.bm25_index(docs, "id", F.col("text"))
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert rows(kept.postings) == rows(plain.postings) == [("dos", 3, 1, 3), ("dos", 4, 1, 1), ("dos", 4, 1, 1), ("uno", 3, 2, 3)]
    assert rows(plain.lengths) == [(1, 0), (2, 0), (3, 3), (4, 1), (4, 1)] and tuple(plain.totals.first()) == (5, 1.0)
    few = rows(search.bm25_search(kept, asked, "q", F.col("text"), 3))
    before, search.MOST_BROADCAST_TERMS = search.MOST_BROADCAST_TERMS, 0
    try:
        assert few == rows(search.bm25_search(plain, asked, "q", F.col("text"), 3)) and [r[:2] for r in few] == [(0, 3)]
    finally:
        search.MOST_BROADCAST_TERMS = before
    assert search.bm25_search(search.bm25_index(docs.limit(0), "id", F.col("text")), asked, "q", F.col("text"), 3).count() == 0


def test_knn_by_category_and_edges(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 4))
    rows = spark.createDataFrame([(i, f"c{i % 3}", [float(x) for x in e]) for i, e in enumerate(v)] + [(90, "c0", None), (91, None, [1.0] * 4)], "id long, cat string, v array<double>").repartition(4)
    asked = spark.createDataFrame([(0, "c0", [1.0, 0.0, 0.0, 0.0]), (0, "c1", [1.0, 0.0, 0.0, 0.0]), (1, "c9", [1.0] * 4), (2, "c0", None)], "id long, cat string, v array<double>")
    got = sorted((r.query, r.rank, r.id) for r in search.knn(rows, "id", "v", asked, 5, by="cat").collect())
    best = sorted((i for i in range(60) if i % 3 < 2), key=lambda i: (-round(v[i, 0], 6), i))[:5]
    assert got == [(0, k + 1, i) for k, i in enumerate(best)]
    ties = spark.createDataFrame([(i, [1.0, 0.0]) for i in (9, 3, 7, 5)], "id long, v array<double>").coalesce(1)
    assert [(r.rank, r.id) for r in search.knn(ties, "id", "v", ties.filter("id = 5"), 2, exclude_self=True).orderBy("rank").collect()] == [(1, 3), (2, 7)]
    assert search.knn(ties.limit(0), "id", "v", ties, 2).count() == search.knn(ties, "id", "v", ties.limit(0), 2).count() == 0


def _chunks(spark):
    q = [1.0] + [0.0] * 7
    rows = [(i, f"registro {i}", "", f"u{i % 5}", i, "otra", None, None, False, None, [0.9] + [0.1 * (i % 4)] + [0.0] * 6) for i in range(20)]
    rows += [(100 + i, f"Asignaturas de {i}º", "", f"s{i}", i, "horarios", "horario", None, True, 3 if i < 2 else None, [-1.0] + [0.0] * 7) for i in range(4)]
    schema = "chunk_id long, text string, title string, source_url string, position int, category string, tipo string, siglas array<string>, is_summary boolean, curso int, vector array<double>"
    return spark.createDataFrame(rows, schema), q


def test_listing_queries_get_summaries(spark):
    held, q = _chunks(spark)
    asked = spark.createDataFrame([(1, "¿Qué asignaturas hay en tercer curso?", q), (2, "registro", q)], "query_id long, text string, vector array<double>")
    rows = retrieve.retrieve(asked, held, retrieve.Config(k_candidates=5, hybrid=False, reranker=None)).collect()
    assert {r.chunk_id for r in rows if r.query_id == 1} >= {100, 101, 102, 103} and sum(r.query_id == 1 for r in rows) > 4
    assert all(r.chunk_id < 100 for r in rows if r.query_id == 2) and sum(r.query_id == 2 for r in rows) == 5


def test_batch_of_queries_is_the_union_of_single_ones(spark):
    held, q = _chunks(spark)
    schema = "query_id long, text string, vector array<double>"
    data = [(1, "registro 3", q), (2, "registro 7", [0.5, 0.5] + [0.0] * 6)]
    run = lambda rows: {tuple(r) for r in retrieve.retrieve(spark.createDataFrame(rows, schema), held).select("query_id", "rank", "chunk_id").collect()}
    assert run(data) == run(data[:1]) | run(data[1:])


def test_scope_gate(spark):
    asked = spark.createDataFrame([(1, "¿Quién eres?"), (2, "plazo de matrícula"), (3, "receta"), (4, "otra cosa")], "query_id long, text string")
    hits = spark.createDataFrame([(2, 5.0), (3, -3.0), (4, 0.0)], "query_id long, score double")
    out = {r.query_id: r.in_scope for r in retrieve.in_scope(asked, hits, arbiter=lambda x: "FUERA").collect()}
    assert out == {1: True, 2: True, 3: False, 4: False}
    assert {r.query_id: r.in_scope for r in retrieve.in_scope(asked, hits).collect()}[4] is True


def test_presentation_and_answers(spark):
    hits = spark.createDataFrame([(1, 1, "a", 5, "A", "El plazo acaba el 3 de julio. Otra cosa."), (1, 2, "b", 0, "B", "dos"), (1, 3, "a", 1, "A", "tres"), (1, 4, "c", 0, "", "cuatro"), (1, 5, "d", 0, "D", "cinco")], "query_id long, rank int, source_url string, position int, title string, text string").withColumn("chunk_id", F.col("rank"))
    shown = answers.presented(hits).orderBy("place").collect()
    assert [(r.rank, r.marker) for r in shown] == [(3, 1), (2, 2), (5, 3), (4, 4), (1, 1)]
    asked = spark.createDataFrame([(1, "¿Cuándo?"), (2, "nada")], "query_id long, text string")
    out = {r.query_id: r for r in answers.answer(asked, hits, lambda s, u: "El plazo acaba el 3 de julio [1] [9]." if "fragmento" in u else "No dispongo de información").collect()}
    assert out[1].answer == "El plazo acaba el 3 de julio [1]." and [s.url for s in out[1].sources] == ["a"] and list(out[1].invalid) == [9]
    assert list(out[2].sources) == [] and out[2].block == ""
    bare = answers.answer(asked.filter("query_id = 1"), hits, lambda s, u: "El plazo acaba el 3 de julio").first()
    assert [s.url for s in bare.sources] == ["a"]


def test_sentence_dedup():
    same = "El plazo de entrega acaba el lunes 3. El plazo de entrega acaba este lunes 3. El plazo de entrega acaba el lunes 4."
    assert answers.without_repeats(same) == "El plazo de entrega acaba el lunes 3. El plazo de entrega acaba el lunes 4."
    assert answers.without_repeats("Sí. Correcto.") == "Sí. Correcto." and answers.without_repeats("  ") == "  "


def test_curation(spark):
    docs = spark.createDataFrame([("a", "uno"), ("b", "dos"), ("c", "uno")], "url string, text string")
    assert {r.url for r in corpus.keep_first(docs, "url").collect()} == {"a", "b"}
    new = spark.createDataFrame([("b", "DOS"), ("d", "x")], "url string, text string")
    assert {tuple(r) for r in corpus.upsert(docs, new).collect()} == {("a", "uno"), ("c", "uno"), ("b", "DOS"), ("d", "x")}
    assert corpus.append_absent(docs, new).count() == 4
    assert [r.url for r in corpus.remove(docs, corpus.contains_query("DOS", F.col("text")), dry_run=True).collect()] == ["b"]


def test_html(spark):
    dup = web.parse_html("<main><div><a>Web del Grado</a><span>Web del Grado</span></div></main>")[1]
    assert dup.count("Web del Grado") == 1
    _, text, n = web.parse_html("<html><head><title> T </title></head><body><nav>Menu</nav><main><h1>Grado</h1><h2>Primer curso</h2><table><tr><th>A</th><th>B</th></tr><tr><td>Calculo</td><td>6</td></tr></table></main><footer>cookies</footer>")
    assert n == 1 and "| Calculo | 6 |" in text and text.count("| A | B |") == 1 and "§H1§ Grado" in text and "§H2§ Primer curso" in text and "Menu" not in text and "cookies" not in text


def test_urls_and_crawl(spark):
    assert web.year_patterns("mal") == [] and len(web.year_patterns("25-26")) == 6
    rows = spark.createDataFrame([("https://x.es/Horarios%20(20-21).pdf",), ("https://x.es/Horarios%20(25-26).pdf",), ("https://x.es/nov24.pdf",), ("https://x.es/a.zip",), ("https://y.org/a",)], "url string")
    ok = [r[0] for r in rows.select(web.passes(F.col("url"), ["x.es"], [".pdf"], [], web.year_patterns("25-26"))).collect()]
    assert ok == [False, True, False, False, False]
    pages = spark.createDataFrame([("http://ugr.es/a/", '<a href="b/#x">1</a><a href="mailto:z">2</a><a class=k href=\'http://ugr.es/c/\'>3</a>')], "url string, html string")
    assert {r.link for r in web.links(pages).collect()} == {"https://ugr.es/a/b", "https://ugr.es/c"}
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "x")], "url string, link string")
    got = web.crawl(spark.createDataFrame([("a",)], "url string"), edges, lambda u: u != "x", 5)
    assert {tuple(r) for r in got.collect()} == {("a", 0), ("b", 1), ("c", 2)}


#: A small timetable: words with their places on a page.
GRID = [
    (1, 40, 10, "4º"), (1, 60, 10, "Grado"), (1, 90, 10, "en"), (1, 100, 10, "Ingeniería"), (1, 140, 10, "Informática"), (1, 40, 30, "2º"), (1, 55, 30, "cuatrimestre"),
    (1, 120, 50, "Lunes"), (1, 200, 50, "Martes"), (1, 280, 50, "Miércoles"), (1, 360, 50, "Jueves"), (1, 440, 50, "Viernes"),
    (1, 40, 70, "11:30-12:30"), (1, 121, 70.5, "DI"), (1, 201, 70, "PPR"), (1, 120, 80, "1.4"), (1, 200, 80, "2.6"), (1, 40, 100, "DI."), (1, 60, 100, "Derecho"), (1, 90, 100, "Informático."),
]


def test_timetable_lines_and_states(spark):
    """Lines are anchored at their first word, a new title ends the columns, rooms and legend entries stay out of cells."""
    words = [("a", 1, 5.0, 10.0, "uno"), ("a", 1, 1.0, 12.9, "dos"), ("a", 1, 1.0, 13.5, "tres"), ("a", 1, 9.0, 16.0, "cuatro"), ("a", 1, 2.0, 17.0, "cinco"), ("a", 1, 0.0, 1.0, "  ")]
    schema = "doc_id string, page int, x double, y double, token string"
    got = [[w.token for w in r.words] for r in timetable.lines(spark.createDataFrame(words, schema)).orderBy("line").collect()]
    assert got == [["dos", "uno"], ["tres", "cuatro"], ["cinco"]]
    days = [("Lunes", 100), ("martes", 200), ("JUEVES", 300)]
    title = lambda y, page=1: ("g", page, 0.0, y, "3º Grado en Ingeniería Informática")
    grid = [title(0.0), *[("g", 1, float(x), 20.0, d) for d, x in days], ("g", 1, 0.0, 40.0, "9:30-10:30"), ("g", 1, 150.0, 40.0, "FR"), ("g", 1, 155.0, 40.0, "(A1)"), ("g", 1, 158.0, 40.0, "(A2)"), ("g", 1, 290.0, 40.0, "nada"), ("g", 1, 301.0, 40.0, "IS"), ("g", 1, 320.0, 40.0, "SO."), ("g", 1, 330.0, 40.0, "Sistemas")]
    grid += [("g", 1, 300.0, 50.0, "1.1"), ("g", 1, 305.0, 50.0, "-1.2"), ("g", 1, 0.0, 60.0, "10:30-11:30"), ("g", 1, 100.0, 60.0, "SO"), ("g", 2, 100.0, 0.0, "1.7"), title(10.0, 2), ("g", 2, 0.0, 20.0, "9:30-10:30"), ("g", 2, 100.0, 20.0, "IS")]
    got = [r.record for r in timetable.parse(spark.createDataFrame(grid, schema)).orderBy("position").collect()]
    at = "3º Grado en Ingeniería Informática"
    assert got == [f"{at} — Lunes 9:30-10:30: FR (A1) (A2).", f"{at} — Jueves 9:30-10:30: IS, aula 1.1 / -1.2.", f"{at} — Lunes 10:30-11:30: Sistemas (SO).", f"Asignaturas de {at}: FR; IS; Sistemas (SO)."]
    assert timetable.parse(spark.createDataFrame([], schema)).count() == 0


def test_timetable_grid(spark):
    words = spark.createDataFrame([("g", p, float(x), float(y), w) for p, x, y, w in GRID], "doc_id string, page int, x double, y double, token string")
    got = "\n".join(r.record for r in timetable.parse(words).orderBy("position").collect())
    assert "Lunes 11:30-12:30: Derecho Informático (DI), aula 1.4" in got and "Martes 11:30-12:30: PPR, aula 2.6" in got and "Viernes" not in got and got.count("Asignaturas de") == 1


def test_dialogue(spark):
    turns = spark.createDataFrame([(1, 0, "assistant", "Hola"), (1, 1, "user", "clases de Cálculo del grupo B"), (1, 2, "assistant", "Es el lunes [1]."), (1, 3, "user", "¿y las prácticas?")], "conv_id int, turn int, role string, text string")
    got = {r.turn: r.enriched for r in dialogue.carried(turns).collect()}
    assert got[3] == "¿y las prácticas? CA grupo B" and got[1] == "clases de Cálculo del grupo B"
    assert [(r.turn, r.text) for r in dialogue.history(turns, 1).orderBy("turn").collect()] == [(1, "clases de Cálculo del grupo B"), (2, "Es el lunes.")]
    assert dialogue.titles(turns).first().title == "clases de Cálculo del grupo B"
    many = spark.createDataFrame([(1, i, "assistant", "x") for i in range(30)], "conv_id int, turn int, role string, text string")
    said = [r.closing for r in dialogue.closings(many).orderBy("turn").collect()]
    assert all(a != b for a, b in zip(said, said[1:], strict=False))


@pytest.mark.parametrize("n", [1, 2, 19, 20, 21, 100])
def test_p95_is_a_row(spark, n):
    values = [float((i * 7919) % 1013) - 300 for i in range(n)]
    want = sorted(values)[min(n - 1, int(0.95 * n))]
    assert evaluate.p95(spark.createDataFrame([(v,) for v in values], "v double"), "v").first().p95 == want


def test_stores(spark, tmp_path):
    good = {"url": "u", "title": "t", "text": "x", "fetched_at": "2025-01-01T00:00:00+00:00"}
    (tmp_path / "c.jsonl").write_text(json.dumps(good) + "\n{bad\n")
    rows = store.read_corpus(spark, str(tmp_path / "c.jsonl"), strict=False).cache()
    assert rows.filter("_corrupt_record is not null").count() == 1
    assert [(r.category, r.source_type) for r in store.documents(rows).collect()] == [("general", "html")]
    with pytest.raises(Exception):  # noqa: B017
        store.read_corpus(spark, str(tmp_path / "c.jsonl")).collect()
    index = search.bm25_index(spark.createDataFrame([(1, "a b")], "id int, text string"), "id", F.col("text"))
    store.save_index(index, str(tmp_path / "i"))
    assert store.load_index(spark, str(tmp_path / "i")).postings.count() == 2


def test_contextualising_uses_the_cache_and_survives_failure(spark):
    held = spark.createDataFrame([("c", "u", "trozo")], "chunk_id string, source_url string, text string")
    docs = spark.createDataFrame([("u", "todo", "t")], "url string, text string, title string")
    rows, cache = store.contextualised(held, docs, None, lambda s, u: '"Un contexto"')
    assert rows.first().text == "Un contexto\n\ntrozo"

    def fail(s, u):
        raise ValueError

    again, _ = store.contextualised(held, docs, cache, fail)
    assert again.first().text == "Un contexto\n\ntrozo"
    assert store.contextualised(held, docs, None, fail)[0].first().text == "trozo"


def test_streaming_matches_batch(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.write.parquet(str(tmp_path / "in"))
    stream = events.hourly(events.read_stream(spark, str(tmp_path / "in"), source.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ").replace(",", ", ")), "10 minutes")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("hourly").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("hourly").collect()} == {tuple(r) for r in events.hourly(source).collect()}


def test_seams(spark):
    v = seams.hashed_embedding(["hola mundo", "hola mundo", ""])
    assert np.allclose(v[0], v[1]) and np.allclose(np.linalg.norm(v[0]), 1) and not v[2].any()
