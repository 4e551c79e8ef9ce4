"""Text, record and intent functions on small literals."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from ragframe.functions import fixed, intent, records
from ragframe.functions import text as t


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("text, want", [("Asignatura\nAsignatura\nTipo\nTipo\nCalculo", "Asignatura\nTipo\nCalculo"), ("| a | b |\n| a | b |", "| a | b |\n| a | b |"), ("", ""), (None, None), ("a\n\n\na", "a\n\n\na"), ("  x\nx ", "  x")])
def test_collapse_repeats(spark, text, want):
    assert one(spark, text, t.collapse_repeats) == want


def test_parser_version_trims_and_collapses_tables(spark):
    assert one(spark, "| a |  \n| a |\nb  ", lambda c: t.collapse_repeats(c, keep_tables=False)) == "| a |\nb"


def test_clean_chain(spark):
    raw = "Málaga  y  más\nAVISO LEGAL\nInicio > x\nx\nx\n\n\n\nfin "
    row = t.cleaned(spark.createDataFrame([(raw,)], "text string")).first()
    assert row.text == "Málaga y más\nx\n\nfin"


def test_marks_are_stripped_from_all_letters(spark):
    letters = [chr(i) for i in (*range(1, 0xD800), *range(0xE000, 0x30000))]
    texts = ["čeština Łódź ąęő șț Ṩ ǅ ｆｕｌｌ", "ﬁn ½ ㎏ 각 ß", "e\u0301 a\u20dd", "año", "plain", "", None, *("".join(letters[i : i + 64]) for i in range(0, len(letters), 64))]
    strip = lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))
    rows = spark.createDataFrame(list(enumerate(texts + letters[:12000])), "i int, x string").select("i", t.strip_accents(F.col("x")).alias("y")).collect()
    assert {r.i: r.y for r in rows} == dict(enumerate(map(strip, texts + letters[:12000])))
    assert sorted(one(spark, "Dvořák přišel, ﬁnale", t.salient_tokens)) == ["dvorak", "finale", "prisel"]


@pytest.mark.parametrize("text, want", [("Matrícula 2025-2026, AÑO!", ["matrícula", "2025", "2026", "año"]), ("", []), ("?!", [])])
def test_bm25_tokens(spark, text, want):
    assert one(spark, text, t.bm25_tokens) == want


def test_salient_tokens(spark):
    assert sorted(one(spark, "El examen de Cálculo [1] es a las 9:30 en el aula 3", t.salient_tokens)) == ["3", "9", "aula", "calculo", "examen"]


def test_token_length(spark):
    assert [one(spark, x, t.token_length) for x in ("", "abc", "a" * 9)] == [1, 1, 2]


def test_markdown_lists(spark):
    assert one(spark, "Hay * uno * dos\n-\nfin: - tres", t.markdown_lists) == "Hay\n- uno\n- dos\nfin:\n- tres"


def test_citations(spark):
    assert one(spark, "a [2] b [1][2] [x]", t.markers) == [1, 2]
    assert one(spark, "a [1] [9] , b [5.1-3].", lambda c: t.without_markers(c, F.array(F.lit(9)))) == "a [1], b."


def test_sanitise_history(spark):
    assert one(spark, f"Es el lunes [1] . {fixed.CLOSINGS[0]}\n---\nFuentes", t.sanitise_history) == "Es el lunes."


@pytest.mark.parametrize(
    "text, want",
    [
        ("No dispongo de información. ¿Algo más?", fixed.ABSTENTION),
        ("Tras revisar todo.\nEl plazo es junio.\nEspero que esto ayude", "El plazo es junio."),
        ("Según la información disponible, es en junio", "Es en junio"),
        ("La respuesta es: http://x.es", "http://x.es"),
        ("Espero que esto ayude", "Espero que esto ayude"),
    ],
)
def test_clean_answer(spark, text, want):
    assert one(spark, text, t.clean_answer) == want


def test_detectors(spark):
    assert one(spark, "Lo siento, no hay datos", t.is_abstention) and not one(spark, "No hay clase el viernes", t.is_abstention)
    assert one(spark, "Pues no se menciona nada", t.is_no_info) and one(spark, "No puedo recomendar", t.is_decline) and one(spark, "¿QUIÉN ERES?", t.is_meta)


def test_markdown_table(spark):
    rows = F.expr("array(array('Asig', 'Tipo'), array('Calculo'), array(' ', ''))")
    assert spark.range(1).select(t.markdown_table(rows).alias("y")).first().y == "| Asig | Tipo |\n| --- | --- |\n| Calculo |  |"


def test_timetable_record(spark):
    line = "4º Grado en Ingeniería Informática (Computación), 2º cuatrimestre — Lunes 11:30-12:30: Derecho Informático (DI), aula 1.4."
    r = one(spark, line, records.timetable)
    assert (r.curso, r.cuatrimestre, r.dia, r.hora, r.aula, r.siglas, r.is_summary, r.grupo) == (4, 2, "Lunes", "11:30-12:30", "1.4", ["DI"], False, None)
    assert one(spark, "Asignaturas de 3º A: Redes (FR)", records.timetable).is_summary
    assert one(spark, "Primer curso | Asignaturas: ALEM", records.timetable).is_summary


def test_calendar_and_plan_records(spark):
    assert one(spark, "TFG | Defensa: 3 de julio", records.calendar).evento == "Defensa"
    r = one(spark, "Tercer curso, especialidad Sistemas (CSI): Aprendizaje (AA), Modelos (MCA)", records.study_plan)
    assert (r.curso, r.especialidad, r.siglas, r.is_summary) == (3, "CSI", ["CSI", "AA", "MCA"], True)


@pytest.mark.parametrize(
    "line, want",
    [
        ("Lunes 9:30-10:30, Lunes 10:30-11:30, Lunes 11:30-12:30", "Lunes 9:30-12:30"),
        ("Martes 8:30-9:30 (aula 1.1), Martes 9:30-10:30 (aula 1.1)", "Martes 8:30-10:30 (aula 1.1)"),
        ("Martes 8:30-9:30 (aula 1.1), Martes 9:30-10:30 (aula 1.2)", "Martes 8:30-9:30 (aula 1.1), Martes 9:30-10:30 (aula 1.2)"),
        ("Lunes 9:30-10:30, Lunes 11:30-12:30", "Lunes 9:30-10:30, Lunes 11:30-12:30"),
        ("a, Lunes 9:30-10:30 (aula 1), Lunes 10:30-11:30, Lunes 11:30-12:30 (aula 1), Martes 12:30-13:30.", "a, Lunes 9:30-12:30 (aula 1), Martes 12:30-13:30."),
        ("", ""),
        (None, None),
    ],
)
def test_merged_slots(spark, line, want):
    assert one(spark, line, records.merged_slots) == want


@pytest.mark.parametrize("q, want", [("clases de DI", "clases de DI (Derecho Informático)"), ("en qué aula es Cálculo", "en qué aula es Cálculo (CA)"), ("aula de DI?", "aula de DI (Derecho Informático)?"), ("hola", "hola")])
def test_expansion(spark, q, want):
    assert one(spark, q, intent.expanded) == want


def test_routes_take_the_largest_boost(spark):
    r = one(spark, "¿Cuándo es la defensa del TFG?", intent.routes)
    assert r.rules == ["tfg", "calendario"] and r.categories == {"tfg": 2.5, "normativa": 1.3, "calendario": 2.0, "tramites": 1.2}
    assert one(spark, "horario de la secretaría", intent.routes).rules == ["tramites"]
    assert one(spark, "hola", intent.routes).categories == {}


def test_intents(spark):
    assert one(spark, "¿Qué asignaturas hay?", intent.is_listing) and not one(spark, "¿Cuándo es el examen?", intent.is_listing)
    assert [one(spark, q, intent.wanted_type) for q in ("horario de IA", "examen de IA", "horario del examen", "hola")] == ["horario", "calendario", None, None]
    assert [one(spark, q, intent.course) for q in ("tercero", "en 2º", "hola")] == [3, 2, None]


def test_entities_and_followups(spark):
    e = one(spark, "prácticas del grupo 1º D, subgrupo A2", intent.entities)
    assert (e.tipo, e.grupo, e.subgrupo, e.subject) == ("prácticas", "grupo 1ºD", "subgrupo A2", None)
    follow = lambda c: intent.is_followup(c, intent.entities(c))
    assert one(spark, "Y Cálculo?", follow) and one(spark, "el grupo B", follow) and not one(spark, "clases de Cálculo del grupo B", follow)


def test_composed_texts_do_not_go_to_python(spark, monkeypatch):
    """Python gets only texts that NFC may change; the others aren't sent to it, though it evaluates every row."""
    import pandas as pd

    from ragframe.functions import text as t

    @F.pandas_udf("string")
    def counting(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else f"python {v}")

    texts = ["", None, "ascii", "ñandú – çà et là… 5 €\n", "n\u0303", "\u1e9b\u0323", "한"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    assert [r.y for r in rows.select("i", t.normalised(F.col("x")).alias("y")).orderBy("i").collect()] == ["", None, "ascii", texts[3], "ñ", unicodedata.normalize("NFC", texts[5]), "한"]
    monkeypatch.setattr(t, "nfc", counting)
    assert [(r.y or "").startswith("python ") for r in rows.select("i", t.normalised(F.col("x")).alias("y")).orderBy("i").collect()] == [False] * 4 + [True] * 3


def test_composed_characters_are_left_by_nfc():
    from ragframe.functions import text as t

    held = [chr(c) for a, b in t.COMPOSED for c in range(a, b + 1)]
    assert all(unicodedata.is_normalized("NFC", x) and not unicodedata.combining(x) for x in held)
    for c in map(chr, (*range(0x300, 0xD800), *range(0xE000, 0x110000))):  # what joins with the one before isn't among them
        parts = unicodedata.normalize("NFD", c)
        assert not (len(parts) > 1 and unicodedata.normalize("NFC", parts) == c and parts[-1] in held)
