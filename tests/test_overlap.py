"""The overlap join against brute force: rare and hot tokens, several ways of one query, edge cases."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ragframe.functions import fixed
from ragframe.functions.text import salient_tokens
from ragframe.operators import overlap
from ragframe.plans import catalogue
from ragframe.sources import store

from .conftest import SF


def brute(asked, held, share, least):
    out = set()
    for q, a in asked:
        for d, b in held:
            shared = len(set(a or ()) & set(b or ()))
            if shared >= least and round(shared / len(a), 6) >= share:
                out.add((q, d, shared, round(shared / len(a), 6)))
    return out


def sets(rng, n, words, most):
    """Sets of words, low numbers far oftener than others."""
    return [(i, sorted({f"w{int(x)}" for x in words * rng.random(int(rng.integers(0, most))) ** 3})) for i in range(n)]


def joined(spark, asked, held, share, least, hot):
    a, b = spark.createDataFrame(asked, "query_id long, tokens array<string>"), spark.createDataFrame(held, "doc_id string, tokens array<string>")
    return [tuple(r) for r in overlap.overlap_join(a, b, share, least, lambda d: store.materialised(d, "t"), hot).collect()]


@pytest.mark.parametrize("hot", [0.01, 0.2, 1.0])
@pytest.mark.parametrize("share,least", [(0.3, 3), (0.85, 1)])
def test_overlap_join_is_exact(spark, monkeypatch, share, least, hot):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(overlap, "ASKED_BLOCK", 7)
    monkeypatch.setattr(overlap, "HELD_BLOCK", 16)
    asked, held = sets(rng, 40, 60, 14) + [(100, None), (101, [])], [(f"d{i}", t) for i, t in sets(rng, 120, 60, 30)] + [("n", None), ("e", [])]
    held += [(f"copy{i}", held[0][1]) for i in range(5)]
    got = joined(spark, asked, held, share, least, hot)
    assert len(got) == len(set(got)) and set(got) == brute(asked, held, share, least)


def test_hot_tokens_are_never_joined(spark):
    held = spark.createDataFrame([(f"d{i}", ["the", "of", "and", f"r{i}", f"s{i % 10}"]) for i in range(100)], "doc_id string, tokens array<string>")
    asked = spark.createDataFrame([(1, ["the", "of", "and", "r5", "s5", "zz"]), (2, ["the", "of", "and", "r7", "s1", "s2", "s3", "s4", "q", "r", "t", "u"]), (3, ["the", "of", "and"])], "query_id long, tokens array<string>")
    rows = {r.query_id: r for r in overlap.prefixes(asked, held, 0.5, 3, hot=0.2).collect()}
    hot = {"the", "of", "and"}
    assert not any(hot & set(r.tested) for r in rows.values())
    assert (rows[1].alone, rows[2].alone, rows[3].alone) == (True, False, True)
    assert len(rows[2].tested) == 9 - (6 - 3) + 1  # of nine others three must be shared


def test_no_rows(spark):
    assert joined(spark, [(1, ["a", "b", "c"])], [], 0.3, 3, 0.1) == joined(spark, [], [("d", ["a"])], 0.3, 1, 0.1) == []


def test_more_tokens_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(overlap, "MOST_BROADCAST_TERMS", 3)
    rng = np.random.default_rng(8)
    asked, held = sets(rng, 20, 40, 10), [(f"d{i}", t) for i, t in sets(rng, 60, 40, 20)]
    assert set(joined(spark, asked, held, 0.3, 2, 0.3)) == brute(asked, held, 0.3, 2)


def test_the_plan_joins_tested_tokens_only(spark):
    """Rows of the exploded side meet queries on tested tokens; no plan pairs queries with rows but in blocks."""
    a = spark.createDataFrame([(1, ["a", "b", "c", "d"])], "query_id long, tokens array<string>")
    b = spark.createDataFrame([("x", ["a", "b", "c"])], "doc_id string, tokens array<string>").withColumn("tokens", F.col("tokens"))
    plan = overlap.overlap_join(a, b, 0.3, 3, lambda d: store.materialised(d, "t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Cross") == 1 and "h_tokens" in plan


ODD = [
    None, "", "  \n", "El [12] de 10:30 a 9:15:45, 123:45:67 y [3", "Canción del niño, CAMIÓN ÑANDÚ İstanbul \u212aelvin ΟΔΟΣ", "cancio\u0301n n\u0303u e\u0301\u0323s", "ﬁnal ½ kg … ㎒ 𝐌𝐚𝐫 ①② １２:３４ ［5］", "a1 b2 77 8 x9y 0",
    "uno\ndos\rtres\x1ccuatro\x00cinco", "12", ":30", "[1", "2]", "12:", "34 la horas", "x" * 3000, "中文 abc中def 가나 ghi",
]


def test_runs_are_the_salient_tokens(spark):
    """Cut in Python, texts have the tokens that the JVM's expressions find, whatever each character becomes; neighbours don't meet."""
    codes, kept, several = overlap.folding()
    texts = ODD + [f"ab{c}cd 1{c}2:34 [5{c}] {c}" for c in map(chr, (*codes[1:], *range(0x250), 0x4E00, 0xAC00, 0x1F600))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", salient_tokens(F.col("text")).alias("t")).collect()
    at, runs = overlap.token_runs(pa.array(texts), overlap.fold_table(codes, kept), several)
    got = [set() for _ in texts]
    for i, x in zip(at, runs.to_pylist(), strict=True):
        if x not in fixed.STOPWORDS and (len(x) >= 3 or x.isdigit()):
            got[i].add(x)
    assert got == [set(r.t or ()) for r in sorted(rows)]


@pytest.mark.parametrize("most,at_once", [(200_000, 1 << 20), (200_000, 1), (3, 1)])
@pytest.mark.parametrize("share,least", [(0.3, 3), (0.85, 1)])
def test_overlap_texts_is_exact(spark, monkeypatch, share, least, most, at_once):
    monkeypatch.setattr(overlap, "MOST_BROADCAST_TERMS", most)
    monkeypatch.setattr(overlap, "COUNTED_PAIRS", at_once)
    rng = np.random.default_rng(5)
    word = lambda x: f"{x}00"
    asked, held = sets(rng, 40, 60, 14) + [(100, None), (101, [])], sets(rng, 120, 60, 30) + [(500, None), (501, [])]
    asked, held = ([(i, None if t is None else [word(x) for x in t]) for i, t in rows] for rows in (asked, held))
    a = spark.createDataFrame(asked, "query_id long, tokens array<string>")
    b = spark.createDataFrame([(i, None if t is None else ", ".join(t + t[:3]).upper(), f"s{i % 3}") for i, t in held], "doc_id long, text string, source string")
    got = [tuple(r) for r in overlap.overlap_texts(a, b, "text", share, least, lambda d: store.materialised(d, "t")).select("query_id", "doc_id", "source", "shared", "score").collect()]
    assert len(got) == len(set(got)) and set(got) == {(q, d, f"s{d % 3}", *rest) for q, d, *rest in brute(asked, held, share, least)}


def test_texts_meet_queries_where_they_lie(spark, monkeypatch):
    """Only the queries are written; texts are neither written, nor joined, nor shuffled."""
    written, keep = [], store.materialised
    monkeypatch.setattr(store, "materialised", lambda d, name: written.append(d.columns) or keep(d, name))
    plans = [catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString() for name in ("answer_coverage", "recover_sources_best")]
    assert written == [["query_id", "tokens"]] * 2
    assert not any("Join" in p for p in plans) and [p.count("Exchange hash") for p in plans] == [0, 2]


def test_odd_documents_have_the_rows_of_sql(spark, tmp_path):
    """Null and empty texts, a source without a name that ties with another, marks and times."""
    asked = [(1, "canción del niño a las 10:30 en el aula 7"), (2, None), (3, ""), (4, "uno dos"), (5, "Ñandú camión perro gato")]
    held = [(1, "Canción, NIÑO; aula [3] 10:45 7", None), (2, "cancion nino 7 aula 10", "es"), (3, None, "es"), (4, "", None), (5, "nandu perro gato", None), (6, "gato camion perro", "fr"), (7, "camión ñandú perro gato", "de")]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(held, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    sql = duckdb.connect()
    for name in ("benchmark", "documents"):
        sql.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    for name in ("answer_coverage", "recover_sources_best"):
        got = catalogue.QUERIES[name](spark, str(tmp_path))
        expected = sql.execute(f"SELECT {', '.join(got.columns)} FROM ({catalogue.ORACLE[name]})").fetchall()
        assert len(expected) > 3 and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected))
