"""The lexical index that grows: equal to one made at once, repeats are harmless, broken appends are invisible, searches prune."""

import pytest
from pyspark.sql import functions as F

from ragframe.operators.search import bm25_index, bm25_search, counted_terms
from ragframe.sources import lexical_store as ls

TEXTS = ["normativa de permanencia", "trabajo fin de grado normativa del grado", "clases de IC", "horario de clases", "", None, "de de de de", "guía docente 2025-2026", "secretaría"]
Q = [(1, "normativa del grado"), (2, "clases"), (3, "nada que ver"), (4, ""), (5, "de")]


def docs_of(spark, numbers):
    return spark.createDataFrame([(i, TEXTS[i % len(TEXTS)], "x") for i in numbers], "doc_id long, text string, term string")


def terms(index):
    return {(r.term, r.df, round(r.idf, 9)) for r in index.terms.collect()}


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_batches_add_up(spark, tmp_path):
    path, queries = str(tmp_path / "i"), spark.createDataFrame(Q, "q long, text string")
    ls.append(docs_of(spark, range(5)), "doc_id", F.col("text"), path, "a")
    ls.append(docs_of(spark, [3, 4, 5, 6, 6, 7]), "doc_id", F.col("text"), path, "b")  # some are there, one comes twice
    ls.append(docs_of(spark, [3, 4, 5, 6, 6, 7]), "doc_id", F.col("text"), path, "b")
    ls.append(docs_of(spark, [8, 9, 10]).union(spark.createDataFrame([(None, "sin id", "x")], "doc_id long, text string, term string")), "doc_id", F.col("text"), path, "c")
    whole = bm25_index(docs_of(spark, range(11)).fillna({"text": ""}), "doc_id", F.col("text"))
    grown = ls.load(spark, path)
    assert terms(grown) == terms(whole)
    assert grown.totals.first().n == 11 and abs(grown.totals.first().avgdl - whole.totals.first().avgdl) < 1e-12
    assert found(ls.search(path, queries, "q", F.col("text"), 4)) == found(bm25_search(whole, queries, "q", F.col("text"), 4))


def test_an_append_that_breaks_off_is_invisible(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "i")
    ls.append(docs_of(spark, range(4)), "doc_id", F.col("text"), path, "a")
    before = terms(ls.load(spark, path))
    real = ls.bucket
    calls = []

    def breaking(term):
        calls.append(1)
        return F.when(F.raise_error(F.lit("lost")).isNull(), real(term))

    monkeypatch.setattr(ls, "bucket", breaking)
    with pytest.raises(Exception, match="lost"):
        ls.append(docs_of(spark, range(4, 9)), "doc_id", F.col("text"), path, "b")
    monkeypatch.setattr(ls, "bucket", real)
    assert calls and terms(ls.load(spark, path)) == before
    ls.append(docs_of(spark, range(4, 9)), "doc_id", F.col("text"), path, "b")
    assert terms(ls.load(spark, path)) == terms(bm25_index(docs_of(spark, range(9)).fillna({"text": ""}), "doc_id", F.col("text")))


def test_a_search_reads_the_buckets_of_its_terms(spark, tmp_path):
    path = str(tmp_path / "i")
    ls.append(docs_of(spark, range(9)), "doc_id", F.col("text"), path, "a")
    plan = ls.search(path, spark.createDataFrame([(1, "normativa")], "q long, text string"), "q", F.col("text"), 3)._jdf.queryExecution().executedPlan().toString()
    own = spark.range(1).select(ls.bucket(F.lit("normativa")).alias("b")).first().b
    assert f"(bucket#" in plan and f"= {own})" in plan and "PartitionFilters" in plan


def test_empty_batches_and_bad_names(spark, tmp_path):
    path = str(tmp_path / "i")
    ls.append(docs_of(spark, []), "doc_id", F.col("text"), path, "a")
    assert ls.load(spark, path).terms.count() == 0
    ls.append(docs_of(spark, [0]), "doc_id", F.col("text"), path, "b")
    assert {r.term for r in ls.load(spark, path).terms.collect()} == {"normativa", "de", "permanencia"}
    with pytest.raises(ValueError):
        ls.append(docs_of(spark, [0]), "doc_id", F.col("text"), path, "../b")


def test_what_a_task_sorts_does_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    """Whatever spark.sql.shuffle.partitions says; and texts of one key that stand in several partitions count once."""
    monkeypatch.setattr(ls, "TASK_POSTINGS", 200, raising=False)
    path, limit = str(tmp_path / "i"), "spark.sql.shuffle.partitions"
    words = F.concat_ws(" ", F.array([F.concat(F.lit(f"w{i}x"), (F.col("id") % 7).cast("string")) for i in range(40)]))
    docs = spark.range(0, 1000, 1, 4).select(F.col("id").alias("doc_id"), words.alias("text"))
    before = spark.conf.get(limit)
    spark.conf.set(limit, "1")
    try:
        ls.append(docs.union(docs.filter("doc_id % 3 = 0")), "doc_id", F.col("text"), path, "a")
    finally:
        spark.conf.set(limit, before)
    assert ls.load(spark, path).totals.first().n == 1000
    sizes = [r["count"] for r in spark.read.parquet(f"{path}/postings").groupBy(F.input_file_name().alias("f")).count().collect()]
    assert sum(sizes) == 40_000 and max(sizes) <= 600


def test_rows_of_a_slice_ascend_by_term(spark):
    """So a sort by term finds runs, and a term's rows stand together when they are counted."""
    docs = spark.createDataFrame([(i, "zeta beta alfa b" if i % 2 else "gamma ñu beta alfa alfa") for i in range(20)], "doc_id long, text string").coalesce(1)
    got = [tuple(r) for r in counted_terms(docs, "doc_id", F.col("text")).collect()]
    assert got == sorted(got, key=lambda r: (r[0] is None, (r[0] or "").encode(), r[1]))
    assert len(got) == 20 * 4 + 20 and (("alfa", 0, 2, 5) in got) and ((None, 1, 0, 4) in got)
