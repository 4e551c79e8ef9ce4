"""The cascade over typed chunks: every step changes rows, and the rules say what the SQL takes for granted."""

import duckdb
import pytest

from ragframe.operators import retrieve
from ragframe.plans.search_queries import TYPED_QUESTIONS, retrieval_typed, typed_sql
from ragframe.sources import store

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    return c


def test_rules_say_what_the_sql_says(spark):
    rows = retrieve.understood(spark.createDataFrame([(i, q, None) for i, (q, *_) in enumerate(TYPED_QUESTIONS)], "query_id int, text string, vector array<float>")).collect()
    got = {r.query_id: (r.text, r.listing, r.about_subjects, r.wanted, tuple(r.subjects), r.course, dict(r.route.categories)) for r in rows}
    assert got == dict(enumerate(TYPED_QUESTIONS))


def test_same_rows_as_sql_at_the_larger_size(spark, duck):
    names = ["query_id", "rank", "chunk_id"]
    assert sorted(map(tuple, retrieval_typed(spark, SF).select(*names).collect())) == sorted(duck.sql(f"SELECT {', '.join(names)} FROM ({typed_sql()})").fetchall())


@pytest.mark.parametrize("off", ["routes", "structured", "subjects", "types", "summaries"])
def test_every_step_changes_rows(duck, off):
    assert sorted(duck.sql(typed_sql(off)).fetchall()) != sorted(duck.sql(typed_sql()).fetchall())


def test_no_join_goes_through_the_driver(spark, monkeypatch):
    """Queries, chunks and candidates grow with the table, and so would the driver's memory if a join broadcast them."""
    written = []

    def keep(rows, name="rows", write=store.materialised):
        written.append(rows)
        return write(rows, name)

    monkeypatch.setattr(store, "materialised", keep)
    hits = retrieval_typed(spark, SF)
    assert hits.count() and len(written) == 4
    plans = [rows._jdf.queryExecution().executedPlan().toString() for rows in (*written, hits)]
    assert sum(plan.count("SortMergeJoin") for plan in plans) >= 15
    assert not [plan for plan in plans if "BroadcastHashJoin" in plan]
