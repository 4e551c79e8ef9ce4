"""The exact search in blocks: a bounded product at a time, ties by id, equal queries asked once, a summary table of any size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragframe.operators import search


@pytest.mark.parametrize("digits", [6, 9])
def test_nearest_rows_are_those_of_a_whole_sort(digits):
    rng = np.random.default_rng(3)
    asked, rows, ids = rng.integers(-2, 3, (9, 4)) / 3, rng.integers(-2, 3, (300, 4)) / 3, np.arange(300) * 2
    query, row, score = search.nearest_rows(asked, rows, ids, 7, ids[:9], digits)
    for q in range(9):
        whole = np.zeros(300)
        for d in range(4):
            whole += asked[q, d] * rows[:, d]
        whole = np.round(whole, 6) if digits == 6 else whole
        order = [r for r in np.lexsort((ids, -whole, -np.round(whole, 9))) if r != q][:7]
        assert row[query == q].tolist() == order and np.array_equal(score[query == q], whole[order])


def test_equal_queries_are_asked_once(spark, monkeypatch):
    held = spark.createDataFrame([(i, [float(i % 7), 1.0], "ab"[i % 2]) for i in range(60)], "id long, v array<double>, c string")
    asked = spark.createDataFrame([(q, [1.0, float(q % 2)], c) for q in range(8) for c in ("a", "b")], "id long, v array<double>, c string")
    got = search.knn(held, "id", "v", asked, 4, by="c").collect()
    assert len(got) == 32 and all([(r.id, r.score) for r in sorted((r for r in got if r.query == q), key=lambda r: r.rank)] == [(i, 6.0 + q % 2) for i in (6, 13, 20, 27)] for q in range(8))
    sizes = []
    real = search._blocks
    monkeypatch.setattr(search, "_blocks", lambda rows, by, size, prefix: sizes.append((prefix, rows.count())) or real(rows, by, size, prefix))
    search.knn(held, "id", "v", asked, 4, by="c")
    assert dict(sizes)["q"] == 4


def test_the_best_alone_need_no_groups_in_python(spark):
    rows = spark.range(500).select(F.lit(1).alias("query"), "id", (F.col("id") % 50 / 7).alias("score"), F.array(F.lit(1.0)).alias("vector"))
    best = search.mmr(rows, 3, 1.0)
    assert [tuple(r) for r in best.orderBy("rank").collect()] == [(1, i, 7.0, j + 1) for j, i in enumerate((49, 99, 149))]
    assert "InPandas" not in best._jdf.queryExecution().executedPlan().toString()
