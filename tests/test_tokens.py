"""Counting terms in Arrow: the tokens of bm25_tokens, in slices whose size doesn't depend on the batch."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ragframe.functions.text import bm25_tokens
from ragframe.operators import search

TEXTS = ["Ñandú café-crème 2025", "", None, "ÁÉÍÓÚÜÑ áéíóúüñ", "naïve ß Ã© xÃy", "日本 a1́b İstanbul ÇA", "ends in ñ", "á starts", "-", "a b a b a"] * 3


@pytest.mark.parametrize("size", [1, 20, 1 << 20])
def test_counted_terms_are_those_of_the_expression(spark, monkeypatch, size):
    monkeypatch.setattr(search, "COUNTED_BYTES", size)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1)
    rows = docs.mapInArrow(lambda batches: batches, docs.schema).select(F.col("doc_id").alias("id"), F.lower("text").alias("text")).toArrow().combine_chunks().to_batches()
    schema = pa.schema([("term", pa.string()), ("id", pa.int64()), ("tf", pa.int64()), ("dl", pa.int32())])
    got = [tuple(r.values()) for b in search._count_terms(schema)(rows) for r in b.to_pylist()]
    want = []
    for i, tokens in docs.select("doc_id", bm25_tokens(F.col("text"))).collect():
        tokens = tokens or []
        want += [(None, i, 0, len(tokens))] + [(t, i, tokens.count(t), len(tokens)) for t in set(tokens)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_a_large_batch_is_counted_in_slices():
    texts = pa.array(["palabra otra " * 1000] * 400)  # 5 MB in one batch
    schema = pa.schema([("term", pa.string()), ("id", pa.int64()), ("tf", pa.int64()), ("dl", pa.int32())])
    sizes = [b.num_rows for b in search._count_terms(schema)([pa.RecordBatch.from_arrays([pa.array(range(400)), texts], ["id", "text"])])]
    assert sum(sizes) == 1200 and max(sizes) <= 3 * (search.COUNTED_BYTES // 13_000 + 1)


def test_hits_are_shared_by_document(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"uno dos tres w{i}") for i in range(60)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "uno w3 w4"), (2, "dos w5")], "q long, text string")

    def find():
        index = search.bm25_index(docs, "doc_id", F.col("text"))
        index.apart = True
        return search.bm25_search(index, asked, "q", F.col("text"), 5)

    whole = sorted(map(tuple, find().collect()))
    monkeypatch.setattr(search, "TASK_HITS", 10)
    plan = find()
    assert sorted(map(tuple, plan.collect())) == whole and len(whole) > 3
    assert "hashpartitioning(id" in plan._jdf.queryExecution().executedPlan().toString()
