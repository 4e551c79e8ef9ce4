"""The reranker's seam, metadata as VARIANT, the context cache and observed writes."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from ragframe import seams
from ragframe.operators import retrieve
from ragframe.sources import context_cache, metadata, store


def test_model_is_loaded_once_in_a_worker_and_asked_in_batches(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        with open(f"{folder}/load-{os.getpid()}", "a") as f:
            f.write("x")

        def score(pairs):
            with open(f"{folder}/calls-{os.getpid()}", "a") as f:
                f.write(f"{len(pairs)}\n")
            return [len(t) for _, t in pairs]

        return score

    model = seams.Reranker(f"counted {folder}", load)
    for _ in range(2):
        rows = spark.range(200, numPartitions=4).select("id", seams.rerank(F.lit("q"), F.repeat(F.lit("a"), F.col("id").cast("int")), [model]).alias("r"))
        assert sorted((r.id, r.score, r.error) for r in rows.select("id", "r.*").collect()) == [(i, float(i), None) for i in range(200)]
    loads = glob.glob(f"{folder}/load-*")
    assert loads and all(open(f).read() == "x" for f in loads)
    sizes = [int(n) for f in glob.glob(f"{folder}/calls-*") for n in open(f).read().split()]
    assert max(sizes) == 32 and sum(sizes) == 400


def test_fallback_is_told_apart_and_failures_stay_with_their_pair(spark):
    def first():
        def score(pairs):
            if any("x" in t for _, t in pairs):
                raise ValueError("x")
            return [1.0 for _ in pairs]

        return score

    def second():
        def score(pairs):
            if any(t == "xx" for _, t in pairs):
                return [float("nan")] * len(pairs)
            return [2.0 for _ in pairs]

        return score

    models = [seams.Reranker("first of a test", first), seams.Reranker("second of a test", second)]
    rows = spark.createDataFrame([("a",), ("x",), ("xx",), (None,)], "t string").coalesce(1)
    got = {r.t: tuple(r.r) for r in rows.select("t", seams.rerank(F.lit("q"), F.col("t"), models).alias("r")).collect()}
    assert got["a"] == got[None] == (1.0, "first of a test", None)
    assert got["x"] == (2.0, "second of a test", "first of a test: x; ")
    assert got["xx"] == (None, None, "first of a test: x; second of a test: no score; ")
    assert rows.limit(0).select(seams.rerank(F.lit("q"), F.col("t"), models)).collect() == []


@pytest.mark.parametrize("fails, ranked", [("nothing", [2, 1]), ("some", [1, 2]), ("all", [2, 1])])
def test_scores_of_two_models_are_not_mixed(spark, fails, ranked):
    """Where only some of a query's texts are scored by the fallback, the former scores stay."""

    def first():
        def score(pairs):
            if fails == "all" or (fails == "some" and any(t == "uno" for _, t in pairs)):
                raise ValueError
            return [5.0 if t == "dos" else 1.0 for _, t in pairs]

        return score

    second = lambda: lambda pairs: [7.0 if t == "dos" else 6.0 for _, t in pairs]
    chunk = "chunk_id long, text string, title string, source_url string, position int, category string, tipo string, siglas array<string>, is_summary boolean, curso int, vector array<float>"
    chunks = spark.createDataFrame([(1, "uno", "", "u1", 0, None, None, None, False, None, [1.0, 0.0]), (2, "dos", "", "u2", 0, None, None, None, False, None, [0.9, 0.1])], chunk)
    asked = spark.createDataFrame([(5, "hola", [1.0, 0.0])], "query_id long, text string, vector array<float>")
    models = [seams.Reranker(f"first {fails}", first), seams.Reranker("second", second)]
    rows = retrieve.retrieve(asked, chunks, retrieve.Config(hybrid=False, mmr_weight=1.0, reranker=models)).orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == ranked


def test_metadata_overrides_nothing_and_bad_json_is_empty(spark):
    cases = [(1, '{"id": 9, "a": {"b": [1, 2]}, "s": "x"}'), (2, None), (3, "bad{"), (4, "[1]"), (5, "{}"), (6, '{"a": 1, "a": 2}')]
    rows = metadata.with_extras(spark.createDataFrame(cases, "id int, m string"), "m")
    got = {r.id: (r.j, r.b) for r in rows.select("id", F.to_json("extras").alias("j"), metadata.field(F.col("extras"), "$.a.b[1]", "int").alias("b")).collect()}
    assert got == {1: ('{"a":{"b":[1,2]},"s":"x"}', 2)} | {i: ("{}", None) for i in range(2, 7)}
    same = metadata.with_extras(spark.createDataFrame(cases, "id int, extras string"), "extras")
    assert same.columns == ["id", "extras"] and same.filter("id = 1").select(F.to_json("extras")).first()[0] == got[1][0]


def test_cache_asks_once_and_a_broken_file_costs_its_keys_only(spark, tmp_path):
    path = str(tmp_path / "cache")
    chunks = spark.createDataFrame([(str(i), f"u{i % 3}", f"text {i % 20}" if i != 7 else None) for i in range(40)], "chunk_id string, source_url string, text string")
    docs = spark.createDataFrame([(f"u{i}", "whole", "t") for i in range(3)], "url string, text string, title string")
    run = lambda name: {r.chunk_id: r.text for r in context_cache.contextualised(chunks, docs, path, lambda w, t: f"{name} {w}", buckets=4).collect()}
    one = run("one")
    assert one["1"] == "one whole\n\ntext 1" and one["7"] is None and run("two") == one
    for broken in glob.glob(f"{path}/bucket=1/*.parquet"):
        with open(broken, "wb") as f:
            f.write(b"broken")
        os.remove(os.path.join(os.path.dirname(broken), f".{os.path.basename(broken)}.crc"))
    lost = {k for k, v in run("three").items() if v and v.startswith("three")}
    in_bucket = {r.chunk_id for r in chunks.filter(context_cache.bucket(store.content_hash(F.col("text"), 24), 4) == 1).collect()}
    assert lost == in_bucket and 0 < len(lost) < 39
    assert run("four") == run("five")  # the bucket was healed
    assert context_cache.read(spark, path).count() == 20


def test_observed_write_scans_once(spark, tmp_path):
    rows = spark.range(100).withColumn("v", F.when(F.col("id") % 10 > 0, F.col("id")))
    seen = store.observed_write(rows, F.col("v") > 50, str(tmp_path / "out"), {"low": F.col("v") <= 50, "none": F.col("v").isNull()})
    assert (seen["rows"], seen["low"], seen["none"]) == (100, 45, 10) and seen["rows_per_second"] > 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 45
    empty = store.observed_write(rows.limit(0), F.lit(True), str(tmp_path / "none"), {"low": F.col("v") <= 50})
    assert (empty["rows"], empty["low"]) == (0, 0)


def test_a_model_is_asked_once_for_each_text(spark, tmp_path):
    """A filter on what a model says doesn't ask it again."""
    folder = str(tmp_path)

    def model(whole, text):
        with open(f"{folder}/asked-{os.getpid()}", "a") as f:
            f.write(f"{text}\n")
        return None if text == "t3" else f"said {text}"

    texts = spark.range(40).select(F.col("id").alias("chunk_id"), F.lit("u").alias("source_url"), F.concat(F.lit("t"), "id").alias("text"))
    documents = spark.createDataFrame([("u", "whole", "")], "url string, text string, title string")
    cache = spark.createDataFrame([], "key string, context string")
    got = store.fresh_contexts(texts, documents, cache, model).collect()
    assert sorted(r.context for r in got) == sorted(f"said t{i}" for i in range(40) if i != 3)
    assert sorted(t for f in glob.glob(f"{folder}/asked-*") for t in open(f).read().split()) == sorted(f"t{i}" for i in range(40))


def test_texts_become_strings_in_pieces():
    """A worker holds some TEXT_BYTES of a batch's texts as Python's strings; nulls are empty, no row is lost."""
    import pyarrow as pa

    texts = ["x" * 50_000] * 20 + [None, ""] + ["y"] * 70
    got = list(seams.pieces([pa.array(texts), pa.array(["q"] * len(texts))], 32))
    assert [row for rows in got for row in rows] == [(t or "", "q") for t in texts]
    assert max(len(rows) for rows in got) == 32
    assert all(sum(len(t) + 1 for t, _ in rows[:-1]) < seams.TEXT_BYTES for rows in got)
