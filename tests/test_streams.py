"""Streams with state against the batch forms."""

import pytest
from pyspark.sql import functions as F

from ragframe.operators import dialogue
from ragframe.plans import stream_queries
from ragframe.plans.dialogue_queries import _questions
from ragframe.streaming import conversations

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_enriched_stream_is_the_batch_form(spark):
    turns = _questions(spark, SF).withColumn("role", F.lit("user"))
    want = dialogue.carried(turns)
    got = stream_queries.enriched_stream(spark, SF)
    assert rows(got.select(*want.columns)) == rows(want)
    assert got.filter("enriched <> text").count() > 0


def test_session_is_left_as_it_was(spark):
    settings = lambda: {name: spark.conf.get(name, None) for name in conversations._SETTINGS}
    before = settings()
    stream_queries.entity_carry_stream(spark, SF)
    assert settings() == before


@pytest.mark.parametrize("lookback", [1, 2])
def test_state_goes_on_in_another_query(spark, tmp_path, lookback):
    """Each turn a run of its own: what a run knows of earlier turns is its state alone."""
    names = ["a", None, None, "b", None]
    step = lambda: conversations.last_named(spark.readStream.schema("c string, turn long, v string").parquet(str(tmp_path / "in")), "c", ("v",), lookback)
    for turn, name in enumerate(names):
        spark.createDataFrame([(c, turn, name) for c in ("x", None)] + [("y", turn, None)], "c string, turn long, v string").write.mode("append").parquet(str(tmp_path / "in"))
        conversations.started(step(), str(tmp_path)).awaitTermination()
    last = lambda i: next((n for n in reversed(names[max(0, i - lookback) : i]) if n), None)
    want = [(c, i, n, last(i)) for i, n in enumerate(names) for c in ("x", None)] + [("y", i, None, None) for i in range(len(names))]
    assert rows(spark.read.parquet(str(tmp_path / "rows"))) == sorted(want, key=str)


def test_idle_conversations_are_forgotten(spark, tmp_path):
    step = lambda: conversations.last_named(spark.readStream.schema("c string, turn long, v string").parquet(str(tmp_path / "in")), "c", ("v",), 6, idle=1)
    for turn, name in enumerate(["a", None]):
        spark.createDataFrame([("x", turn, name)], "c string, turn long, v string").write.mode("append").parquet(str(tmp_path / "in"))
        conversations.started(step(), str(tmp_path)).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "rows"))) == [("x", 0, "a", None), ("x", 1, None, None)]


def test_a_key_costs_few_operations_on_frames(monkeypatch):
    """F8: what a conversation names last is found in plain lists; with frames every conversation joined one more."""
    import pandas as pd

    class State(list):
        get = exists = lambda self: self

        def put(self, rows):
            self[:] = rows

    class Handle:
        getListState = lambda self, *a, **k: State()
        listTimers = lambda self: iter(())
        registerTimer = deleteTimer = lambda self, at: None

    class Now:
        getCurrentProcessingTimeInMs = lambda self: 0

    step = conversations.LastNamed("c", ("v",), {"v": "string"}, 2, 1000)
    step.init(Handle())
    frames = [pd.DataFrame({"c": "x", "turn": [2 * i + 1, 2 * i], "v": [None, f"n{i}"] if i % 2 else [None, None]}) for i in range(4)]
    joined, real = [], pd.concat
    monkeypatch.setattr(pd, "concat", lambda *a, **k: joined.append(1) or real(*a, **k))
    out = [row for x in frames for y in step.handleInputRows(("x",), iter([x]), Now()) for row in y.itertuples(index=False, name=None)]
    assert not joined and [(t, v, last) for _, t, v, last in out] == [(0, None, None), (1, None, None), (2, "n1", None), (3, None, "n1"), (4, None, "n1"), (5, None, None), (6, "n3", None), (7, None, "n3")]
