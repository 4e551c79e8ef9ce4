"""Conversations as a stream, with state for each conversation (survey E14, C20, H32, per-session state).

The batch form, ``operators.dialogue.carried``, is a window over a conversation's user turns. Here the window's
frame, the entities of the last user turns, is what is kept between triggers; it leaves with a conversation
that has been idle. Entities and the enriched text are expressions on both sides of the stateful step.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ragframe.functions import intent
from ragframe.functions.text import stripped
from ragframe.operators.dialogue import ENTITIES

#: The state store that state of this kind needs; no runs without data, which would follow each other for ever where timers are kept.
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


class LastNamed(StatefulProcessor):
    """For each row (turn, values), in turn order: what the last `lookback` rows before it named last, as last_<value>.

    State is one row for each of those last rows. `idle` milliseconds after a conversation's last trigger a timer
    clears it, and its entries have the same time to live, should the timer be late.
    """

    def __init__(self, key: str, values: tuple[str, ...], types: dict[str, str], lookback: int, idle: int) -> None:
        self.key, self.values, self.types, self.lookback, self.idle = key, values, types, lookback, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", ", ".join(f"{v} {self.types[v]}" for v in self.values), ttlDurationMs=self.idle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # one trigger's rows of one conversation: as many as the source admits in a trigger
        frames = list(rows)
        new = frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)
        new = new.sort_values("turn", kind="stable", na_position="first", ignore_index=True)
        # plain lists: there are few rows of a conversation, and every operation on a frame costs more than they do
        old = [tuple(row) for row in self.recent.get()] if self.recent.exists() else []
        both = old + [tuple(None if pd.isna(x) else x for x in row) for row in zip(*[new[v].tolist() for v in self.values], strict=True)]
        for i, v in enumerate(self.values):
            named, last = [], -1
            for place, row in enumerate(both):
                named.append(both[last][i] if 0 <= last and last >= place - self.lookback else None)
                last = place if row[i] is not None else last
            new[f"last_{v}"] = pd.Series(named[len(old) :], dtype=object)
        self.recent.put(both[max(0, len(both) - self.lookback) :])
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        yield new

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.recent.clear()
        return iter(())

    def close(self) -> None:
        pass


def last_named(rows: DataFrame, key: str, values: tuple[str, ...], lookback: int = 6, idle: int = 24 * 3600 * 1000) -> DataFrame:
    """A stream's rows (key, turn, values, others) with last_<value> of the `lookback` rows of the same key before them.

    Turns of a key must not be older than those of earlier triggers; within a trigger their order is free. Rows with
    equal turns keep an arbitrary order, null turns come first, as in a window; null keys are a key of their own. The query that starts it needs the
    RocksDB state store (``started`` sees to that).
    """
    out = StructType(list(rows.schema.fields))
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    for v in values:
        out = out.add(f"last_{v}", types[v])
    return rows.groupBy(key).transformWithStateInPandas(LastNamed(key, values, types, lookback, idle), outputStructType=out, outputMode="Append", timeMode="ProcessingTime")


def carried(turns: DataFrame, lookback: int = 6, idle: int = 24 * 3600 * 1000) -> DataFrame:
    """H32 on a stream of turns (conv_id, turn, role, text): conv_id, turn, text, enriched, as the batch form gives them."""
    users = turns.filter("role = 'user'").select("conv_id", "turn", "text", intent.entities(F.col("text")).alias("found")).select("conv_id", "turn", "text", "found.*")
    rows = last_named(users, "conv_id", ENTITIES, lookback, idle)
    added = F.array_join(F.array_compact(F.array(*[F.when(F.col(e).isNull(), F.col(f"last_{e}")) for e in ENTITIES])), " ")
    follow = intent.is_followup(F.col("text"), F.struct(*ENTITIES))
    enriched = F.when(follow & (F.length(added) > 0), F.concat(stripped(F.col("text")), F.lit(" "), added)).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", "text", enriched.alias("enriched"))


def started(rows: DataFrame, path: str) -> StreamingQuery:
    """Writes what there is of a stateful stream to path/rows, with its checkpoint in path/checkpoint, and ends.

    Started again with the same path it goes on where it was, with the state it had; timers that have come due fire then.
    Settings are for this query alone: a query takes the session's when it starts.
    """
    conf = rows.sparkSession.conf
    before = {name: conf.get(name, None) for name in _SETTINGS}
    for name, value in _SETTINGS.items():
        conf.set(name, value)
    try:
        return rows.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)
