"""Moves that time alone causes: tiers of chats, and chats that fall idle, by event-time timers on a stream of messages.

The state of a chat is its newest message and its tier. A message sets timers for the steps after it; when the watermark passes one, the
chat moves, though no message of it has come. A message of a chat that has moved away brings it back.

State lives in the RocksDB store, whose settings a session must have (``STORE``). A batch that is run again starts from the state
before it, so a move comes once.

Defined results for odd input: rows with a null time or chat are left out; messages older than the newest known one change
nothing; equal times count once; messages behind the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY = 86_400_000
#: Tier of a chat by the time since its newest message, in milliseconds: the first holds from the message on.
TIERS = [("active", 0), ("recent", 30 * DAY), ("archive", 90 * DAY)]
#: The same for activity.
IDLE = [("busy", 0), ("idle", 30 * 60_000)]
#: Settings of a session that runs these streams.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
MOVES = "chat_id {kind}, at timestamp, before string, after string"


def step_of(age: int, steps: list[tuple[str, int]]) -> str:
    """The step that an age has reached."""
    return [name for name, from_ in steps if age >= from_ or from_ == 0][-1]


class Steps(StatefulProcessor):
    """Moves of one chat along ``steps``."""

    def __init__(self, steps: list[tuple[str, int]]):
        self.steps = steps

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "newest long, step string")

    def _rows(self, key, moves: list[tuple[int, str, str]]) -> Iterator[pd.DataFrame]:
        if moves:
            yield pd.DataFrame({"chat_id": [key[0]] * len(moves), "at": pd.to_datetime([m[0] for m in moves], unit="ms"), "before": [m[1] for m in moves], "after": [m[2] for m in moves]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.held.get() if self.held.exists() else None
        newest, step = (held[0], held[1]) if held else (None, None)
        moves, first = [], self.steps[0][0]
        times = sorted({int(t) for f in rows for t in f["ms"]})
        for t in times:
            if newest is None or t > newest:
                # steps that lie between the message before and this one, whose timers have not gone off yet
                for name, after in self.steps[1:] if newest is not None else []:
                    if newest + after < t and step_of(after, self.steps) != step and after > dict(self.steps)[step]:
                        moves.append((newest + after, step, name))
                        step = name
                if step is not None and step != first:
                    moves.append((t, step, first))
                newest, step = t, first
        if newest is None or (held and newest == held[0]):
            return
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        for _, after in self.steps[1:]:
            self.handle.registerTimer(newest + after)
        self.held.update((newest, step))
        yield from self._rows(key, moves)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        newest, step = self.held.get()
        at = expiredTimerInfo.getExpiryTimeInMs()
        now = step_of(at - newest, self.steps)
        if now != step:
            self.held.update((newest, now))
            yield from self._rows(key, [(at, step, now)])

    def close(self) -> None:
        pass


def use_store(spark: SparkSession) -> None:
    """Gives the session the state store that timers need."""
    for k, v in STORE.items():
        spark.conf.set(k, v)


def moves(messages: DataFrame, ts: str = "ts", late: str = "1 hour", steps: list[tuple[str, int]] | None = None) -> DataFrame:
    """(chat_id, at, before, after): each change of step of each chat, on a stream of messages (chat_id, ``ts``)."""
    d = messages.where(F.col(ts).isNotNull() & F.col("chat_id").isNotNull()).withWatermark(ts, late)
    kind = d.schema["chat_id"].dataType.simpleString()
    d = d.select("chat_id", F.col(ts), F.unix_millis(F.col(ts).cast("timestamp")).alias("ms"))
    return d.groupBy("chat_id").transformWithStateInPandas(Steps(steps or TIERS), MOVES.format(kind=kind), "Append", "EventTime")


def moves_of(messages: DataFrame, until: str, ts: str = "ts", steps: list[tuple[str, int]] | None = None) -> DataFrame:
    """The same moves of a batch of messages, as far as the time ``until``: between a message and the chat's next one it moves by age."""
    from pyspark.sql import Window

    steps = steps or TIERS
    ms = F.unix_millis(F.col(ts).cast("timestamp"))
    m = messages.where(F.col(ts).isNotNull() & F.col("chat_id").isNotNull()).select("chat_id", ms.alias("ms")).distinct()
    end = F.unix_millis(F.lit(until).cast("timestamp"))
    m = m.withColumn("next", F.lead("ms").over(Window.partitionBy("chat_id").orderBy("ms"))).withColumn("open", F.coalesce("next", end))
    names = [n for n, _ in steps]
    fall = F.array(*[F.struct((F.col("ms") + after).alias("at"), F.lit(names[i]).alias("before"), F.lit(names[i + 1]).alias("after"), (F.col("ms") + after).alias("by")) for i, (_, after) in enumerate(steps[1:])])
    fell = m.select("chat_id", "ms", "next", F.explode(F.filter(fall, lambda x: x["at"] <= F.col("open"))).alias("x"))
    down = fell.where("next is null or x.at < next").select("chat_id", "x.at", "x.before", "x.after")
    back = fell.where("next is not null and x.at < next").groupBy("chat_id", "next").agg(F.max_by("x.after", "x.at").alias("before")).select("chat_id", F.col("next").alias("at"), "before", F.lit(names[0]).alias("after"))
    return down.unionByName(back).select("chat_id", F.timestamp_millis("at").alias("at"), "before", "after")
