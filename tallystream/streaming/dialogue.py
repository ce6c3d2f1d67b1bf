"""Streams of conversations: a transcript as a keyed fold, and requests paired with their replies.

transcripts keeps for each conversation the turn that comes next and the turns that came early. A turn
is shown when all before it were; early ones wait in the state. If a turn is missing, the conversation
goes on without it once the watermark is `patience_ms` beyond the turn that waits (a timer). What is appended to a
transcript comes out as a piece, so joined in the order of their turns a conversation's pieces are its
transcript. A turn that comes after it was given up is late: its piece has late set, and isn't in order.

pairs joins requests with replies by their key under watermarks. A reply must come within `wait` of its
request in event time; a request without one comes out when the watermark has passed that time, and
becomes the bubble of a failed call. State is dropped behind the watermarks.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.transcript import bubble

STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Streams started from now on keep their state in RocksDB, which timers and map states need."""
    spark.conf.set(STORE, ROCKS)


def _fold(first: int, patience_ms: int) -> StatefulProcessor:
    """One conversation's state: the next turn, and early turns with their bubbles. The class is local, so workers get it by value."""

    class Fold(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.next = handle.getValueState("next", "turn long")
            self.early = handle.getMapState("early", "turn long", "bubble string, ms long")

        def shown(self, key: tuple, turn: int) -> Iterator[Row]:
            """What can be shown from a turn on."""
            begin, parts = turn, []
            while self.early.containsKey((turn,)):
                parts.append(self.early.getValue((turn,))[0])
                self.early.removeKey((turn,))
                turn += 1
            self.next.update((turn,))
            if parts:
                yield Row(_conv=key[0], turn=begin, upto=turn, piece="".join(parts), late=False)

        def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
            if key[0] is None:  # filtered out ahead of the watermark, such rows couldn't move it
                return
            due, new = self.next.get()[0] if self.next.exists() else first, {}
            for r in sorted((r for r in rows if r["_turn"] is not None), key=lambda r: (r["_turn"], r["_bubble"])):
                turn, shown = r["_turn"], r["_bubble"]
                if turn < due:
                    yield Row(_conv=key[0], turn=turn, upto=turn + 1, piece=shown, late=True)
                else:  # rows of one turn stand beside each other
                    had = self.early.getValue((turn,)) if self.early.containsKey((turn,)) else ("", r["_ms"])
                    new[turn] = max(had[1], r["_ms"])
                    self.early.updateValue((turn,), (had[0] + shown, new[turn]))
            yield from self.shown(key, due)
            for turn, ms in new.items():
                if self.early.containsKey((turn,)):  # a timer for each turn that waits
                    self.handle.registerTimer(max(ms + patience_ms, timerValues.getCurrentWatermarkInMs() + 1))

        def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:  # noqa: N802, N803
            """Missing turns are given up as far as the early ones after them have waited long enough."""
            for turn in sorted(t[0] for t in self.early.keys()):  # noqa: SIM118
                if self.early.containsKey((turn,)):
                    if self.early.getValue((turn,))[1] + patience_ms > timerValues.getCurrentWatermarkInMs():
                        return
                    yield from self.shown(key, turn)

        def close(self) -> None:
            pass

    return Fold()


def transcripts(df: DataFrame, at: str, delay: str, patience_ms: int, conv: str = "conv_id", turn: str = "turn", style: str = "classes", first: int = 0) -> DataFrame:
    """(conv, turn, upto, piece, late) of a stream of turns in any order; append mode. Call use_rocksdb first.

    at is the rows' event time, delay how late they may come. Rows without a conversation or turn move the
    watermark and show nothing.
    """
    shown = F.coalesce(bubble(F.col("role"), F.col("text"), style), F.lit(""))  # other roles take a turn and show nothing
    seen = df.withWatermark(at, delay).select(F.col(f"`{conv}`").alias("_conv"), F.col(f"`{turn}`").cast("long").alias("_turn"), shown.alias("_bubble"), F.col(f"`{at}`").alias("_at"), F.unix_millis(f"`{at}`").alias("_ms"))
    kind = df.schema[conv].dataType.simpleString()
    out = seen.groupBy("_conv").transformWithState(_fold(first, patience_ms), f"_conv {kind}, turn long, upto long, piece string, late boolean", "append", "EventTime")
    return out.withColumnRenamed("_conv", conv)


def pairs(requests: DataFrame, replies: DataFrame, key: list[str], at: str, delay: str, wait: str) -> DataFrame:
    """Each request's columns with reply and replied_at, both NULL for a request without a reply in time.

    requests have the key, text and an event time `at`; replies the key, reply and `at`. delay is how late
    events may come, wait how long after its request a reply counts.
    """
    q = requests.withWatermark(at, delay).alias("q")
    r = replies.select(*[F.col(f"`{k}`").alias(f"_{k}") for k in key], "reply", F.col(f"`{at}`").alias("replied_at")).withWatermark("replied_at", delay).alias("r")
    on = (F.col("replied_at") >= F.col(f"q.`{at}`")) & (F.col("replied_at") <= F.col(f"q.`{at}`") + F.expr(f"INTERVAL {wait}"))
    for k in key:
        on = on & (F.col(f"q.`{k}`") == F.col(f"r.`_{k}`"))
    return q.join(r, on, "left").drop(*[f"_{k}" for k in key])


def exchange_bubbles(text: Column, reply: Column, style: str = "classes") -> Column:
    """The request's bubble and the reply's, or that of a failed call if the reply is NULL."""
    return F.concat(bubble(F.lit("user"), text, style), bubble(F.lit("assistant"), reply, style))
