"""Running conversation history as keyed state that timers drop.

Two stateful steps follow each other. The first is keyed by conversation, keeps the number of its last turn
and marks late turns while rows pass through; it holds none of them. The second is keyed by block, so a
long conversation spreads over tasks; it keeps the messages of open blocks as list state.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from wayfare.operators.context import BLOCK, block_number

_MESSAGES = "array<struct<role:string,text:string>>"
_MARKED = "conv_id bigint, turn bigint, role string, text string, block bigint, late boolean"
_OUT = (
    f"conv_id bigint, block bigint, turn bigint, role string, text string, "
    f"messages {_MESSAGES}, late boolean"
)
# A conversation without turns for so long is closed.
IDLE_MS = 7 * 24 * 3600 * 1000

# Spark's name of the state store that list state and timers need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _put_off(handle: StatefulProcessorHandle, now: int, idle_ms: int) -> None:
    """One timer per key, ``idle_ms`` from now."""
    for timer in list(handle.listTimers()):
        handle.deleteTimer(timer)
    handle.registerTimer(now + idle_ms)


class _MarkLate(StatefulProcessor):
    """Per conversation: a turn not after the last one of earlier batches is late."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "turn bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        before = self.last.get()[0] if self.last.exists() else -(2**62)
        last = before
        for part in rows:
            last = max(last, int(part["turn"].max()))
            yield part.assign(late=part["turn"] <= before)
        self.last.update((last,))
        _put_off(self.handle, timerValues.getCurrentProcessingTimeInMs(), self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Blocks(StatefulProcessor):
    """Per block: messages in order of their turns; a full block keeps nothing."""

    def __init__(self, block: int, idle_ms: int):
        self.block, self.idle_ms = block, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.messages = handle.getListState("messages", "role string, text string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        turns = pd.concat(list(rows)).sort_values("turn", kind="stable")
        turns["late"] |= turns.duplicated("turn")
        kept = ~turns["late"]
        fresh = list(zip(turns["role"][kept], turns["text"][kept], strict=True))
        shown = [None] * len(turns)
        if fresh:
            messages = [tuple(m) for m in self.messages.get()] + fresh
            n = len(messages) - len(fresh)
            for i in [i for i, keep in enumerate(kept) if keep]:
                n += 1
                shown[i] = [{"role": r, "text": t} for r, t in messages[:n]]
            # After the last turn of its block only late turns can follow.
            if turns["turn"][kept].max() == (key[1] + 1) * self.block - 1:
                self.messages.clear()
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
            else:
                self.messages.appendList(fresh)
                _put_off(self.handle, timerValues.getCurrentProcessingTimeInMs(), self.idle_ms)
        columns = ["conv_id", "block", "turn", "role", "text", "messages", "late"]
        yield turns.assign(messages=shown)[columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        self.messages.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_history(turns: DataFrame, block: int = BLOCK, idle_ms: int = IDLE_MS) -> DataFrame:
    """Streaming twin of the batch history, with ``late`` marking turns that came out of order.

    ``context.with_earlier`` puts whole histories together from the written turns. A turn is late if its
    conversation had that turn or a later one in an earlier micro-batch, or the same turn before in
    this one; it comes out with null ``messages`` and leaves the state as it is. A full block drops
    its messages at once. A timer drops what is left of blocks and conversations without turns for
    ``idle_ms``: such a conversation is closed, and turns that still come start it anew. Turns without
    a conversation or a number are left out.

    The session's state store must be RocksDB; it is set here where the session names another. Timers
    fire in micro-batches with data if ``spark.sql.streaming.noDataMicroBatches.enabled`` is off,
    which a stream that shall end (``availableNow``) needs, as timers ask for ever new batches.
    """
    spark = turns.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    turns = turns.filter("conv_id is not null and turn is not null")
    turns = turns.selectExpr("cast(conv_id as bigint) as conv_id", "cast(turn as bigint) as turn", "role", "text")
    turns = turns.withColumn("block", block_number(block))
    marked = turns.groupBy("conv_id").transformWithStateInPandas(
        _MarkLate(idle_ms), _MARKED, outputMode="Append", timeMode="ProcessingTime"
    )
    return marked.groupBy("conv_id", "block").transformWithStateInPandas(
        _Blocks(block, idle_ms), _OUT, outputMode="Append", timeMode="ProcessingTime"
    )
