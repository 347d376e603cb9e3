"""Streams whose rows must be taken in order of time: a keyed state that waits for the watermark and then replays.

Rows of a key come in any order.  They wait in list state until the watermark has passed their time, when no earlier one
can follow, and are then handed on in order; a timer wakes the key.  Rows behind the watermark are dropped before.  What a
key holds is what came within the allowed lateness, and the state of its own that a replay keeps.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The store that keyed state with timers needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """``fields``: names of a row's columns; the first is its time in whole microseconds, ties go by the others in turn.

    Subclasses keep one row ``kept`` of type ``held`` (None at first) and give ``replay``, ``wake`` and ``quiet``.
    """

    fields: tuple[str, ...]
    output: tuple[str, ...]  # names of an output row's columns
    waiting: str  # the type of a waiting row
    held: str  # the type of what a key keeps

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", self.waiting)
        self._kept = handle.getValueState("kept", self.held)

    def replay(self, kept: tuple | None, row: tuple) -> tuple[tuple | None, tuple | None]:
        """One row in its turn: what the key keeps from then on, and an output row or None."""
        raise NotImplementedError

    def quiet(self, kept: tuple, now: int) -> tuple[tuple | None, tuple | None]:
        """No row up to ``now`` is left: what the key keeps (None: nothing), and an output row or None."""
        return kept, None

    def wake(self, kept: tuple) -> int | None:
        """When :meth:`quiet` must be asked at the latest, in microseconds."""
        return None

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        new = [tuple(r[f] for f in self.fields) for r in rows]
        self._waiting.appendList(new)
        self._handle.registerTimer(_millis(min(r[0] for r in new)))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(r) for r in self._waiting.get()] if self._waiting.exists() else []
        due, later = sorted((r for r in held if r[0] <= now), key=_order), [r for r in held if r[0] > now]
        kept = tuple(self._kept.get()) if self._kept.exists() else None
        out: list[tuple] = []
        for row in due:
            kept, said = self.replay(kept, row)
            out += [said] if said is not None else []
        if kept is not None:
            kept, said = self.quiet(kept, now)
            out += [said] if said is not None else []
        if due:
            self._waiting.put(later) if later else self._waiting.clear()
        self._kept.update(kept) if kept is not None else self._kept.clear()
        wakes = [r[0] for r in later] + ([w] if kept is not None and (w := self.wake(kept)) is not None else [])
        if wakes and _millis(min(wakes)) * 1000 > now:
            self._handle.registerTimer(_millis(min(wakes)))
        named = Row(*self.output)
        yield from (named(*r) for r in out)


def _order(row: tuple) -> tuple:
    """By the columns in turn, nulls first."""
    return tuple((v is not None, v) for v in row)


def _millis(micros: int) -> int:
    return -(-micros // 1000)


def replayed(rows: DataFrame, keys: list[str], processor: InOrder, output: str, late: str, ts: str = "ts") -> DataFrame:
    """The stream ``rows`` replayed by ``processor`` for each key; rows over ``late`` behind the latest are dropped."""
    with_store(rows.sparkSession)
    return rows.withWatermark(ts, late).groupBy(*keys).transformWithState(processor, output, "Append", "EventTime")


def with_store(spark: SparkSession) -> None:
    """Streams started from now on keep state where timers can be kept."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
