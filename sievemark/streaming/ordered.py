"""State in event-time order: whatever the split and the order in which rows arrive, the result is that of the batch form.

A key's rows wait in its state until the watermark has passed them, and are then handed on in order of time. Rows that arrive
behind the watermark are dropped by Spark, which counts them (``numRowsDroppedByWatermark``). State that nothing refers to any more
leaves by event-time timers: an idle key after its ``life``, a token when it expires. Times are microseconds inside.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType

from ..shipping import ship

#: From the kept state (or None) and a row, to the rows that go out and the state that stays.
Step = Callable[[tuple, tuple | None, dict], tuple[list[tuple], tuple | None]]


class InOrder(StatefulProcessor):
    """Hands a key's rows to ``due`` in order of (us, tie), and asks ``idle`` when time has passed."""

    def __init__(self, rows: StructType, out: StructType):
        self.rows, self.columns, self.out = rows, rows.names, out.names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.rows)

    def due(self, key: tuple, row: dict) -> Iterator[tuple]:
        raise NotImplementedError

    def idle(self, key: tuple, now: int) -> Iterator[tuple]:
        """Called at each timer with the watermark."""
        return iter(())

    def wake(self) -> int | None:
        """When ``idle`` has something to do next."""
        return None

    def _alarm(self, us: int) -> None:
        at = -(-us // 1000)
        if at not in set(self.handle.listTimers()):
            self.handle.registerTimer(at)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        new = [tuple(r[c] for c in self.columns) for r in rows]
        self.waiting.appendList(new)
        self._alarm(min(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: tuple((x is not None, x) for x in r)) if self.waiting.exists() else []
        ready = [r for r in rows if r[0] <= now]
        rest = rows[len(ready) :]
        for r in ready:
            for out in self.due(key, dict(zip(self.columns, r))):
                yield Row(*self.out)(*out)
        for out in self.idle(key, now):
            yield Row(*self.out)(*out)
        if ready:
            self.waiting.put(rest) if rest else self.waiting.clear()
        nexts = [t for t in (rest[0][0] if rest else None, self.wake()) if t is not None]
        if nexts:
            self._alarm(max(min(nexts), now + 1000))

    def close(self) -> None:
        pass


class Fold(InOrder):
    """A fold of a key's rows; the state goes ``life`` after the key's last row."""

    def __init__(self, rows: StructType, out: StructType, kept: StructType, step: Step, life: int | None):
        super().__init__(rows, out)
        self.kept_as, self.step, self.life = kept, step, life

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.kept = handle.getValueState("kept", self.kept_as)

    def _state(self) -> tuple | None:
        return tuple(self.kept.get()) if self.kept.exists() else None

    def due(self, key: tuple, row: dict) -> Iterator[tuple]:
        old = self._state()
        if old and self.life is not None and row["us"] - old[0] > self.life:
            old = None
        out, new = self.step(key, old[1:] if old else None, row)
        if new is None:
            self.kept.clear()
        else:
            self.kept.update((row["us"], *new))
        yield from out

    def idle(self, key: tuple, now: int) -> Iterator[tuple]:
        old = self._state()
        if old and self.life is not None and now - old[0] > self.life:
            self.kept.clear()
        return iter(())

    def wake(self) -> int | None:
        old = self._state()
        return old[0] + self.life + 1 if old and self.life is not None else None


def slim(rows: DataFrame, key: str, time: str, tie: str | None, **columns: Column) -> tuple[DataFrame, StructType]:
    """Key, event time (with its watermark), us, tie and ``columns``; and the schema of what waits."""
    order = F.lit(0) if tie is None else F.col(tie)
    df = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(time).alias("event_time"), F.unix_micros(F.col(time)).alias("us"), order.cast("bigint").alias("tie"), *(c.alias(n) for n, c in columns.items()))
    return df, StructType([StructField(f.name, f.dataType) for f in df.schema if f.name not in ("key", "event_time")])


def run(df: DataFrame, processor: InOrder, out: StructType, mode: str) -> DataFrame:
    ship(df.sparkSession)
    return df.groupBy("key").transformWithState(processor, out, mode, "eventTime")


def fold(rows: DataFrame, key: str, out: str, kept: str, step: Step, columns: dict[str, Column], time: str = "at", tie: str | None = None, mode: str = "Append", life: int | None = None) -> DataFrame:
    """Rows (of the DDL ``out``) that ``step`` makes of each key's rows in order of (time, tie), with what it keeps (of the DDL ``kept``).

    ``rows`` must have a watermark on ``time``; ``life`` in microseconds.
    """
    df, waiting = slim(rows, key, time, tie, **columns)
    # Schemas are made here: workers have no session to read DDL with.
    made = StructType.fromDDL(out)
    return run(df, Fold(waiting, made, StructType.fromDDL(f"last bigint, {kept}"), step, life), made, mode)
