"""Progress of background reviews from their reports: one row a task, over a table or a stream of reports.

A report (task_id, ts, stage, done, total) moves its task if it is further than all before it; repeats and steps back change
nothing.  The first report of an end, finished or failed, is the last that counts.  A task that says nothing for longer than
the timeout fails at that moment, whatever comes later.  Reports count in order of time, those of one time in order of
percent, an end after all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import STAGES, task_progress
from .ordered import InOrder, replayed

TIMEOUT = 3600
MICROS = 1_000_000
#: Ends of a task, in the order in which reports of one moment count.
ENDS = {"failed": 101, "finished": 102}
TASK = "task_id long, percent long, stage string, status string, updated_us long, error string"
#: An ended task is remembered for so many timeouts, for reports that come after its end.
REMEMBER = 24


def _reports(events: DataFrame) -> DataFrame:
    """(us, rank, percent, stage, task_id) of each report that has a task, a time and a known stage."""
    known = F.col("stage").isin(*STAGES, "analysing", "failed")
    percent = F.when(F.col("stage") == "failed", F.lit(0)).otherwise(F.least(task_progress("stage", F.coalesce("done", F.lit(0)), F.coalesce("total", F.lit(1))), F.when(F.col("stage") == "analysing", 80).otherwise(100)))
    rank = F.when(F.col("stage") == "failed", ENDS["failed"]).when(F.col("stage") == "finished", ENDS["finished"]).otherwise(percent)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.where(known & F.col("task_id").isNotNull() & F.col("ts").isNotNull()).select("ts", us.alias("us"), rank.cast("long").alias("rank"), percent.cast("long").alias("percent"), "stage", "task_id")


def task_states(events: DataFrame, as_of: str, timeout: int = TIMEOUT) -> DataFrame:
    """Where each task stands once all reports up to ``as_of`` are in: task_id, percent, stage, status, updated_at, error.

    Reports of a task are one group of a window; nothing else is sorted.
    """
    far = timeout * MICROS
    now = F.unix_micros(F.lit(as_of).cast("timestamp"))
    order = Window.partitionBy("task_id").orderBy("us", "rank", "percent", "stage")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = _reports(events).where(F.col("us") <= now)
    over = F.col("us") - F.lag("us").over(order) > far
    cut = seen.withColumn("over", F.coalesce(over, F.lit(False)).cast("int")).withColumn("end", F.col("stage").isin(*ENDS).cast("int"))
    counted = cut.withColumn("open", (F.coalesce(F.max("end").over(before), F.lit(0)) == 0) & (F.max("over").over(so_far) == 0)).where("open")
    high = F.coalesce(F.max("percent").over(before), F.lit(-1))
    moved = counted.withColumn("moves", (F.col("end") == 1) | (F.col("percent") > high))
    last = lambda c: F.max_by(c, F.struct("us", "rank", "percent", "stage"))
    out = moved.groupBy("task_id").agg(F.max("percent").alias("percent"), last(F.when(F.col("moves"), F.col("stage"))).alias("_"), F.max("us").alias("last"), F.max(F.when(F.col("moves"), F.struct("us", "rank", "percent", "stage"))).alias("m"), F.max("end").alias("end"))
    gone = (F.col("end") == 0) & (F.col("last") + far < now)
    stage, failed = F.col("m.stage"), F.col("m.stage") == "failed"
    status = F.when(gone | failed, "failed").when(stage == "finished", "completed").otherwise("in_progress")
    at = F.when(gone, F.col("last") + far).otherwise(F.col("m.us"))
    error = F.when(gone, "timeout").when(failed, "reported")
    return out.select("task_id", "percent", F.when(gone, "failed").otherwise(stage).alias("stage"), status.alias("status"), F.timestamp_micros(at).alias("updated_at"), error.alias("error"))


class _Tasks(InOrder):
    output = tuple(c.split()[0] for c in TASK.split(", "))
    fields = ("us", "rank", "percent", "stage", "task_id")
    waiting = "us long, rank long, percent long, stage string, task_id long"
    held = "task_id long, percent long, stage string, status string, updated_us long, error string, last_us long"

    def __init__(self, timeout: int) -> None:
        self.timeout = timeout * MICROS

    def _lost(self, kept: tuple) -> tuple[tuple, tuple]:
        at = kept[6] + self.timeout
        kept = (kept[0], kept[1], "failed", "failed", at, "timeout", at)
        return kept, kept[:6]

    def replay(self, kept: tuple | None, row: tuple) -> tuple[tuple, tuple | None]:
        us, _, percent, stage, task = row
        if kept and kept[3] != "in_progress":
            return kept, None
        if kept and us - kept[6] > self.timeout:
            return self._lost(kept)
        high = kept[1] if kept else -1
        if stage in ENDS:
            kept = (task, max(high, percent), stage, "failed" if stage == "failed" else "completed", us, "reported" if stage == "failed" else None, us)
            return kept, kept[:6]
        if percent <= high:
            return (*kept[:6], us), None
        kept = (task, percent, stage, "in_progress", us, None, us)
        return kept, kept[:6]

    def wake(self, kept: tuple) -> int:
        return kept[6] + (self.timeout + 1 if kept[3] == "in_progress" else REMEMBER * self.timeout)

    def quiet(self, kept: tuple, now: int) -> tuple[tuple | None, tuple | None]:
        if kept[3] == "in_progress":
            return self._lost(kept) if now - kept[6] > self.timeout else (kept, None)
        return (None if now - kept[6] >= REMEMBER * self.timeout else kept), None


def task_stream(events: DataFrame, timeout: int = TIMEOUT, late: str = "10 minutes") -> DataFrame:
    """A row (task_id, percent, stage, status, updated_at, error) whenever a task moves, from reports in any order.

    Reports over ``late`` behind the latest are dropped.  Ended tasks are remembered for ``REMEMBER`` timeouts; a report
    that comes later still begins its task anew.  A task's rows come in order, so the last one is how it stands.
    """
    out = replayed(_reports(events), ["task_id"], _Tasks(timeout), TASK, late)
    return out.select("task_id", "percent", "stage", "status", F.timestamp_micros("updated_us").alias("updated_at"), "error")


def as_changes(moves: DataFrame) -> DataFrame:
    """Moves of a micro-batch as changes of a keyed table, where the last of a task counts.

    ``error`` and ``stage`` are never taken back once a task has ended, so taking only what is not null is right.
    """
    return moves.withColumn("_op", F.lit("upsert")).withColumn("_order", F.struct(F.col("status") != "in_progress", "updated_at", "percent"))
