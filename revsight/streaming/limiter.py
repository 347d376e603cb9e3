"""Request limits and request counts, over a table or a stream of requests (client, ts).

A request is accepted if fewer than ``limit`` accepted requests of its client lie in the ``window`` seconds before it; a
rejected one leaves no trace.  That rule depends on order: over a table requests are sorted, over a stream they wait for the
watermark.  State per client is the times of the accepted requests still in the window, ``limit`` at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import InOrder, replayed

LIMIT, WINDOW = 100, 60
MICROS = 1_000_000


def _micros(ts: pd.Series) -> list[int]:
    return [t.value // 1000 for t in ts]


def decided(times: list[int], held: list[int], limit: int, window: int) -> tuple[list[bool], list[int]]:
    """Whether each request, in order of time, is accepted; and the accepted times that stay in the window.

    Times are whole numbers, so that one exactly a window ago is out of it whatever its fraction of a second.
    """
    out = []
    for t in times:
        held = [h for h in held if h > t - window]
        ok = len(held) < limit
        if ok:
            held.append(t)
        out.append(ok)
    return out, held


def client_id(address: Column, forwarded: Column, real: Column) -> Column:
    """The client of a request: its address, else the first forwarded address, else the real one, else unknown."""
    first = F.trim(F.split(forwarded, ",")[0])
    return F.coalesce(address, first, real, F.lit("unknown"))


#: Windows that one range of a client's time is long; ranges are what tasks order.
RANGE = 64


def stretches(requests: DataFrame, window: int = WINDOW) -> DataFrame:
    """Requests with ``stretch``, which grows by one wherever a client pauses for a whole window.

    Rows are ordered within ranges of a client's time, each a group of its own; across ranges only the first and last time
    and the number of pauses of each are ordered, so a client of any number of requests is spread over many tasks.
    """
    from pyspark.sql import Window

    pause = window * MICROS
    timed = requests.withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("_range", F.floor(F.col("_us") / (RANGE * pause)))
    own = Window.partitionBy("client", "_range").orderBy("_us", "request_id")
    cut = (F.col("_us") - F.lag("_us").over(own) >= pause).cast("int")
    rows = timed.withColumn("_cut", F.coalesce(cut, F.lit(0))).withColumn("_cuts", F.sum("_cut").over(own))
    ranges = timed.withColumn("_cut", F.coalesce(cut, F.lit(0))).groupBy("client", "_range").agg(F.min("_us").alias("first"), F.max("_us").alias("last"), F.sum("_cut").alias("cuts"))
    along = Window.partitionBy("client").orderBy("_range")
    opens = F.coalesce((F.col("first") - F.lag("last").over(along) >= pause).cast("int"), F.lit(1))
    placed = ranges.withColumn("opens", opens).select(F.col("client").alias("_client"), F.col("_range").alias("_r"), (F.sum(F.col("opens") + F.col("cuts")).over(along) - F.col("cuts")).alias("_base"))
    joined = rows.join(placed, F.col("client").eqNullSafe(F.col("_client")) & (F.col("_range") == F.col("_r")))
    return joined.select(*requests.columns, (F.col("_base") + F.col("_cuts")).alias("stretch"))


def limited(requests: DataFrame, limit: int = LIMIT, window: int = WINDOW) -> DataFrame:
    """Requests (request_id, client, ts) with ``accepted``.

    A client's requests are cut where it pauses for a whole window: nothing before such a pause can count after it, so the
    stretches are independent groups.  In a stretch of no more than ``limit`` requests all are accepted; only longer ones
    need their order replayed, which streams through sorted rows: a stretch of any length takes the memory of one batch and
    ``limit`` times.
    """
    cut = stretches(requests.select("request_id", "client", "ts"), window)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows come sorted by client, stretch and time; what is held is one stretch's accepted times of one window
        at, held = None, []
        for pdf in batches:
            accepted = []
            for key, part in pdf.groupby(["client", "stretch"], sort=False, dropna=False):
                known = at is not None and all(x == y or (x != x and y != y) for x, y in zip(key, at))
                yes, held = decided(_micros(part["ts"]), held if known else [], limit, window * MICROS)
                at = key
                accepted += yes
            yield pdf.assign(accepted=accepted)[["request_id", "client", "ts", "accepted"]]

    # counted before rows move, and only long stretches are looked up
    long = cut.groupBy("client", "stretch").agg(F.count("*").alias("n")).where(F.col("n") > limit).select(F.col("client").alias("_client"), F.col("stretch").alias("_stretch"), F.lit(True).alias("_long"))
    sized = cut.join(long, F.col("client").eqNullSafe(F.col("_client")) & (F.col("stretch") == F.col("_stretch")), "left")
    free = sized.where("_long IS NULL").select("request_id", "client", "ts", F.lit(True).alias("accepted"))
    dealt = sized.where("_long").select("request_id", "client", "ts", "stretch").repartition("client", "stretch").sortWithinPartitions("client", "stretch", "ts", "request_id")
    busy = dealt.mapInPandas(run, "request_id long, client string, ts timestamp_ntz, accepted boolean")
    return free.unionByName(busy)


class _Limiter(InOrder):
    output = ("request_id", "client", "us", "accepted")
    fields, waiting, held = ("us", "request_id", "client"), "us long, request_id long, client string", "times array<long>"

    def __init__(self, limit: int, window: int) -> None:
        self.limit, self.window = limit, window * MICROS

    def replay(self, kept: tuple | None, row: tuple) -> tuple[tuple, tuple]:
        (ok,), times = decided([row[0]], list(kept[0]) if kept else [], self.limit, self.window)
        return (times,), (row[1], row[2], row[0], ok)

    def wake(self, kept: tuple) -> int:
        return max(kept[0], default=0) + self.window

    def quiet(self, kept: tuple, now: int) -> tuple[tuple | None, None]:
        times = [t for t in kept[0] if t > now - self.window]
        return ((times,) if times else None), None


def limited_stream(requests: DataFrame, limit: int = LIMIT, window: int = WINDOW, late: str = "60 seconds") -> DataFrame:
    """The same over a stream whose requests come in any order, none over ``late`` behind the latest; those are dropped.

    A request is decided once the watermark has passed it, in its turn by time and id, so stream and table agree.  A client's
    state is the requests that wait, and ``limit`` accepted times at most; it goes when a silent client's window is empty.
    """
    micros = requests.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    out = replayed(micros, ["client"], _Limiter(limit, window), "request_id long, client string, us long, accepted boolean", late)
    return out.select("request_id", "client", F.timestamp_micros("us").alias("ts"), "accepted")


def trailing_counts(requests: DataFrame, window: int = WINDOW) -> DataFrame:
    """Requests of a client in the ``window`` seconds up to each, without any limit."""
    from pyspark.sql import Window

    second = F.unix_micros(F.col("ts").cast("timestamp"))
    frame = Window.partitionBy("client").orderBy("us").rangeBetween(-(window * 1_000_000 - 1), 0)
    return requests.withColumn("us", second).withColumn("in_window", F.count("*").over(frame)).drop("us")


def counts(requests: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extension: requests by client and tumbling window; a stream drops what comes later than ``late``."""
    source = requests.withWatermark("ts", late) if requests.isStreaming else requests
    return source.groupBy(F.window("ts", every).alias("w"), "client").agg(F.count("*").alias("requests")).select("client", F.col("w.start").alias("start"), "requests")
