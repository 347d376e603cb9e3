"""Queries over stored tables and streams: keyed merges read back, task progress, request limits in any order of arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..entities import with_sql
from ..session import shared_folder
from ..sources.keyed import KeyedTable
from ..streaming import limiter, progress
from . import sql_sources  # noqa: F401  (registers what streams are held against)
from .registry import SQL, register, tables

_COLUMNS = ("id", "repository_id", "title", "status", "progress", "total_issues")


@register(
    "keyed_writes",
    with_sql("reviews")
    + """, s AS (SELECT id, repository_id, title, CASE WHEN id % 7 = 0 THEN 'completed' ELSE status END AS status, CASE WHEN id % 7 = 0 THEN 1.0::DOUBLE ELSE progress END AS progress, total_issues FROM reviews)
SELECT id, repository_id, CASE WHEN id % 5 = 0 THEN title || '!' ELSE title END AS title, status, progress, total_issues FROM s WHERE id % 11 <> 0 OR id % 17 = 0
UNION ALL SELECT id, NULL, title || '!', NULL, NULL, NULL FROM s WHERE id % 11 = 0 AND id % 17 <> 0 AND id % 5 = 0
UNION ALL SELECT id + 1000000000000, repository_id, 'New', 'pending', NULL, NULL FROM s WHERE id % 13 = 0""",
)
def keyed_writes(spark, sf_dir):  # noqa: ANN001, ANN201
    """Three batches over a stored table, the second handed on twice: updates; deletes and inserts; upserts."""
    reviews = tables(spark, sf_dir, "reviews")[0].select(*_COLUMNS)
    table = KeyedTable.create(reviews, shared_folder(spark, "reviews"))
    table.merge(reviews.where("id % 7 = 0").select("id", F.lit("completed").alias("status"), F.lit(1.0).alias("progress"), F.lit("update").alias("_op")), "status", 0)
    gone = reviews.where("id % 11 = 0").select("id", F.lit("delete").alias("_op"), F.lit(1).alias("at"))
    there = reviews.where("id % 17 = 0").select("id", F.lit("insert").alias("_op"), F.lit("not taken").alias("title"), F.lit(2).alias("at"))
    new = reviews.where("id % 13 = 0").select((F.col("id") + 1_000_000_000_000).alias("id"), F.lit("insert").alias("_op"), "repository_id", F.lit("New").alias("title"), F.lit("pending").alias("status"), F.lit(1).alias("at"))
    second = gone.unionByName(there, allowMissingColumns=True).unionByName(new, allowMissingColumns=True)
    for _ in range(2):
        table.merge(second, "status", 1, order="at")
    table.merge(reviews.where("id % 5 = 0").select("id", F.concat("title", F.lit("!")).alias("title"), F.lit(None).cast("int").alias("total_issues"), F.lit("upsert").alias("_op")), "titles", 0)
    return table.read()


#: What a report says by its place in a conversation, and how far after the first it comes, in seconds.
_STAGE = "CASE WHEN turn % 8 = 0 THEN 'starting' WHEN turn % 8 = 1 THEN 'cloning' WHEN turn % 8 IN (2, 3) THEN 'analysing' WHEN turn % 8 = 4 THEN 'scoring' WHEN conv_id % 10 = 3 THEN 'failed' WHEN turn % 8 = 5 THEN 'saving' ELSE 'finished' END"
_AFTER = "CASE WHEN conv_id % 9 = 4 AND turn = 3 THEN 40 WHEN conv_id % 7 = 2 AND turn >= 4 THEN 6000 + turn * 60 ELSE turn * 300 END"
_FIRST, _AS_OF = "2024-03-01 00:00:00", "2024-05-01 00:00:00"


def reports_of(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    """Task reports out of conversations: each a task, each turn a report; some repeat, step back, fall silent or fail."""
    held = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    at = F.lit(_FIRST).cast("timestamp") + F.make_dt_interval(secs=F.expr(f"conv_id % 500 * 97 + {_AFTER}"))
    return held.select(F.col("conv_id").alias("task_id"), at.alias("ts"), F.expr(_STAGE).alias("stage"), (F.col("turn") % 4).alias("done"), F.lit(4).cast("long").alias("total"))


_TASKS = f"""WITH e AS (SELECT conv_id AS task_id, conv_id % 500 * 97 + {_AFTER} AS us, {_STAGE} AS stage, turn FROM conversations),
p AS (SELECT *, CASE stage WHEN 'starting' THEN 0 WHEN 'cloning' THEN 10 WHEN 'analysing' THEN 20 + (turn % 4) * 60 // 4 WHEN 'scoring' THEN 80 WHEN 'saving' THEN 90 WHEN 'finished' THEN 100 ELSE 0 END AS percent FROM e),
r AS (SELECT *, CASE stage WHEN 'failed' THEN 101 WHEN 'finished' THEN 102 ELSE percent END AS rank, stage IN ('failed', 'finished') AS ends FROM p),
n AS (SELECT *, row_number() OVER w AS k, coalesce(us - lag(us) OVER w > 3600, FALSE) AS over FROM r WINDOW w AS (PARTITION BY task_id ORDER BY us, rank, percent, stage)),
o AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM n b WHERE b.task_id = n.task_id AND ((b.ends AND b.k < n.k) OR (b.over AND b.k <= n.k)))),
m AS (SELECT *, ends OR percent > coalesce((SELECT max(b.percent) FROM o b WHERE b.task_id = o.task_id AND b.k < o.k), -1) AS moves FROM o),
t AS (SELECT task_id, max(percent) AS percent, max(us) AS last, max(us) FILTER (WHERE moves) AS moved, arg_max(stage, k) FILTER (WHERE moves) AS stage, bool_or(ends) AS ends FROM m GROUP BY task_id)
SELECT task_id, CAST(percent AS BIGINT) AS percent, CASE WHEN ends THEN stage ELSE 'failed' END AS stage, CASE WHEN ends AND stage = 'finished' THEN 'completed' ELSE 'failed' END AS status,
  epoch(TIMESTAMP '{_FIRST}')::BIGINT + CASE WHEN ends THEN moved ELSE last + 3600 END AS updated_s, CASE WHEN NOT ends THEN 'timeout' WHEN stage = 'failed' THEN 'reported' END AS error FROM t"""


def _shown(states: DataFrame) -> DataFrame:
    return states.select("task_id", "percent", "stage", "status", F.unix_seconds("updated_at").alias("updated_s"), "error")


@register("task_progress", _TASKS)
def task_progress(spark, sf_dir):  # noqa: ANN001, ANN201
    return _shown(progress.task_states(reports_of(spark, sf_dir), _AS_OF))


def landed(rows: DataFrame, chunks: int, run, last: DataFrame, ts: str = "ts", late_s: int = 600) -> None:  # noqa: ANN001
    """Land ``rows`` in parts by time of arrival, up to ``late_s`` after their own, and run the stream after each; then ``last``.

    ``run``: called with the landing folder; it takes what is new and ends.  ``last`` moves event time past everything.
    """
    folder = shared_folder(rows.sparkSession, "landed")
    arrival = F.unix_seconds(F.col(ts).cast("timestamp")) + F.pmod(F.xxhash64(*rows.columns), F.lit(late_s))
    first, end = rows.agg(F.min(arrival), F.max(arrival)).first()
    for k in range(chunks):
        rows.where(F.floor((arrival - first) * chunks / max(1, end - first + 1)) == k).write.parquet(f"{folder}/{k}")
        run(folder)
    last.write.parquet(f"{folder}/last")
    run(folder)


@register("task_progress_stream", _TASKS)
def task_progress_stream(spark, sf_dir):  # noqa: ANN001, ANN201
    """The same reports as a stream, each batch of moves merged into a stored table; restarted from its checkpoint twice."""
    reports = reports_of(spark, sf_dir)
    empty = spark.createDataFrame([], "task_id long, percent long, stage string, status string, updated_at timestamp, error string")
    table = KeyedTable.create(empty, shared_folder(spark, "tasks"), key="task_id")
    checkpoint = shared_folder(spark, "task-checkpoint")

    def run(folder: str) -> None:
        stream = spark.readStream.schema(reports.schema).option("recursiveFileLookup", "true").parquet(folder)
        put = table.sink("tasks", order="_order")
        moves = progress.as_changes(progress.task_stream(stream, late="20 minutes"))
        moves.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    last = spark.sql(f"SELECT -1L AS task_id, timestamp'{_AS_OF}' AS ts, 'starting' AS stage, 0L AS done, 4L AS total")
    landed(reports.unionByName(reports.where("task_id % 3 = 0")), 2, run, last)
    return _shown(table.read())


@register("rate_limit_stream", SQL["rate_limit"])
def rate_limit_stream(spark, sf_dir):  # noqa: ANN001, ANN201
    """Requests that arrive out of order, decided as they would be in order; restarted from the checkpoint twice."""
    requests = tables(spark, sf_dir, "requests")[0].withColumn("ts", F.col("ts").cast("timestamp"))
    out, checkpoint = shared_folder(spark, "decided"), shared_folder(spark, "limit-checkpoint")

    def run(folder: str) -> None:
        stream = spark.readStream.schema(requests.schema).option("recursiveFileLookup", "true").parquet(folder)
        decided = limiter.limited_stream(stream, 3, 3600, late="20 minutes")
        decided.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    last = spark.sql("SELECT -1L AS request_id, 'nobody' AS client, timestamp'2100-01-01 00:00:00' AS ts").select(*[F.col(f.name).cast(f.dataType) for f in requests.schema])
    landed(requests, 2, run, last)
    return spark.read.parquet(out).select("request_id", "client", "accepted")
