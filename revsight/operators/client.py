"""What the client computes over rows it holds, as table operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import prefixes
from ..functions.scores import count_if, round2


#: Rows that one task groups by file; parts of a given number are not joined to larger ones.
PART_ROWS = 250_000


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def issue_stats(issues: DataFrame) -> DataFrame:
    """Per review: totals; open is total less resolved less false positives, so an issue that is both is taken off twice."""
    resolved, false = count_if(F.col("is_resolved")), count_if(F.col("is_false_positive"))
    open_critical = count_if((F.col("severity") == "critical") & ~F.col("is_resolved") & ~F.col("is_false_positive"))
    return issues.groupBy("review_id").agg(F.count("*").alias("total"), resolved.alias("resolved"), false.alias("false_positive"), (F.count("*") - resolved - false).alias("open"), open_critical.alias("open_critical"))


def comment_counts(comments: DataFrame, kinds: tuple[str, ...] = ("general", "suggestion", "question", "issue")) -> DataFrame:
    return comments.groupBy("review_id").agg(F.count("*").alias("all"), *[count_if(F.col("comment_type") == k).alias(k) for k in kinds])


def file_tree(issues: DataFrame) -> DataFrame:
    """Per review and folder: issues beneath, distinct files beneath, and ``compat``, the product that the client shows.

    Nearly every file has a row of its own, so rows are dealt once by review, in as many parts as keep the groups of a task few
    whatever the input; both counts then need no further shuffle.
    """
    slim, rows = issues.select("review_id", "file_path"), issues.count()
    dealt = slim.repartition(max(partitions(issues.sparkSession), -(-rows // PART_ROWS)), "review_id") if rows > PART_ROWS else slim.repartition("review_id")
    per_file = dealt.groupBy("review_id", "file_path").agg(F.count("*").alias("n"))
    spread = per_file.select("review_id", F.explode(prefixes("file_path")).alias("folder"), "n")
    return spread.groupBy("review_id", "folder").agg(F.sum("n").alias("issues"), F.count("*").alias("files")).withColumn("compat", F.col("issues") * F.col("files"))


def rates(overview: DataFrame) -> DataFrame:
    """Shares of a dashboard in percent, 0 where there is nothing to divide by."""
    share = lambda a, b: F.when(F.col(b) > 0, round2(F.col(a) / F.col(b) * 100.0)).otherwise(F.lit(0.0))
    return overview.select("owner_id", share("completed_reviews", "total_reviews").alias("completion_rate"), share("critical_issues", "total_issues").alias("critical_rate"), share("active_repositories", "repositories_count").alias("active_rate"))


def trend_percent(series: DataFrame, key: str, at: str, score: str) -> DataFrame:
    """Change from the first to the last positive score of each key, in percent of the first."""
    good = series.where(F.col(score) > 0)
    first, last = F.min_by(score, F.struct(at, "id")), F.max_by(score, F.struct(at, "id"))
    return good.groupBy(key).agg(round2((last - first) / first * 100.0).alias("trend_percent"), F.count("*").alias("points"))


def bulk_update(issues: DataFrame, ids: DataFrame, action: str) -> DataFrame:
    """Issues after resolve, unresolve or false_positive was chosen for the ids (one column, id)."""
    resolved, false = {"resolve": (True, False), "unresolve": (False, False), "false_positive": (False, True)}[action]
    marked = issues.join(ids.select(F.col("id").alias("chosen")).distinct(), F.col("id") == F.col("chosen"), "left")
    hit = F.col("chosen").isNotNull()
    return marked.withColumn("is_resolved", F.when(hit, resolved).otherwise(F.col("is_resolved"))).withColumn("is_false_positive", F.when(hit, false).otherwise(F.col("is_false_positive"))).drop("chosen")


def total_issues(reviews: DataFrame) -> DataFrame:
    """Per repository: the sum of its reviews' issues, as shown where the stored total is null or 0."""
    return reviews.groupBy("repository_id").agg(F.coalesce(F.sum("total_issues"), F.lit(0)).cast("long").alias("total_issues"))


def shown_totals(stored: DataFrame, reviews: DataFrame) -> DataFrame:
    """Per repository of ``stored`` (repository_id, total): the stored total, or the sum over reviews where it is null or 0."""
    summed = total_issues(reviews)
    return stored.join(summed, "repository_id", "left").select("repository_id", F.coalesce(F.nullif("total", F.lit(0)), "total_issues", F.lit(0)).cast("long").alias("total"))


def categories(issues: DataFrame) -> DataFrame:
    """Categories that occur in each review, sorted."""
    return issues.groupBy("review_id").agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))


def repository_counts(repositories: DataFrame) -> DataFrame:
    """Per owner: repositories, active ones, and those with a provider's number."""
    return repositories.groupBy("owner_id").agg(F.count("*").alias("total"), count_if(F.col("is_active")).alias("active"), count_if(F.col("external_id").isNotNull()).alias("connected"))


def chart(series: DataFrame, key: str, at: str) -> DataFrame:
    """Points of a chart: ``label``, the day in words, and ``place`` by the time itself (ties by id), not by the label."""
    order = Window.partitionBy(key).orderBy(at, "id")
    return series.withColumn("label", F.date_format(at, "MMMM d, yyyy")).withColumn("place", F.row_number().over(order))


def activity(repositories: DataFrame, limit: int = 5) -> DataFrame:
    """The first repositories as feed entries; one stand-in entry where there are none."""
    rows = repositories.orderBy("id").limit(limit).select(F.col("id"), F.lit("repository").alias("kind"), F.concat(F.lit("Connected "), F.col("name")).alias("text"))
    empty = repositories.groupBy().agg(F.count("*").alias("n")).where("n = 0").select(F.lit(0).cast("long").alias("id"), F.lit("info").alias("kind"), F.lit("Connect a repository to get started").alias("text"))
    return rows.unionByName(empty)
