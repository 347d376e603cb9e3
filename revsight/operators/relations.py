"""Joins between entities: marks, threads, line ranges, nested loads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import truthy


def connected(available: DataFrame, repositories: DataFrame) -> DataFrame:
    """``available`` (id, ...) with ``is_connected``: some repository has the id as its external id."""
    known = repositories.select(F.col("external_id").alias("known")).distinct()
    marked = available.join(known, F.col("id").cast("string") == F.col("known"), "left")
    return marked.withColumn("is_connected", F.col("known").isNotNull()).drop("known")


def duplicate_connections(repositories: DataFrame) -> DataFrame:
    """Accounts that connect one external repository more than once."""
    return repositories.groupBy("owner_id", "provider", "external_id").agg(F.count("*").alias("n")).where("n > 1")


def visible(reviews: DataFrame, repositories: DataFrame, caller: int) -> DataFrame:
    """Reviews of repositories that the caller owns."""
    return reviews.join(repositories.where(F.col("owner_id") == caller).select(F.col("id").alias("repository_id")), "repository_id", "left_semi")


def named(reviews: DataFrame, repositories: DataFrame) -> DataFrame:
    """Reviews with the name and provider of their repository, or stand-ins where it is not there."""
    names = repositories.select(F.col("id").alias("repository_id"), F.col("full_name").alias("found"), F.col("provider").alias("at"))
    out = reviews.join(names, "repository_id", "left")
    return out.withColumn("repository_name", F.coalesce("found", F.concat(F.lit("Repository "), F.col("repository_id").cast("string")))).withColumn("provider", F.coalesce("at", F.lit("github"))).drop("found", "at")


def threads(comments: DataFrame) -> DataFrame:
    """Root comments, each with its replies oldest first; a parent id of 0 makes a root.  Newest threads first by created_at."""
    replies = comments.where(truthy("parent_id")).groupBy(F.col("parent_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("created_at", "id", "comment_type", "content"))).alias("replies"))
    roots = comments.where(~truthy("parent_id"))
    return roots.join(replies.withColumnRenamed("id", "root"), F.col("id") == F.col("root"), "left").drop("root")


def threads_of_type(all_threads: DataFrame, kind: str) -> DataFrame:
    """Threads whose root or any reply is of that type."""
    return all_threads.where((F.col("comment_type") == kind) | F.coalesce(F.exists("replies", lambda r: r["comment_type"] == kind), F.lit(False)))


def last_line():  # noqa: ANN201
    """An issue's last line; null and 0 mean its first."""
    return F.when(truthy("line_end"), F.col("line_end")).otherwise(F.col("line_start"))


def issues_on_lines(issues: DataFrame, lines: DataFrame, *keys: str) -> DataFrame:
    """Lines (keys, line) with each issue whose range covers them.

    The range becomes an equality: an issue is repeated for each of its lines, which is linear in highlighted lines, and
    the join is then by file and line.  A range that ends before it starts covers nothing.
    """
    spread = issues.where(last_line() >= F.col("line_start")).select(*keys, F.explode(F.sequence("line_start", last_line())).alias("line"), F.col("id").alias("issue_id"), "severity")
    return lines.join(spread, [*keys, "line"])


def numbered_lines(files: DataFrame) -> DataFrame:
    """One row per line of a file, from 1."""
    return files.select("path", F.posexplode(F.split("content", "\n")).alias("at", "text")).select("path", (F.col("at") + 1).alias("line"), "text")


def full_review(reviews: DataFrame, issues: DataFrame, comments: DataFrame, repositories: DataFrame) -> DataFrame:
    """Every review with its repository's name and its issues and comments nested."""
    own = issues.groupBy("review_id").agg(F.sort_array(F.collect_list(F.struct("id", "severity", "title"))).alias("issues"))
    said = comments.groupBy("review_id").agg(F.sort_array(F.collect_list(F.struct("created_at", "id", "content"))).alias("comments"))
    out = reviews.withColumnRenamed("id", "review_id").join(own, "review_id", "left").join(said, "review_id", "left")
    return out.join(repositories.select(F.col("id").alias("repository_id"), F.col("full_name").alias("repository")), "repository_id", "left")
