"""Aggregates over commits and file changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import is_counted, is_scanned, language_title, suffix
from ..functions.times import month_key


def contributors(commits: DataFrame) -> DataFrame:
    """Per repository and e-mail: name of the newest commit, commits, first and last commit; ``compat_first`` is the last one, as the client shows both."""
    newest = F.max_by("author_name", F.struct("committed_at", "sha"))
    return commits.groupBy("repo_id", "author_email").agg(newest.alias("author_name"), F.count("*").alias("commits"), F.min("committed_at").alias("first_commit"), F.max("committed_at").alias("last_commit"), F.max("committed_at").alias("compat_first"))


def activity_by_month(commits: DataFrame) -> DataFrame:
    return commits.groupBy("repo_id", month_key("committed_at").alias("month")).agg(F.count("*").alias("commits"))


def repository_summary(commits: DataFrame) -> DataFrame:
    """Per repository: commits, contributors, and the newest and oldest commit (ties by sha)."""
    at = F.struct("committed_at", "sha")
    return commits.groupBy("repo_id").agg(F.count("*").alias("total_commits"), F.count_distinct("author_email").alias("contributors"), F.min_by(F.substring("sha", 1, 8), at).alias("first_sha"), F.max_by(F.substring("sha", 1, 8), at).alias("last_sha"), F.max_by(F.substring("message", 1, 100), at).alias("last_message"))


def file_types(files: DataFrame) -> DataFrame:
    """Scanned files by suffix, with their language and lines; only suffixes that count add lines.  Files: path, content."""
    lines = F.when(is_counted("path"), F.size(F.split("content", "\n"))).otherwise(F.lit(0))
    return files.where(is_scanned("path")).groupBy(suffix("path").alias("suffix")).agg(F.count("*").alias("files"), F.first(language_title("path")).alias("language"), F.sum(lines).cast("long").alias("lines"))


def history(changes: DataFrame, commits: DataFrame, limit: int = 50) -> DataFrame:
    """Per repository and path: the newest commits that touch it, numbered from the newest (ties by sha)."""
    touched = changes.select("repo_id", "sha", F.explode(F.array_distinct(F.array_compact(F.array("a_path", "b_path")))).alias("path")).distinct()
    joined = touched.join(commits.select("repo_id", "sha", "committed_at", "author_name"), ["repo_id", "sha"])
    order = Window.partitionBy("repo_id", "path").orderBy(F.col("committed_at").desc(), "sha")
    return joined.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def changed_files(changes: DataFrame) -> DataFrame:
    """Distinct paths of each commit, before and after."""
    return changes.select("repo_id", "sha", F.explode(F.array_compact(F.array("a_path", "b_path"))).alias("path")).distinct()


def change_type():  # noqa: ANN201
    return F.when(F.col("a_path").isNull(), "added").when(F.col("b_path").isNull(), "deleted").when(F.col("a_path") != F.col("b_path"), "renamed").otherwise("modified")


def change_summary(changes: DataFrame) -> DataFrame:
    """Per repository and kind of change: files, lines added and removed."""
    return changes.withColumn("change", change_type()).groupBy("repo_id", "change").agg(F.count("*").alias("files"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))


def commit_info(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """One record per commit: short name, author, trimmed message, and files, added and removed lines of its changes."""
    path = F.coalesce("b_path", "a_path")
    stats = changes.groupBy("repo_id", "sha").agg(F.count_distinct(path).alias("total_files"), F.sum("additions").alias("insertions"), F.sum("deletions").alias("deletions"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return commits.join(stats, ["repo_id", "sha"], "left").select("repo_id", "sha", F.substring("sha", 1, 8).alias("short_sha"), "author_name", "author_email", "committed_at", F.trim("message").alias("message"), zero("total_files"), zero("insertions"), zero("deletions"))


def branch_heads(refs: DataFrame, commits: DataFrame) -> DataFrame:
    """Branches (repo_id, name, sha, is_current, tracking) with the date, author and first 100 characters of their head."""
    heads = commits.select("repo_id", "sha", "committed_at", "author_name", F.substring(F.trim("message"), 1, 100).alias("message"))
    return refs.join(heads, ["repo_id", "sha"], "left").select("repo_id", "name", "is_current", "sha", "committed_at", "author_name", "message", "tracking")


def patch_counts(patch):  # noqa: ANN001, ANN201
    """(added, removed) lines of a patch: + but not +++, - but not ---."""
    lines = F.split(patch, "\n")
    some = lambda sign: F.size(F.filter(lines, lambda x: x.startswith(sign) & ~x.startswith(sign * 3)))
    return some("+"), some("-")
