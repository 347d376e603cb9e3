"""Dashboard aggregates: one shuffle by owner or repository each, whatever the number of owners.

A question about one user is these results filtered by ``owner_id``; Catalyst pushes that filter to the scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import count_if, mean_or_zero, round2, trend, truthy
from ..functions.times import days_before, moment, month_start, seconds_between, whole_days_between


def done():  # noqa: ANN201
    return F.col("status") == "completed"


def owned_reviews(reviews: DataFrame, repositories: DataFrame) -> DataFrame:
    """Reviews with the owner of their repository."""
    return reviews.join(repositories.select(F.col("id").alias("repository_id"), "owner_id"), "repository_id")


def quality_series(reviews: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Scores of completed reviews of the last ``days`` days that have a quality score, oldest first per repository; zeros stay."""
    recent = reviews.where(done() & (F.col("completed_at") >= days_before(as_of, days)) & F.col("code_quality_score").isNotNull())
    return recent.select("repository_id", F.col("id").alias("review_id"), F.col("completed_at").alias("date"), F.col("code_quality_score").alias("quality_score"), "security_score", "total_issues", "critical_issues").orderBy("repository_id", "date", "review_id")


def overview(users: DataFrame, repositories: DataFrame, reviews: DataFrame, as_of: str) -> DataFrame:
    """One row per user: review counts, issue sums and mean scores of completed reviews, repository counts; zeros without any."""
    per_repo = reviews.groupBy("repository_id").agg(
        F.count("*").alias("n"),
        count_if(done()).alias("n_done"),
        count_if(F.col("created_at") >= month_start(as_of)).alias("n_month"),
        F.sum(F.when(done(), F.col("total_issues"))).alias("issues"),
        F.sum(F.when(done(), F.col("critical_issues"))).alias("critical"),
        *[x for s in ("code_quality", "security", "performance") for x in (F.sum(F.when(done(), F.col(f"{s}_score"))).alias(f"{s}_sum"), F.count(F.when(done(), F.col(f"{s}_score"))).alias(f"{s}_n"))],
    )
    joined = repositories.select(F.col("id").alias("repository_id"), "owner_id", "is_active", "is_archived").join(per_repo, "repository_id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    mean = lambda s: F.coalesce(round2(F.sum(f"{s}_sum") / F.sum(f"{s}_n")), F.lit(0.0))
    per_owner = joined.groupBy("owner_id").agg(
        total("n").alias("total_reviews"),
        total("n_done").alias("completed_reviews"),
        total("issues").alias("total_issues"),
        total("critical").alias("critical_issues"),
        mean("code_quality").alias("avg_quality"),
        mean("security").alias("avg_security"),
        mean("performance").alias("avg_performance"),
        total("n_month").alias("reviews_this_month"),
        F.count("*").alias("repositories_count"),
        count_if(F.col("is_active") & ~F.col("is_archived")).alias("active_repositories"),
    )
    out = users.select(F.col("id").alias("owner_id")).join(per_owner, "owner_id", "left")
    return out.na.fill(0).na.fill(0.0)


def recent(reviews: DataFrame, repositories: DataFrame, as_of: str, limit: int = 10) -> DataFrame:
    """The newest reviews of each owner in the last 30 days, numbered from the newest; ties by id, larger first."""
    order = Window.partitionBy("owner_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    late = owned_reviews(reviews.where((F.col("created_at") >= days_before(as_of, 30))), repositories)
    return late.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def dashboard(reviews: DataFrame, repositories: DataFrame, as_of: str) -> DataFrame:
    """Per owner: how many of the newest ten reviews are of the last week, and the direction that gives."""
    weekly = count_if(F.col("created_at") >= days_before(as_of, 7))
    return recent(reviews, repositories, as_of).groupBy("owner_id").agg(F.count("*").alias("recent_reviews"), weekly.alias("weekly_reviews"), F.when(weekly > 0, "up").otherwise("stable").alias("trend"))


def per_repository(repositories: DataFrame, reviews: DataFrame) -> DataFrame:
    """Every repository with its number of reviews and the status and date of its latest one (ties: the larger id)."""
    latest = F.max_by(F.struct("status", "created_at"), F.struct("created_at", "id"))
    counted = reviews.groupBy(F.col("repository_id").alias("id")).agg(F.count("*").alias("review_count"), latest.alias("latest"))
    out = repositories.select("id", "owner_id", "name", "language", "is_active").join(counted, "id", "left")
    return out.select("id", "owner_id", "name", "language", "is_active", F.coalesce("review_count", F.lit(0)).alias("review_count"), F.col("latest.status").alias("last_status"), F.col("latest.created_at").alias("last_review"))


def top_languages(repositories: DataFrame, limit: int = 5) -> DataFrame:
    """Each owner's most frequent languages; null and empty are renamed after they are counted apart (ties by name, null last)."""
    counts = repositories.groupBy("owner_id", "language").agg(F.count("*").alias("repositories"))
    order = Window.partitionBy("owner_id").orderBy(F.col("repositories").desc(), F.col("language").asc_nulls_last())
    named = F.when(F.coalesce(F.col("language"), F.lit("")) == "", "Unknown").otherwise(F.col("language"))
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("owner_id", "place", named.alias("language"), "repositories")


def quality_trends(users: DataFrame, repositories: DataFrame, reviews: DataFrame, as_of: str, days: int = 90, band: float = 5.0) -> DataFrame:
    """Mean quality of the older and the newer half of each owner's completed reviews in the window, and the direction.

    The older half is rounded down.  Fewer than two: insufficient_data; an owner without repositories: stable.
    """
    scored = reviews.where(done() & F.col("code_quality_score").isNotNull() & (F.col("created_at") >= days_before(as_of, days)))
    own = owned_reviews(scored, repositories)
    order = Window.partitionBy("owner_id").orderBy("created_at", "id")
    placed = own.withColumn("place", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("owner_id")))
    old = F.col("place") <= F.floor(F.col("n") / 2)
    halves = placed.groupBy("owner_id").agg(F.max("n").alias("n"), F.avg(F.when(old, F.col("code_quality_score"))).alias("a"), F.avg(F.when(~old, F.col("code_quality_score"))).alias("b"))
    owners = repositories.select("owner_id").distinct().withColumn("has", F.lit(True))
    out = users.select(F.col("id").alias("owner_id")).join(owners, "owner_id", "left").join(halves, "owner_id", "left")
    enough = F.coalesce("n", F.lit(0)) >= 2
    change = F.col("b") - F.col("a")
    return out.select(
        "owner_id",
        F.when(F.col("has").isNull(), "stable").when(~enough, "insufficient_data").otherwise(trend(change, band)).alias("trend"),
        F.when(enough, round2(change)).otherwise(F.lit(0.0)).alias("improvement"),
        F.coalesce("n", F.lit(0)).cast("long").alias("data_points"),
    )


def performance(reviews: DataFrame, repositories: DataFrame, as_of: str) -> DataFrame:
    """Hours that completed reviews took, and how many were created in the last week, per owner."""
    hours = seconds_between("created_at", "updated_at") / 3600.0
    own = owned_reviews(reviews.where(done()), repositories).withColumn("hours", hours)
    return own.groupBy("owner_id").agg(
        mean_or_zero(F.col("hours")).alias("avg_hours"),
        round2(F.min("hours")).alias("min_hours"),
        round2(F.max("hours")).alias("max_hours"),
        count_if(F.col("created_at") >= days_before(as_of, 7)).alias("completed_last_week"),
    )


def last_places(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """The last rows of each key by time, numbered from the newest."""
    order = Window.partitionBy(key).orderBy(F.col("created_at").desc(), F.col("id").desc())
    return rows.withColumn("back", F.row_number().over(order)).where(F.col("back") <= limit)


def repository_stats(reviews: DataFrame) -> DataFrame:
    """Per repository: counts by status, mean scores (zeros left out), issues, last date, reviews a month, and trend.

    Reviews a month: n / (days / 30) with days of the whole span rounded down; null for one review or a span under a day.
    Trend: the newest of the last three completed reviews against the oldest of them; needs three scores, none of them zero.
    """
    at = F.coalesce("completed_at", "created_at")
    mean = lambda s: F.coalesce(round2(F.avg(F.when(done() & truthy(s), F.col(s)))), F.lit(0.0))
    span = whole_days_between(F.min("created_at"), F.max("created_at"))
    base = reviews.groupBy("repository_id").agg(
        F.count("*").alias("total_reviews"),
        count_if(done()).alias("completed_reviews"),
        count_if(F.col("status").isin("pending", "in_progress")).alias("pending_reviews"),
        count_if(F.col("status") == "failed").alias("failed_reviews"),
        mean("code_quality_score").alias("avg_quality"),
        mean("security_score").alias("avg_security"),
        F.coalesce(F.sum("total_issues"), F.lit(0)).cast("long").alias("total_issues"),
        F.max(at).alias("last_review_date"),
        F.when((F.count("*") > 1) & (span > 0), round2(F.count("*") / (span / 30.0))).alias("review_frequency"),
    )
    last = last_places(reviews.where(done()), "repository_id", 3)
    sums = last.groupBy("repository_id").agg(count_if(truthy("code_quality_score")).alias("good"), F.max(F.when(F.col("back") == 1, F.col("code_quality_score"))).alias("new"), F.max(F.when(F.col("back") == 3, F.col("code_quality_score"))).alias("old"))
    direction = F.when((F.col("good") == 3) & (F.col("new") > F.col("old")), "improving").when((F.col("good") == 3) & (F.col("new") < F.col("old")), "declining").otherwise("stable")
    return base.join(sums, "repository_id", "left").select(*base.columns, direction.alias("quality_trend"))


def review_statistics(reviews: DataFrame, repositories: DataFrame, band: float = 0.5) -> DataFrame:
    """Per owner: counts by status, mean scores (zeros left out), issue sums, mean minutes to completion, trend of the last five."""
    own = owned_reviews(reviews, repositories)
    minutes = seconds_between("created_at", "completed_at") / 60.0
    base = own.groupBy("owner_id").agg(
        F.count("*").alias("total_reviews"),
        *[count_if(F.col("status") == s).alias(f"{s}_reviews") for s in ("pending", "in_progress", "completed", "failed")],
        F.coalesce(round2(F.avg(F.when(done() & truthy("code_quality_score"), F.col("code_quality_score")))), F.lit(0.0)).alias("avg_quality"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("total_issues", "critical_issues", "high_issues")],
        F.coalesce(round2(F.avg(F.when(done(), minutes))), F.lit(0.0)).alias("avg_minutes"),
    )
    last = last_places(own.where(done()), "owner_id", 5)
    score = F.col("code_quality_score")
    sums = last.groupBy("owner_id").agg(count_if(truthy(score)).alias("good"), F.avg(F.when(F.col("back") >= 4, score)).alias("old"), F.avg(F.when(F.col("back") <= 2, score)).alias("new"))
    direction = F.when(F.col("good") == 5, trend(F.col("new") - F.col("old"), band)).otherwise("stable")
    return base.join(sums, "owner_id", "left").select(*base.columns, direction.alias("quality_trend"))


def issue_categories(issues: DataFrame, reviews: DataFrame, repositories: DataFrame, limit: int = 10) -> DataFrame:
    """Each owner's most frequent issue categories (ties by name)."""
    # categories are counted per review before owners are looked up
    counts = issues.groupBy("review_id", "category").agg(F.count("*").alias("n"))
    own = counts.join(owned_reviews(reviews.select(F.col("id").alias("review_id"), "repository_id"), repositories), "review_id")
    sums = own.groupBy("owner_id", "category").agg(F.sum("n").cast("long").alias("issues"))
    order = Window.partitionBy("owner_id").orderBy(F.col("issues").desc(), "category")
    return sums.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def resolved_issues(issues: DataFrame, reviews: DataFrame, repositories: DataFrame) -> DataFrame:
    """How many issues of each owner are resolved."""
    counts = issues.groupBy("review_id").agg(count_if(F.col("is_resolved")).alias("n"))
    own = counts.join(owned_reviews(reviews.select(F.col("id").alias("review_id"), "repository_id"), repositories), "review_id")
    return own.groupBy("owner_id").agg(F.sum("n").cast("long").alias("resolved_issues"))


def review_metrics(reviews: DataFrame) -> DataFrame:
    """Per repository: completion rate, issues a review, mean quality (zeros left out) and the last completion."""
    n = F.count("*")
    return reviews.groupBy("repository_id").agg(
        n.alias("total_reviews"),
        round2(count_if(done()) / n * 100.0).alias("completion_rate"),
        round2(F.coalesce(F.sum("total_issues"), F.lit(0)) / n).alias("issues_per_review"),
        F.coalesce(round2(F.avg(F.when(done() & truthy("code_quality_score"), F.col("code_quality_score")))), F.lit(0.0)).alias("avg_quality"),
        F.max(F.when(done(), F.col("completed_at"))).alias("last_completed"),
    )


def user_statistics(users: DataFrame, as_of: str) -> DataFrame:
    """One row: counts of users by state and provider, registrations since the first of the month at the current time of day, rates."""
    # the first of the month keeps the hour and minute of now
    start = month_start(as_of) + (moment(as_of) - F.date_trunc("day", moment(as_of)).cast("timestamp_ntz"))
    n, active, verified = F.count("*"), count_if(F.col("is_active")), count_if(F.col("is_verified"))
    rate = lambda part: F.when(n > 0, round2(part / n * 100.0)).otherwise(F.lit(0.0))
    return users.agg(
        n.alias("total_users"),
        active.alias("active_users"),
        verified.alias("verified_users"),
        count_if(F.col("github_id").isNotNull()).alias("github_users"),
        count_if(F.col("gitlab_id").isNotNull()).alias("gitlab_users"),
        count_if(F.col("created_at") >= start).alias("recent_registrations"),
        rate(active).alias("activation_rate"),
        rate(verified).alias("verification_rate"),
    )


def profile_stats(users: DataFrame, repositories: DataFrame, reviews: DataFrame) -> DataFrame:
    """Per user: repositories, reviews, mean quality (zeros left out), issues, and languages by frequency."""
    repos = repositories.groupBy("owner_id").agg(F.count("*").alias("total_repositories"), count_if(F.col("is_active")).alias("active_repositories"))
    own = owned_reviews(reviews, repositories).groupBy("owner_id").agg(
        F.count("*").alias("total_reviews"),
        count_if(done()).alias("completed_reviews"),
        round2(F.avg(F.when(done() & truthy("code_quality_score"), F.col("code_quality_score")))).alias("avg_quality"),
        F.sum("total_issues").alias("total_issues"),
    )
    languages = repositories.where(F.coalesce("language", F.lit("")) != "").groupBy("owner_id", "language").agg(F.count("*").alias("n"))
    listed = languages.groupBy("owner_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "language"))), lambda x: x["language"]), ",").alias("languages"))
    out = users.select(F.col("id").alias("owner_id"), "username").join(repos, "owner_id", "left").join(own, "owner_id", "left").join(listed, "owner_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("owner_id", "username", zero("total_repositories"), zero("active_repositories"), zero("total_reviews"), zero("completed_reviews"), F.coalesce("avg_quality", F.lit(0.0)).alias("avg_quality"), zero("total_issues"), F.coalesce("languages", F.lit("")).alias("languages"))
