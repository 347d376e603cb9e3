"""Queries over the entity views for the dashboards, each with the SQL that checks it."""

from __future__ import annotations

from ..entities import AS_OF, with_sql
from ..operators import dashboards as D
from .registry import register, tables

_T = f"TIMESTAMP '{AS_OF}'"
_OWNED = "owned AS (SELECT r.*, p.owner_id FROM reviews r JOIN repositories p ON r.repository_id = p.id)"
_MEAN = "coalesce(round(avg(CASE WHEN {when} THEN {c} END), 2), 0.0::DOUBLE)"


def _mean(c: str, when: str = "status = 'completed'", truthy: bool = False) -> str:
    return _MEAN.format(c=c, when=f"{when} AND {c} <> 0" if truthy else when)


@register(
    "overview",
    with_sql("users", "repositories", "reviews")
    + f""", {_OWNED},
r AS (SELECT owner_id, count(*) AS total_reviews, count(*) FILTER (WHERE status = 'completed') AS completed_reviews,
  CAST(coalesce(sum(total_issues) FILTER (WHERE status = 'completed'), 0) AS BIGINT) AS total_issues,
  CAST(coalesce(sum(critical_issues) FILTER (WHERE status = 'completed'), 0) AS BIGINT) AS critical_issues,
  {_mean("code_quality_score")} AS avg_quality, {_mean("security_score")} AS avg_security, {_mean("performance_score")} AS avg_performance,
  count(*) FILTER (WHERE created_at >= date_trunc('month', {_T})) AS reviews_this_month FROM owned GROUP BY owner_id),
p AS (SELECT owner_id, count(*) AS repositories_count, count(*) FILTER (WHERE is_active AND NOT is_archived) AS active_repositories FROM repositories GROUP BY owner_id)
SELECT u.id AS owner_id, coalesce(total_reviews, 0) AS total_reviews, coalesce(completed_reviews, 0) AS completed_reviews, coalesce(total_issues, 0) AS total_issues,
  coalesce(critical_issues, 0) AS critical_issues, coalesce(avg_quality, 0) AS avg_quality, coalesce(avg_security, 0) AS avg_security, coalesce(avg_performance, 0) AS avg_performance,
  coalesce(reviews_this_month, 0) AS reviews_this_month, coalesce(repositories_count, 0) AS repositories_count, coalesce(active_repositories, 0) AS active_repositories
FROM users u LEFT JOIN r ON r.owner_id = u.id LEFT JOIN p ON p.owner_id = u.id""",
)
def overview(spark, sf_dir):  # noqa: ANN001, ANN201
    return D.overview(*tables(spark, sf_dir, "users", "repositories", "reviews"), AS_OF)


_RECENT = f""", {_OWNED},
late AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY created_at DESC, id DESC) AS place FROM owned WHERE created_at >= {_T} - INTERVAL 30 DAY)"""


@register(
    "dashboard",
    with_sql("repositories", "reviews")
    + _RECENT
    + f""" SELECT owner_id, count(*) AS recent_reviews, count(*) FILTER (WHERE created_at >= {_T} - INTERVAL 7 DAY) AS weekly_reviews,
  CASE WHEN count(*) FILTER (WHERE created_at >= {_T} - INTERVAL 7 DAY) > 0 THEN 'up' ELSE 'stable' END AS trend FROM late WHERE place <= 10 GROUP BY owner_id""",
)
def dashboard(spark, sf_dir):  # noqa: ANN001, ANN201
    repos, reviews = tables(spark, sf_dir, "repositories", "reviews")
    return D.dashboard(reviews, repos, AS_OF)


@register("recent_reviews", with_sql("repositories", "reviews") + _RECENT + " SELECT owner_id, place, id, title, status, progress, total_issues FROM late WHERE place <= 10")
def recent_reviews(spark, sf_dir):  # noqa: ANN001, ANN201
    repos, reviews = tables(spark, sf_dir, "repositories", "reviews")
    return D.recent(reviews, repos, AS_OF).select("owner_id", "place", "id", "title", "status", "progress", "total_issues")


@register(
    "repository_analytics",
    with_sql("repositories", "reviews")
    + """, r AS (SELECT repository_id, count(*) AS n, arg_max(status, (created_at, id)) AS s, max(created_at) AS t FROM reviews GROUP BY repository_id)
SELECT p.id, owner_id, name, language, is_active, coalesce(n, 0) AS review_count, s AS last_status, CAST(t AS DATE) AS last_review FROM repositories p LEFT JOIN r ON r.repository_id = p.id""",
)
def repository_analytics(spark, sf_dir):  # noqa: ANN001, ANN201
    df = D.per_repository(*tables(spark, sf_dir, "repositories", "reviews"))
    return df.withColumn("last_review", df.last_review.cast("date"))


@register(
    "top_languages",
    with_sql("repositories")
    + """, c AS (SELECT owner_id, language, count(*) AS repositories, row_number() OVER (PARTITION BY owner_id ORDER BY count(*) DESC, language NULLS LAST) AS place FROM repositories GROUP BY owner_id, language)
SELECT owner_id, CAST(place AS INTEGER) AS place, CASE WHEN coalesce(language, '') = '' THEN 'Unknown' ELSE language END AS language, repositories FROM c WHERE place <= 5""",
)
def top_languages(spark, sf_dir):  # noqa: ANN001, ANN201
    return D.top_languages(*tables(spark, sf_dir, "repositories"))


def _trends_sql(days: int) -> str:
    return (
        with_sql("users", "repositories", "reviews")
        + f""", {_OWNED},
s AS (SELECT owner_id, code_quality_score AS q, row_number() OVER (PARTITION BY owner_id ORDER BY created_at, id) AS place, count(*) OVER (PARTITION BY owner_id) AS n
  FROM owned WHERE status = 'completed' AND code_quality_score IS NOT NULL AND created_at >= {_T} - INTERVAL {days} DAY),
h AS (SELECT owner_id, max(n) AS n, avg(q) FILTER (WHERE place <= n // 2) AS a, avg(q) FILTER (WHERE place > n // 2) AS b FROM s GROUP BY owner_id)
SELECT u.id AS owner_id, CASE WHEN NOT EXISTS (SELECT 1 FROM repositories p WHERE p.owner_id = u.id) THEN 'stable' WHEN coalesce(n, 0) < 2 THEN 'insufficient_data'
  WHEN b - a > 5 THEN 'improving' WHEN b - a < -5 THEN 'declining' ELSE 'stable' END AS trend,
  CASE WHEN coalesce(n, 0) >= 2 THEN round(b - a, 2) ELSE 0.0::DOUBLE END AS improvement, coalesce(n, 0) AS data_points FROM users u LEFT JOIN h ON h.owner_id = u.id"""
    )


@register("quality_trends", _trends_sql(90))
def quality_trends(spark, sf_dir):  # noqa: ANN001, ANN201
    return D.quality_trends(*tables(spark, sf_dir, "users", "repositories", "reviews"), AS_OF)


@register(
    "performance_analytics",
    with_sql("repositories", "reviews")
    + f""", {_OWNED}, h AS (SELECT *, epoch_us(updated_at) / 3.6e9::DOUBLE - epoch_us(created_at) / 3.6e9::DOUBLE AS x, (epoch_us(updated_at) - epoch_us(created_at)) / 3600000000.0::DOUBLE AS hours FROM owned WHERE status = 'completed')
SELECT owner_id, coalesce(round(avg(hours), 2), 0) AS avg_hours, round(min(hours), 2) AS min_hours, round(max(hours), 2) AS max_hours,
  count(*) FILTER (WHERE created_at >= {_T} - INTERVAL 7 DAY) AS completed_last_week FROM h GROUP BY owner_id""",
)
def performance_analytics(spark, sf_dir):  # noqa: ANN001, ANN201
    repos, reviews = tables(spark, sf_dir, "repositories", "reviews")
    return D.performance(reviews, repos, AS_OF)


@register(
    "repository_stats",
    with_sql("reviews")
    + f""", l AS (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY created_at DESC, id DESC) AS back FROM reviews WHERE status = 'completed'),
t AS (SELECT repository_id, count(*) FILTER (WHERE code_quality_score <> 0) AS good, max(code_quality_score) FILTER (WHERE back = 1) AS new, max(code_quality_score) FILTER (WHERE back = 3) AS old FROM l WHERE back <= 3 GROUP BY repository_id),
b AS (SELECT repository_id, count(*) AS total_reviews, count(*) FILTER (WHERE status = 'completed') AS completed_reviews, count(*) FILTER (WHERE status IN ('pending', 'in_progress')) AS pending_reviews,
  count(*) FILTER (WHERE status = 'failed') AS failed_reviews, {_mean("code_quality_score", truthy=True)} AS avg_quality, {_mean("security_score", truthy=True)} AS avg_security,
  CAST(coalesce(sum(total_issues), 0) AS BIGINT) AS total_issues, CAST(max(coalesce(completed_at, created_at)) AS DATE) AS last_review_date,
  floor((epoch_us(max(created_at)) - epoch_us(min(created_at))) / 86400000000.0::DOUBLE) AS span FROM reviews GROUP BY repository_id)
SELECT b.repository_id, total_reviews, completed_reviews, pending_reviews, failed_reviews, avg_quality, avg_security, total_issues, last_review_date,
  CASE WHEN total_reviews > 1 AND span > 0 THEN round(total_reviews / (span / 30.0::DOUBLE), 2) END AS review_frequency,
  CASE WHEN good = 3 AND new > old THEN 'improving' WHEN good = 3 AND new < old THEN 'declining' ELSE 'stable' END AS quality_trend FROM b LEFT JOIN t ON t.repository_id = b.repository_id""",
)
def repository_stats(spark, sf_dir):  # noqa: ANN001, ANN201
    df = D.repository_stats(*tables(spark, sf_dir, "reviews"))
    return df.withColumn("last_review_date", df.last_review_date.cast("date"))


@register(
    "review_statistics",
    with_sql("repositories", "reviews")
    + f""", {_OWNED}, l AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY created_at DESC, id DESC) AS back FROM owned WHERE status = 'completed'),
t AS (SELECT owner_id, count(*) FILTER (WHERE code_quality_score <> 0) AS good, avg(code_quality_score) FILTER (WHERE back >= 4) AS old, avg(code_quality_score) FILTER (WHERE back <= 2) AS new FROM l WHERE back <= 5 GROUP BY owner_id),
b AS (SELECT owner_id, count(*) AS total_reviews, count(*) FILTER (WHERE status = 'pending') AS pending_reviews, count(*) FILTER (WHERE status = 'in_progress') AS in_progress_reviews,
  count(*) FILTER (WHERE status = 'completed') AS completed_reviews, count(*) FILTER (WHERE status = 'failed') AS failed_reviews, {_mean("code_quality_score", truthy=True)} AS avg_quality,
  CAST(coalesce(sum(total_issues), 0) AS BIGINT) AS total_issues, CAST(coalesce(sum(critical_issues), 0) AS BIGINT) AS critical_issues, CAST(coalesce(sum(high_issues), 0) AS BIGINT) AS high_issues,
  coalesce(round(avg(CASE WHEN status = 'completed' THEN (epoch_us(completed_at) - epoch_us(created_at)) / 60000000.0::DOUBLE END), 2), 0) AS avg_minutes FROM owned GROUP BY owner_id)
SELECT b.*, CASE WHEN good = 5 AND new - old > 0.5 THEN 'improving' WHEN good = 5 AND new - old < -0.5 THEN 'declining' ELSE 'stable' END AS quality_trend FROM b LEFT JOIN t ON t.owner_id = b.owner_id""",
)
def review_statistics(spark, sf_dir):  # noqa: ANN001, ANN201
    repos, reviews = tables(spark, sf_dir, "repositories", "reviews")
    return D.review_statistics(reviews, repos)


@register(
    "issue_categories",
    with_sql("repositories", "reviews", "issues")
    + """, c AS (SELECT owner_id, category, count(*) AS issues, CAST(row_number() OVER (PARTITION BY owner_id ORDER BY count(*) DESC, category) AS INTEGER) AS place
  FROM issues i JOIN reviews r ON i.review_id = r.id JOIN repositories p ON r.repository_id = p.id GROUP BY owner_id, category) SELECT * FROM c WHERE place <= 10""",
)
def issue_categories(spark, sf_dir):  # noqa: ANN001, ANN201
    repos, reviews, issues = tables(spark, sf_dir, "repositories", "reviews", "issues")
    return D.issue_categories(issues, reviews, repos)


@register(
    "resolved_issues",
    with_sql("repositories", "reviews", "issues") + " SELECT owner_id, count(*) FILTER (WHERE is_resolved) AS resolved_issues FROM issues i JOIN reviews r ON i.review_id = r.id JOIN repositories p ON r.repository_id = p.id GROUP BY owner_id",
)
def resolved_issues(spark, sf_dir):  # noqa: ANN001, ANN201
    repos, reviews, issues = tables(spark, sf_dir, "repositories", "reviews", "issues")
    return D.resolved_issues(issues, reviews, repos)


@register(
    "review_metrics",
    with_sql("reviews")
    + f""" SELECT repository_id, count(*) AS total_reviews, round(CAST(count(*) FILTER (WHERE status = 'completed') AS DOUBLE) / count(*) * 100.0::DOUBLE, 2) AS completion_rate,
  round(CAST(coalesce(sum(total_issues), 0) AS DOUBLE) / count(*), 2) AS issues_per_review, {_mean("code_quality_score", truthy=True)} AS avg_quality,
  CAST(max(completed_at) AS DATE) AS last_completed FROM reviews GROUP BY repository_id""",
)
def review_metrics(spark, sf_dir):  # noqa: ANN001, ANN201
    df = D.review_metrics(*tables(spark, sf_dir, "reviews"))
    return df.withColumn("last_completed", df.last_completed.cast("date"))


@register(
    "user_statistics",
    with_sql("users")
    + f""" SELECT count(*) AS total_users, count(*) FILTER (WHERE is_active) AS active_users, count(*) FILTER (WHERE is_verified) AS verified_users, count(*) FILTER (WHERE github_id IS NOT NULL) AS github_users,
  count(*) FILTER (WHERE gitlab_id IS NOT NULL) AS gitlab_users, count(*) FILTER (WHERE created_at >= date_trunc('month', {_T}) + ({_T} - date_trunc('day', {_T}))) AS recent_registrations,
  round(CAST(count(*) FILTER (WHERE is_active) AS DOUBLE) / count(*) * 100, 2) AS activation_rate, round(CAST(count(*) FILTER (WHERE is_verified) AS DOUBLE) / count(*) * 100, 2) AS verification_rate FROM users""",
)
def user_statistics(spark, sf_dir):  # noqa: ANN001, ANN201
    return D.user_statistics(*tables(spark, sf_dir, "users"), AS_OF)


@register(
    "profile_stats",
    with_sql("users", "repositories", "reviews")
    + f""", {_OWNED}, p AS (SELECT owner_id, count(*) AS n, count(*) FILTER (WHERE is_active) AS a FROM repositories GROUP BY owner_id),
r AS (SELECT owner_id, count(*) AS n, count(*) FILTER (WHERE status = 'completed') AS c, {_mean("code_quality_score", truthy=True)} AS q, CAST(coalesce(sum(total_issues), 0) AS BIGINT) AS i FROM owned GROUP BY owner_id),
l AS (SELECT owner_id, string_agg(language, ',' ORDER BY n DESC, language) AS s FROM (SELECT owner_id, language, count(*) AS n FROM repositories WHERE coalesce(language, '') <> '' GROUP BY owner_id, language) GROUP BY owner_id)
SELECT u.id AS owner_id, username, coalesce(p.n, 0) AS total_repositories, coalesce(p.a, 0) AS active_repositories, coalesce(r.n, 0) AS total_reviews, coalesce(r.c, 0) AS completed_reviews,
  coalesce(q, 0) AS avg_quality, coalesce(i, 0) AS total_issues, coalesce(s, '') AS languages FROM users u LEFT JOIN p ON p.owner_id = u.id LEFT JOIN r ON r.owner_id = u.id LEFT JOIN l ON l.owner_id = u.id""",
)
def profile_stats(spark, sf_dir):  # noqa: ANN001, ANN201
    return D.profile_stats(*tables(spark, sf_dir, "users", "repositories", "reviews"))
