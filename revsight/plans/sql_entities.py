"""Queries over the entity views for lists, joins, reports, client rows, writes and commits, each with its checking SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..entities import AS_OF, with_sql
from ..functions import paths as P
from ..functions.times import week_key
from ..operators import client, dashboards, gitstats, listing, relations, reports
from ..sources import updates
from .registry import register, tables

_OWNED = "owned AS (SELECT r.*, p.owner_id FROM reviews r JOIN repositories p ON r.repository_id = p.id)"
_RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"
_LAST = "CASE WHEN coalesce(line_end, 0) <> 0 THEN line_end ELSE line_start END"


@register(
    "weekly_trends",
    with_sql("repositories", "reviews")
    + f""", {_OWNED}, w AS (SELECT owner_id, strftime(created_at, '%Y-W%U') AS week, avg(code_quality_score) AS m FROM owned WHERE code_quality_score <> 0 GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY week) AS place, count(*) OVER (PARTITION BY owner_id) AS n FROM w),
h AS (SELECT owner_id, max(n) AS weeks, avg(m) FILTER (WHERE place <= n // 2) AS a, avg(m) FILTER (WHERE place > n // 2) AS b FROM p GROUP BY owner_id),
c AS (SELECT owner_id, count(*) AS data_points FROM owned GROUP BY owner_id)
SELECT c.owner_id, CASE WHEN data_points < 2 THEN 'insufficient_data' WHEN coalesce(weeks, 0) < 2 THEN 'stable' WHEN b - a > 0.5 THEN 'improving' WHEN b - a < -0.5 THEN 'declining' ELSE 'stable' END AS trend,
  CASE WHEN coalesce(weeks, 0) < 2 THEN 0 ELSE round(b - a, 2) END AS change, coalesce(weeks, 0) AS weeks, data_points FROM c LEFT JOIN h ON h.owner_id = c.owner_id""",
)
def weekly_trends(spark, sf_dir):  # noqa: ANN001, ANN201
    repos, reviews = tables(spark, sf_dir, "repositories", "reviews")
    return reports.weekly_trends(reviews, repos)


@register("week_keys", with_sql("reviews") + " SELECT strftime(created_at, '%Y-W%U') AS week, count(*) AS reviews FROM reviews GROUP BY ALL")
def week_keys(spark, sf_dir):  # noqa: ANN001, ANN201
    return tables(spark, sf_dir, "reviews")[0].groupBy(week_key("created_at").alias("week")).agg(F.count("*").alias("reviews"))


@register(
    "issue_patterns",
    with_sql("issues")
    + """ SELECT 'category' AS dimension, category AS value, count(*) AS issues FROM issues GROUP BY ALL UNION ALL SELECT 'severity', severity, count(*) FROM issues GROUP BY ALL
UNION ALL SELECT 'extension', CASE WHEN contains(file_path, '.') THEN string_split(file_path, '.')[-1] ELSE 'unknown' END, count(*) FROM issues GROUP BY ALL""",
)
def issue_patterns(spark, sf_dir):  # noqa: ANN001, ANN201
    return reports.issue_patterns(*tables(spark, sf_dir, "issues"))


@register(
    "issue_pattern_summary",
    with_sql("issues")
    + """, c AS (SELECT category, count(*) AS n, count(*) FILTER (WHERE is_resolved) AS r FROM issues GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS total_issues, (SELECT category FROM c ORDER BY n DESC, category LIMIT 1) AS most_common_category, round(CAST(sum(r) AS DOUBLE) / sum(n) * 100.0::DOUBLE, 2) AS resolution_rate FROM c""",
)
def issue_pattern_summary(spark, sf_dir):  # noqa: ANN001, ANN201
    return reports.pattern_summary(*tables(spark, sf_dir, "issues"))


@register(
    "recommendations",
    with_sql("repositories", "reviews")
    + f""", {_OWNED}, f AS (SELECT owner_id, coalesce(avg(code_quality_score) FILTER (WHERE code_quality_score <> 0), 0) AS q, coalesce(avg(security_score) FILTER (WHERE security_score <> 0), 0) AS s,
  coalesce(sum(critical_issues), 0) AS c, count(*) AS n, CAST(count(*) FILTER (WHERE status = 'completed') AS DOUBLE) / count(*) AS d FROM owned GROUP BY owner_id)
SELECT owner_id, 'code_quality' AS area, 'high' AS priority FROM f WHERE q < 7 UNION ALL SELECT owner_id, 'security', 'high' FROM f WHERE s < 8
UNION ALL SELECT owner_id, 'critical_issues', 'high' FROM f WHERE c > 2 * n UNION ALL SELECT owner_id, 'process', 'medium' FROM f WHERE d < 0.8::DOUBLE""",
)
def recommendations(spark, sf_dir):  # noqa: ANN001, ANN201
    repos, reviews = tables(spark, sf_dir, "repositories", "reviews")
    return reports.recommendations(reviews, repos)


_QUALITY = """, c AS (SELECT review_id, count(*) AS total, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high,
  count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low, count(*) FILTER (WHERE category = 'security') AS security,
  count(*) FILTER (WHERE category = 'maintainability') AS maintainability, count(*) FILTER (WHERE category = 'performance') AS performance FROM issues GROUP BY review_id),
q AS (SELECT r.id AS review_id, coalesce(total, 0) AS total, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low,
  coalesce(security, 0) AS security, coalesce(maintainability, 0) AS maintainability, coalesce(performance, 0) AS performance, CAST(greatest(total_files, 1) AS DOUBLE) AS f FROM reviews r LEFT JOIN c ON c.review_id = r.id)"""


@register(
    "quality_metrics",
    with_sql("reviews", "issues")
    + _QUALITY
    + """ SELECT review_id, total, critical, high, medium, low, security, maintainability, performance,
  round(greatest(0::DOUBLE, 10 - (critical * 3.0::DOUBLE + high * 2 + medium + low * 0.5::DOUBLE) / f), 2) AS code_quality_score, round(greatest(0::DOUBLE, 10 - security * 2.0::DOUBLE / f), 2) AS security_score,
  round(greatest(0::DOUBLE, 10 - (maintainability * 1.5::DOUBLE + critical * 2) / f), 2) AS maintainability_score, round(greatest(0::DOUBLE, 10 - performance * 1.5::DOUBLE / f), 2) AS performance_score FROM q""",
)
def quality_metrics(spark, sf_dir):  # noqa: ANN001, ANN201
    reviews, issues = tables(spark, sf_dir, "reviews", "issues")
    return reports.quality_of(issues, reviews)


@register(
    "review_summary",
    with_sql("reviews", "issues")
    + _QUALITY
    + """ SELECT review_id, CASE WHEN critical > 0 THEN 'High' WHEN high > 5 THEN 'Medium' ELSE 'Low' END AS risk, CASE WHEN total > 10 THEN 'Needs Improvement' WHEN total > 3 THEN 'Good' ELSE 'Excellent' END AS overall,
  'Found ' || total || ' issues: ' || critical || ' critical, ' || high || ' high, ' || medium || ' medium, ' || low || ' low' AS summary FROM q""",
)
def review_summary(spark, sf_dir):  # noqa: ANN001, ANN201
    reviews, issues = tables(spark, sf_dir, "reviews", "issues")
    return reports.summary(reports.quality_of(issues, reviews))


_ADVICE = " ".join(f"WHEN '{k}' THEN '{{}}'" for k in reports.ADVICE)


@register(
    "advice",
    with_sql("issues")
    + f""" SELECT review_id, category, CASE category {_ADVICE.format(*[v[0] for v in reports.ADVICE.values()])} END AS priority, CASE category {_ADVICE.format(*[v[1] for v in reports.ADVICE.values()])} END AS advice,
  count(*) AS issues FROM issues WHERE category IN ({", ".join(f"'{k}'" for k in reports.ADVICE)}) GROUP BY review_id, category""",
)
def advice(spark, sf_dir):  # noqa: ANN001, ANN201
    return reports.advice(*tables(spark, sf_dir, "issues"))


@register(
    "list_repositories",
    with_sql("repositories")
    + """, o AS (SELECT *, row_number() OVER (ORDER BY last_analysis DESC NULLS FIRST, created_at DESC, id) AS place FROM repositories
  WHERE owner_id < 20 AND (name ILIKE '%01%' OR full_name ILIKE '%01%' OR coalesce(description ILIKE '%01%', FALSE)) AND is_active AND provider = 'github') SELECT id, name, language FROM o WHERE place > 3 AND place <= 53""",
)
def list_repositories(spark, sf_dir):  # noqa: ANN001, ANN201
    df = tables(spark, sf_dir, "repositories")[0].where("owner_id < 20")
    return listing.page(listing.repositories(df, search="01", provider="github", is_active=True), 3, 50).select("id", "name", "language")


@register(
    "list_reviews",
    with_sql("repositories", "reviews")
    + f""", {_OWNED}, o AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, id DESC) AS place FROM owned WHERE owner_id = 3 AND status = 'completed')
SELECT id, title, status, repository_id, total_issues FROM o WHERE place > 10 AND place <= 110""",
)
def list_reviews(spark, sf_dir):  # noqa: ANN001, ANN201
    repos, reviews = tables(spark, sf_dir, "repositories", "reviews")
    return listing.page(listing.reviews(reviews, repos, owner_id=3, status="completed"), 10, 100).select("id", "title", "status", "repository_id", "total_issues")


@register(
    "list_issues",
    with_sql("issues")
    + f""", o AS (SELECT *, row_number() OVER (ORDER BY {_RANK} DESC, file_path, line_start, id) AS place FROM issues WHERE category = 'security' AND NOT is_resolved) SELECT id, severity, file_path, line_start FROM o WHERE place <= 1000""",
)
def list_issues(spark, sf_dir):  # noqa: ANN001, ANN201
    return listing.page(listing.issues(tables(spark, sf_dir, "issues")[0], severity="nonsense", category="security", resolved=False), 0, 1000).select("id", "severity", "file_path", "line_start")


@register("list_users", with_sql("users") + " SELECT id, username, email FROM users WHERE (email ILIKE '%an%' OR username ILIKE '%an%' OR full_name ILIKE '%an%') AND is_active ORDER BY username DESC LIMIT 10")
def list_users(spark, sf_dir):  # noqa: ANN001, ANN201
    return listing.page(listing.users(tables(spark, sf_dir, "users")[0], "AN", "username", True, is_active=True), 0, 10).select("id", "username", "email")


@register("reviews_in_range", with_sql("reviews") + " SELECT id, status FROM reviews WHERE created_at BETWEEN TIMESTAMP '1999-01-01' AND TIMESTAMP '1999-06-30'")
def reviews_in_range(spark, sf_dir):  # noqa: ANN001, ANN201
    return listing.between(tables(spark, sf_dir, "reviews")[0], "1999-01-01 00:00:00", "1999-06-30 00:00:00").select("id", "status")


@register(
    "prioritised_issues",
    with_sql("issues") + f""", o AS (SELECT review_id, id, row_number() OVER (PARTITION BY review_id ORDER BY {_RANK} DESC, coalesce(confidence_score, 0.5::DOUBLE) DESC, id) AS place FROM issues) SELECT review_id, id FROM o WHERE place <= 5""",
)
def prioritised_issues(spark, sf_dir):  # noqa: ANN001, ANN201
    from pyspark.sql import Window

    from ..functions.scores import severity_rank

    order = Window.partitionBy("review_id").orderBy(severity_rank("severity").desc(), F.coalesce("confidence_score", F.lit(0.5)).desc(), "id")
    return tables(spark, sf_dir, "issues")[0].withColumn("place", F.row_number().over(order)).where("place <= 5").select("review_id", "id")


@register("client_issues", with_sql("issues") + " SELECT id, severity FROM issues WHERE (contains(lower(title), 'finding 1') OR contains(lower(description), 'finding 1') OR contains(lower(file_path), 'finding 1')) AND severity = 'high' AND NOT is_resolved AND NOT is_false_positive")
def client_issues(spark, sf_dir):  # noqa: ANN001, ANN201
    return listing.client_issues(tables(spark, sf_dir, "issues")[0], "Finding 1", "high", None, "open").select("id", "severity")


@register("connected", with_sql("repositories") + " SELECT c_custkey AS id, EXISTS (SELECT 1 FROM repositories p WHERE p.external_id = CAST(c_custkey AS VARCHAR)) AS is_connected FROM customer")
def connected(spark, sf_dir):  # noqa: ANN001, ANN201
    available = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"))
    return relations.connected(available, *tables(spark, sf_dir, "repositories"))


@register("duplicate_connections", with_sql("repositories") + " SELECT owner_id, provider, external_id, count(*) AS n FROM repositories GROUP BY ALL HAVING count(*) > 1")
def duplicate_connections(spark, sf_dir):  # noqa: ANN001, ANN201
    return relations.duplicate_connections(*tables(spark, sf_dir, "repositories"))


@register("visible_reviews", with_sql("repositories", "reviews") + f", {_OWNED} SELECT id, status FROM owned WHERE owner_id = 7")
def visible_reviews(spark, sf_dir):  # noqa: ANN001, ANN201
    repos, reviews = tables(spark, sf_dir, "repositories", "reviews")
    return relations.visible(reviews, repos, 7).select("id", "status")


@register(
    "named_reviews",
    with_sql("repositories", "reviews")
    + " SELECT r.id, coalesce(p.full_name, 'Repository ' || r.repository_id) AS repository_name, coalesce(p.provider, 'github') AS provider FROM reviews r LEFT JOIN (SELECT * FROM repositories WHERE id % 2 = 0) p ON p.id = r.repository_id",
)
def named_reviews(spark, sf_dir):  # noqa: ANN001, ANN201
    repos, reviews = tables(spark, sf_dir, "repositories", "reviews")
    return relations.named(reviews, repos.where("id % 2 = 0")).select("id", "repository_name", "provider")


_THREADS = """, r AS (SELECT parent_id, count(*) AS replies, string_agg(CAST(id AS VARCHAR), ',' ORDER BY created_at, id) AS reply_ids, bool_or(comment_type = 'question') AS asked FROM comments WHERE coalesce(parent_id, 0) <> 0 GROUP BY parent_id),
t AS (SELECT c.id, c.comment_type, coalesce(replies, 0) AS replies, coalesce(reply_ids, '') AS reply_ids, coalesce(asked, FALSE) AS asked FROM comments c LEFT JOIN r ON r.parent_id = c.id WHERE coalesce(c.parent_id, 0) = 0)"""


def _shown(df):  # noqa: ANN001, ANN202
    replies = F.coalesce("replies", F.array().cast(df.schema["replies"].dataType))
    return df.select("id", "comment_type", F.size(replies).cast("long").alias("replies"), F.array_join(F.transform(replies, lambda r: r["id"].cast("string")), ",").alias("reply_ids"))


@register("comment_threads", with_sql("comments") + _THREADS + " SELECT id, comment_type, replies, reply_ids FROM t")
def comment_threads(spark, sf_dir):  # noqa: ANN001, ANN201
    return _shown(relations.threads(*tables(spark, sf_dir, "comments")))


@register("threads_of_type", with_sql("comments") + _THREADS + " SELECT id, comment_type, replies, reply_ids FROM t WHERE comment_type = 'question' OR asked")
def threads_of_type(spark, sf_dir):  # noqa: ANN001, ANN201
    return _shown(relations.threads_of_type(relations.threads(*tables(spark, sf_dir, "comments")), "question"))


@register(
    "issues_on_lines",
    with_sql("issues") + f""", l AS (SELECT DISTINCT review_id, file_path, line_start AS line FROM issues)
SELECT l.review_id, l.file_path, l.line, i.id AS issue_id, i.severity FROM l JOIN issues i ON i.review_id = l.review_id AND i.file_path = l.file_path AND l.line BETWEEN i.line_start AND {_LAST}""",
)
def issues_on_lines(spark, sf_dir):  # noqa: ANN001, ANN201
    issues = tables(spark, sf_dir, "issues")[0]
    lines = issues.select("review_id", "file_path", F.col("line_start").alias("line")).distinct()
    return relations.issues_on_lines(issues, lines, "review_id", "file_path")


@register(
    "full_reviews",
    with_sql("repositories", "reviews", "issues", "comments")
    + """, i AS (SELECT review_id, count(*) AS n, min(id) AS first FROM issues GROUP BY review_id), c AS (SELECT review_id, count(*) AS n FROM comments GROUP BY review_id)
SELECT r.id AS review_id, p.full_name AS repository, coalesce(i.n, 0) AS issues, i.first AS first_issue, coalesce(c.n, 0) AS comments FROM reviews r LEFT JOIN i ON i.review_id = r.id LEFT JOIN c ON c.review_id = r.id LEFT JOIN repositories p ON p.id = r.repository_id""",
)
def full_reviews(spark, sf_dir):  # noqa: ANN001, ANN201
    repos, reviews, issues, comments = tables(spark, sf_dir, "repositories", "reviews", "issues", "comments")
    df = relations.full_review(reviews, issues, comments, repos)
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long").alias(c)
    return df.select("review_id", "repository", size("issues"), F.get("issues", F.lit(0))["id"].alias("first_issue"), size("comments"))


@register("issue_stats", with_sql("issues") + """ SELECT review_id, count(*) AS total, count(*) FILTER (WHERE is_resolved) AS resolved, count(*) FILTER (WHERE is_false_positive) AS false_positive,
  count(*) - count(*) FILTER (WHERE is_resolved) - count(*) FILTER (WHERE is_false_positive) AS open, count(*) FILTER (WHERE severity = 'critical' AND NOT is_resolved AND NOT is_false_positive) AS open_critical FROM issues GROUP BY review_id""")
def issue_stats(spark, sf_dir):  # noqa: ANN001, ANN201
    return client.issue_stats(*tables(spark, sf_dir, "issues"))


@register("comment_counts", with_sql("comments") + """ SELECT review_id, count(*) AS "all", """ + ", ".join(f"count(*) FILTER (WHERE comment_type = '{k}') AS {k}" for k in ("general", "suggestion", "question", "issue")) + " FROM comments GROUP BY review_id")
def comment_counts(spark, sf_dir):  # noqa: ANN001, ANN201
    return client.comment_counts(*tables(spark, sf_dir, "comments"))


@register(
    "file_tree",
    with_sql("issues") + """, f AS (SELECT review_id, file_path, count(*) AS n, string_split(file_path, '/') AS parts FROM issues GROUP BY ALL), x AS (SELECT review_id, n, array_to_string(parts[1:k], '/') AS folder FROM f, range(1, 10) t(k) WHERE k < len(parts))
SELECT review_id, folder, CAST(sum(n) AS BIGINT) AS issues, count(*) AS files, CAST(sum(n) * count(*) AS BIGINT) AS compat FROM x GROUP BY ALL""",
)
def file_tree(spark, sf_dir):  # noqa: ANN001, ANN201
    return client.file_tree(*tables(spark, sf_dir, "issues"))


@register(
    "trend_percent",
    with_sql("reviews") + """ SELECT repository_id, round((arg_max(code_quality_score, (created_at, id)) - arg_min(code_quality_score, (created_at, id))) / arg_min(code_quality_score, (created_at, id)) * 100.0::DOUBLE, 2) AS trend_percent, count(*) AS points
FROM reviews WHERE code_quality_score > 0 GROUP BY repository_id""",
)
def trend_percent(spark, sf_dir):  # noqa: ANN001, ANN201
    return client.trend_percent(tables(spark, sf_dir, "reviews")[0], "repository_id", "created_at", "code_quality_score")


@register("bulk_update", with_sql("issues") + " SELECT id, CASE WHEN id % 3 = 0 THEN FALSE ELSE is_resolved END AS is_resolved, CASE WHEN id % 3 = 0 THEN TRUE ELSE is_false_positive END AS is_false_positive FROM issues")
def bulk_update(spark, sf_dir):  # noqa: ANN001, ANN201
    issues = tables(spark, sf_dir, "issues")[0]
    return client.bulk_update(issues, issues.where("id % 3 = 0").select("id"), "false_positive").select("id", "is_resolved", "is_false_positive")


@register("activity_feed", with_sql("repositories") + " SELECT id, 'repository' AS kind, 'Connected ' || name AS text FROM repositories ORDER BY id LIMIT 5")
def activity_feed(spark, sf_dir):  # noqa: ANN001, ANN201
    return client.activity(*tables(spark, sf_dir, "repositories"))


@register(
    "dashboard_rates",
    with_sql("repositories", "reviews") + f""", {_OWNED}, r AS (SELECT owner_id, count(*) AS n, count(*) FILTER (WHERE status = 'completed') AS d, coalesce(sum(total_issues) FILTER (WHERE status = 'completed'), 0) AS i, coalesce(sum(critical_issues) FILTER (WHERE status = 'completed'), 0) AS c FROM owned GROUP BY owner_id),
p AS (SELECT owner_id, count(*) AS n, count(*) FILTER (WHERE is_active AND NOT is_archived) AS a FROM repositories GROUP BY owner_id)
SELECT u.n_nationkey::BIGINT AS owner_id, CASE WHEN coalesce(r.n, 0) > 0 THEN round(CAST(r.d AS DOUBLE) / r.n * 100.0::DOUBLE, 2) ELSE 0::DOUBLE END AS completion_rate, CASE WHEN coalesce(r.i, 0) > 0 THEN round(CAST(r.c AS DOUBLE) / r.i * 100.0::DOUBLE, 2) ELSE 0::DOUBLE END AS critical_rate,
  CASE WHEN coalesce(p.n, 0) > 0 THEN round(CAST(p.a AS DOUBLE) / p.n * 100.0::DOUBLE, 2) ELSE 0::DOUBLE END AS active_rate FROM nation u LEFT JOIN r ON r.owner_id = u.n_nationkey LEFT JOIN p ON p.owner_id = u.n_nationkey""",
)
def dashboard_rates(spark, sf_dir):  # noqa: ANN001, ANN201
    return client.rates(dashboards.overview(*tables(spark, sf_dir, "users", "repositories", "reviews"), AS_OF))


@register(
    "update_status",
    with_sql("reviews") + f""" SELECT id, CASE WHEN id % 5 = 0 THEN 'completed' WHEN id % 5 = 1 THEN 'failed' ELSE status END AS status, CASE WHEN id % 5 = 0 THEN 1.0::DOUBLE ELSE progress END AS progress,
  CASE WHEN id % 5 = 0 THEN DATE '2001-08-01' ELSE CAST(completed_at AS DATE) END AS completed FROM reviews""",
)
def update_status(spark, sf_dir):  # noqa: ANN001, ANN201
    reviews = tables(spark, sf_dir, "reviews")[0]
    changes = reviews.where("id % 5 < 2").select("id", F.when(F.col("id") % 5 == 0, "completed").otherwise("failed").alias("status"))
    return updates.with_status(reviews, changes, AS_OF).select("id", "status", "progress", F.col("completed_at").cast("date").alias("completed"))


@register("update_progress", with_sql("reviews") + " SELECT id, CASE WHEN id % 2 = 0 THEN greatest(0::DOUBLE, least(1::DOUBLE, CAST(id % 30 - 10 AS DOUBLE) / 10.0::DOUBLE)) ELSE progress END AS progress FROM reviews")
def update_progress(spark, sf_dir):  # noqa: ANN001, ANN201
    reviews = tables(spark, sf_dir, "reviews")[0]
    return updates.with_progress(reviews, reviews.where("id % 2 = 0").select("id", ((F.col("id") % 30 - 10).cast("double") / 10.0).alias("progress"))).select("id", "progress")


@register("resolve_issues", with_sql("issues") + " SELECT id, CASE WHEN id % 4 = 0 THEN TRUE ELSE is_resolved END AS is_resolved, id % 4 = 0 AS stamped FROM issues")
def resolve_issues(spark, sf_dir):  # noqa: ANN001, ANN201
    issues = tables(spark, sf_dir, "issues")[0]
    changes = issues.where("id % 4 = 0").select("id", F.lit(True).alias("is_resolved"))
    return updates.issues_resolved(issues, changes, AS_OF).select("id", "is_resolved", F.col("resolved_at").isNotNull().alias("stamped"))


@register(
    "cascade_delete",
    with_sql("repositories", "reviews", "issues", "comments") + """, g AS (SELECT id FROM reviews WHERE repository_id % 3 = 0)
SELECT 'repositories' AS name, count(*) AS rows FROM repositories WHERE id % 3 <> 0 UNION ALL SELECT 'reviews', count(*) FROM reviews WHERE repository_id % 3 <> 0
UNION ALL SELECT 'issues', count(*) FROM issues WHERE review_id NOT IN (SELECT id FROM g) UNION ALL SELECT 'comments', count(*) FROM comments WHERE review_id NOT IN (SELECT id FROM g)""",
)
def cascade_delete(spark, sf_dir):  # noqa: ANN001, ANN201
    names = ("repositories", "reviews", "issues", "comments")
    held = dict(zip(names, tables(spark, sf_dir, *names)))
    left = updates.cascade(held, held["repositories"].where("id % 3 = 0"))
    out = None
    for n in names:
        one = left[n].agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


@register(
    "upsert_accounts",
    with_sql("users") + """, l AS (SELECT 'gh' || c_custkey AS account, CASE WHEN c_custkey < 30 THEN (SELECT max(email) FROM users WHERE id = (c_custkey + 1) % 25) ELSE 'New' || c_custkey || '@Example.org' END AS email, 'u' || c_custkey AS username FROM customer)
SELECT l.account, lower(l.email) AS email, l.username, coalesce(a.id, e.id) AS user_id, CASE WHEN a.id IS NOT NULL THEN 'update' WHEN e.id IS NOT NULL THEN 'link' ELSE 'insert' END AS action FROM l LEFT JOIN users a ON a.github_id = l.account LEFT JOIN users e ON e.email = lower(l.email)""",
)
def upsert_accounts(spark, sf_dir):  # noqa: ANN001, ANN201
    users = tables(spark, sf_dir, "users")[0]
    known = users.select(F.col("id").alias("k"), F.col("email").alias("known"))
    logins = spark.read.parquet(f"{sf_dir}/customer.parquet").join(known, (F.col("c_custkey") + 1) % 25 == F.col("k"), "left")
    logins = logins.select(F.concat(F.lit("gh"), "c_custkey").alias("account"), F.when(F.col("c_custkey") < 30, F.col("known")).otherwise(F.concat(F.lit("New"), "c_custkey", F.lit("@Example.org"))).alias("email"), F.concat(F.lit("u"), "c_custkey").alias("username"))
    return updates.upsert_accounts(users, logins, "github")


@register("merge_preferences", """SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN '{"digest":"weekly","theme":"dark","zoom":"' || c_custkey || '"}' ELSE '{"theme":"light","zoom":"' || c_custkey || '"}' END AS preferences FROM customer""")
def merge_preferences(spark, sf_dir):  # noqa: ANN001, ANN201
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    old = F.concat(F.lit('{"theme":"light","zoom":"'), "c_custkey", F.lit('"}'))
    new = F.when(F.col("c_custkey") % 2 == 0, '{"theme":"dark","digest":"weekly"}')
    return df.select(F.col("c_custkey").alias("id"), updates.merged_json(old, new).alias("preferences"))


@register(
    "contributors",
    with_sql("commits") + " SELECT repo_id, author_email, arg_max(author_name, (committed_at, sha)) AS author_name, count(*) AS commits, CAST(min(committed_at) AS DATE) AS first_commit, CAST(max(committed_at) AS DATE) AS last_commit, CAST(max(committed_at) AS DATE) AS compat_first FROM commits GROUP BY ALL",
)
def contributors(spark, sf_dir):  # noqa: ANN001, ANN201
    df = gitstats.contributors(*tables(spark, sf_dir, "commits"))
    return df.withColumns({c: F.col(c).cast("date") for c in ("first_commit", "last_commit", "compat_first")})


@register("activity_by_month", with_sql("commits") + " SELECT repo_id, strftime(committed_at, '%Y-%m') AS month, count(*) AS commits FROM commits GROUP BY ALL")
def activity_by_month(spark, sf_dir):  # noqa: ANN001, ANN201
    return gitstats.activity_by_month(*tables(spark, sf_dir, "commits"))


@register(
    "repository_summary",
    with_sql("commits") + " SELECT repo_id, count(*) AS total_commits, count(DISTINCT author_email) AS contributors, substr(arg_min(sha, (committed_at, sha)), 1, 8) AS first_sha, substr(arg_max(sha, (committed_at, sha)), 1, 8) AS last_sha, substr(arg_max(message, (committed_at, sha)), 1, 100) AS last_message FROM commits GROUP BY ALL",
)
def repository_summary(spark, sf_dir):  # noqa: ANN001, ANN201
    return gitstats.repository_summary(*tables(spark, sf_dir, "commits"))


@register(
    "file_types",
    with_sql("files") + """ SELECT lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS suffix, count(*) AS files, CASE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) WHEN '.py' THEN 'Python' ELSE 'JavaScript' END AS language, CAST(sum(len(string_split(content, chr(10)))) AS BIGINT) AS lines
FROM files WHERE regexp_matches(path, '[^/]\\.(py|js)$') GROUP BY ALL""",
)
def file_types(spark, sf_dir):  # noqa: ANN001, ANN201
    return gitstats.file_types(*tables(spark, sf_dir, "files"))


_TOUCHED = "t AS (SELECT DISTINCT repo_id, sha, path FROM (SELECT repo_id, sha, a_path AS path FROM file_changes UNION ALL SELECT repo_id, sha, b_path FROM file_changes) WHERE path IS NOT NULL)"


@register(
    "file_history",
    with_sql("commits", "file_changes") + f""", {_TOUCHED}, h AS (SELECT t.*, c.author_name, row_number() OVER (PARTITION BY t.repo_id, path ORDER BY committed_at DESC, t.sha) AS place FROM t JOIN commits c ON c.repo_id = t.repo_id AND c.sha = t.sha)
SELECT repo_id, path, sha, author_name, CAST(place AS INTEGER) AS place FROM h WHERE place <= 50""",
)
def file_history(spark, sf_dir):  # noqa: ANN001, ANN201
    commits, changes = tables(spark, sf_dir, "commits", "file_changes")
    return gitstats.history(changes, commits).select("repo_id", "path", "sha", "author_name", "place")


@register("changed_files", with_sql("file_changes") + f", {_TOUCHED} SELECT * FROM t")
def changed_files(spark, sf_dir):  # noqa: ANN001, ANN201
    return gitstats.changed_files(*tables(spark, sf_dir, "file_changes"))


@register(
    "change_summary",
    with_sql("file_changes") + """ SELECT repo_id, CASE WHEN a_path IS NULL THEN 'added' WHEN b_path IS NULL THEN 'deleted' WHEN a_path <> b_path THEN 'renamed' ELSE 'modified' END AS change, count(*) AS files,
  CAST(sum(additions) AS BIGINT) AS additions, CAST(sum(deletions) AS BIGINT) AS deletions FROM file_changes GROUP BY ALL""",
)
def change_summary(spark, sf_dir):  # noqa: ANN001, ANN201
    return gitstats.change_summary(*tables(spark, sf_dir, "file_changes"))


_NAME = "string_split(path, '/')[-1]"
_LISTED = lambda names: ", ".join(f"'{n}'" for n in names)


@register(
    "file_kinds",
    with_sql("files") + f""", s AS (SELECT *, lower(regexp_extract({_NAME}, '^.+(\\.[^.]+)$', 1)) AS sfx, {_NAME} AS name FROM files)
SELECT doc_id, sfx AS suffix, CASE sfx WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' ELSE 'unknown' END AS language,
  sfx IN ({_LISTED(P.CONFIG_SUFFIXES)}) OR lower(name) IN ({_LISTED(P.CONFIG_NAMES)}) OR starts_with(name, '.env') AS is_config, contains(lower(name), 'test') OR list_contains(string_split(path, '/'), 'test') AS is_test,
  name IN ({_LISTED(P.DEPENDENCY_NAMES)}) AS is_dependency, length(trim(content)) > 0 AND length(content) <= {P.MAX_BYTES} AND sfx IN ({_LISTED(P.ANALYSED)}) AS is_code FROM s""",
)
def file_kinds(spark, sf_dir):  # noqa: ANN001, ANN201
    df = tables(spark, sf_dir, "files")[0]
    return df.select("doc_id", P.suffix("path").alias("suffix"), P.language("path").alias("language"), P.is_config_file("path").alias("is_config"), P.is_test_file("path").alias("is_test"), P.is_dependency_file("path").alias("is_dependency"), P.is_code_file("path", "content").alias("is_code"))
