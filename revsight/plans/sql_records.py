"""Queries over the entity views for look-ups, new rows, counts, reports, replies and text forms, each with its checking SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..entities import AS_OF, with_sql
from ..functions import scores, texts, times
from ..operators import client, dashboards, gitstats, listing, relations, reports
from ..sources import readers, updates
from .registry import register, tables

_OWNED = "owned AS (SELECT r.*, p.owner_id FROM reviews r JOIN repositories p ON r.repository_id = p.id)"
_RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"


@register("user_lookups", with_sql("users") + " SELECT 'email' AS key, id FROM users WHERE email = 'nation_5@example.org' UNION ALL SELECT 'username', id FROM users WHERE username = 'nation_6' UNION ALL SELECT 'github', id FROM users WHERE github_id = 'gh8' UNION ALL SELECT 'id', id FROM users WHERE id = 3 AND is_verified")
def user_lookups(spark, sf_dir):  # noqa: ANN001, ANN201
    users = tables(spark, sf_dir, "users")[0]
    found = {"email": listing.by_email(users, "NATION_5@Example.org"), "username": listing.by_key(users, username="nation_6"), "github": listing.by_oauth(users, "github", "gh8"), "id": listing.by_key(users, id=3, is_verified=True), "none": listing.by_oauth(users, "elsewhere", "gh8")}
    out = None
    for name, df in found.items():
        one = df.select(F.lit(name).alias("key"), "id")
        out = one if out is None else out.unionByName(one)
    return out


@register("list_named_users", with_sql("users") + " SELECT id, username FROM users WHERE (email ILIKE '%n_1%' OR username ILIKE '%n_1%' OR full_name ILIKE '%n_1%') AND is_active")
def list_named_users(spark, sf_dir):  # noqa: ANN001, ANN201
    return listing.page(listing.users(tables(spark, sf_dir, "users")[0], "N_1", "username", True, is_active=True), 0, 100).select("id", "username")


@register("user_count", with_sql("users") + " SELECT count(*) AS users FROM users WHERE (email ILIKE '%a%' OR username ILIKE '%a%' OR full_name ILIKE '%a%') AND is_active AND is_verified")
def user_count(spark, sf_dir):  # noqa: ANN001, ANN201
    return listing.user_count(tables(spark, sf_dir, "users")[0], "A", is_active=True, is_verified=True)


@register("client_reviews", with_sql("reviews") + " SELECT id FROM reviews WHERE contains(lower(title), 'review 1') AND status = 'failed'")
def client_reviews(spark, sf_dir):  # noqa: ANN001, ANN201
    return listing.client_reviews(tables(spark, sf_dir, "reviews")[0], "REVIEW 1", "failed").select("id")


@register(
    "sorted_issues",
    with_sql("issues") + f" SELECT 'severity' AS by, id FROM (SELECT id FROM issues ORDER BY {_RANK} DESC, id LIMIT 50) UNION ALL SELECT 'category', id FROM (SELECT id FROM issues ORDER BY category, id LIMIT 50) UNION ALL SELECT 'file', id FROM (SELECT id FROM issues ORDER BY file_path DESC, id LIMIT 50) UNION ALL SELECT 'created', id FROM (SELECT id FROM issues ORDER BY created_at, id LIMIT 50)",
)
def sorted_issues(spark, sf_dir):  # noqa: ANN001, ANN201
    issues = tables(spark, sf_dir, "issues")[0]
    out = None
    for by, descending in (("severity", True), ("category", False), ("file", True), ("created", False)):
        one = listing.page(listing.sorted_issues(issues, by, descending), 0, 50).select(F.lit(by).alias("by"), "id")
        out = one if out is None else out.unionByName(one)
    return out


@register("duplicate_owners", with_sql("repositories") + " SELECT owner_id, provider, external_id, count(*) AS n FROM (SELECT owner_id, provider, CAST(id % 10 AS VARCHAR) AS external_id FROM repositories) GROUP BY ALL HAVING count(*) > 1")
def duplicate_owners(spark, sf_dir):  # noqa: ANN001, ANN201
    return relations.duplicate_connections(tables(spark, sf_dir, "repositories")[0].withColumn("external_id", (F.col("id") % 10).cast("string")))


@register("quality_series", with_sql("reviews") + f" SELECT repository_id, id AS review_id, code_quality_score AS quality_score, security_score, total_issues, critical_issues FROM reviews WHERE status = 'completed' AND completed_at >= TIMESTAMP '1995-08-01' - INTERVAL 900 DAYS AND code_quality_score IS NOT NULL")
def quality_series(spark, sf_dir):  # noqa: ANN001, ANN201
    return dashboards.quality_series(tables(spark, sf_dir, "reviews")[0], "1995-08-01 00:00:00", 900).drop("date")


_START, _END = "1994-01-01 00:00:00", "1996-06-30 00:00:00"


@register(
    "team_report",
    with_sql("repositories", "reviews", "issues")
    + f""", {_OWNED}, held AS (SELECT * FROM owned WHERE created_at BETWEEN TIMESTAMP '{_START}' AND TIMESTAMP '{_END}'), d AS (SELECT * FROM held WHERE status = 'completed'),
w AS (SELECT owner_id, strftime(created_at, '%Y-W%U') AS week, avg(code_quality_score) AS m FROM d WHERE code_quality_score <> 0 GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY week) AS place, count(*) OVER (PARTITION BY owner_id) AS n FROM w),
h AS (SELECT owner_id, max(n) AS weeks, avg(m) FILTER (WHERE place <= n // 2) AS a, avg(m) FILTER (WHERE place > n // 2) AS b FROM p GROUP BY owner_id),
f AS (SELECT owner_id, count(*) AS n, coalesce(avg(code_quality_score) FILTER (WHERE code_quality_score <> 0), 0) AS q, coalesce(avg(security_score) FILTER (WHERE security_score <> 0), 0) AS s, coalesce(sum(total_issues), 0) AS i, coalesce(sum(critical_issues), 0) AS c FROM d GROUP BY owner_id),
t AS (SELECT owner_id, count(*) AS n FROM held GROUP BY owner_id),
g AS (SELECT owner_id, string_agg(category || '=' || n, ',' ORDER BY category) AS issues_by_category FROM (SELECT owner_id, category, count(*) AS n FROM issues i JOIN held r ON i.review_id = r.id GROUP BY ALL) GROUP BY owner_id)
SELECT t.owner_id, 911::BIGINT AS days, t.n AS total_reviews, coalesce(f.n, 0) AS completed_reviews, round(CAST(coalesce(f.n, 0) AS DOUBLE) / t.n * 100.0::DOUBLE, 2) AS completion_rate, round(coalesce(f.q, 0), 2) AS average_quality_score,
  CAST(coalesce(f.i, 0) AS BIGINT) AS total_issues_found, CAST(coalesce(f.c, 0) AS BIGINT) AS critical_issues_found,
  CASE WHEN coalesce(f.n, 0) < 2 THEN 'insufficient_data' WHEN coalesce(weeks, 0) < 2 THEN 'stable' WHEN b - a > 0.5 THEN 'improving' WHEN b - a < -0.5 THEN 'declining' ELSE 'stable' END AS trend,
  CASE WHEN coalesce(weeks, 0) < 2 THEN 0 ELSE round(b - a, 2) END AS trend_change, coalesce(issues_by_category, '') AS issues_by_category,
  CASE WHEN f.n IS NULL THEN '' ELSE concat_ws(',', CASE WHEN f.q < 7 THEN 'code_quality' END, CASE WHEN f.c > 2 * f.n THEN 'critical_issues' END, CASE WHEN f.s < 8 THEN 'security' END) END AS recommendations
FROM t LEFT JOIN f ON f.owner_id = t.owner_id LEFT JOIN h ON h.owner_id = t.owner_id LEFT JOIN g ON g.owner_id = t.owner_id""",
)
def team_report(spark, sf_dir):  # noqa: ANN001, ANN201
    repos, reviews, issues = tables(spark, sf_dir, "repositories", "reviews", "issues")
    return reports.team_report(reviews, repos, issues, _START, _END)


@register(
    "replied_issues",
    with_sql("issues") + """, r AS (SELECT id, row_number() OVER (PARTITION BY review_id ORDER BY id) - 1 AS place, id % 3 AS k, title, severity, line_start FROM issues)
SELECT id, CASE WHEN k = 0 THEN title ELSE 'AI Detected Issue' END AS title, CASE WHEN k = 0 THEN severity ELSE 'medium' END AS severity, CASE WHEN k = 0 THEN line_start ELSE 1 END AS line_start, 'general' AS category, 'why [1]' AS ai_explanation, 0.75::DOUBLE AS confidence_score FROM r WHERE k < 2""",
)
def replied_issues(spark, sf_dir):  # noqa: ANN001, ANN201
    """A reply for each issue: the array in prose, one without most fields and of an unknown severity, and one that is no JSON."""
    full = F.to_json(F.array(F.struct("title", "severity", F.col("line_start").alias("line_number"), F.lit("why [1]").alias("explanation"))))
    part = F.lit('[\n{"severity": "urgent", "explanation": "why [1]"}]')
    k = F.col("id") % 3
    said = F.concat(F.lit("Here it is:\n"), F.when(k == 0, full).when(k == 1, part).otherwise("[no JSON, {]"), F.lit("\nThat is all."))
    found = reports.replied_issues(tables(spark, sf_dir, "issues")[0].select("id", said.alias("reply")))
    return found.select("id", "title", "severity", "line_start", "category", "ai_explanation", "confidence_score")


@register(
    "top_issues",
    with_sql("issues") + f""", o AS (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY {_RANK} DESC, coalesce(confidence_score, 0.5::DOUBLE) DESC, id) AS place FROM issues)
SELECT review_id, string_agg(place || '. ' || title || ' (' || severity || ') - ' || file_path || ':' || line_start, chr(10) ORDER BY place) AS top_issues FROM o WHERE place <= 3 GROUP BY review_id""",
)
def top_issues(spark, sf_dir):  # noqa: ANN001, ANN201
    return reports.top_issues(tables(spark, sf_dir, "issues")[0], 3)


@register("issue_categories", with_sql("issues") + " SELECT review_id, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM issues GROUP BY review_id")
def issue_categories(spark, sf_dir):  # noqa: ANN001, ANN201
    return client.categories(*tables(spark, sf_dir, "issues"))


@register("repository_counts", with_sql("repositories") + " SELECT owner_id, count(*) AS total, count(*) FILTER (WHERE is_active) AS active, count(external_id) AS connected FROM repositories GROUP BY owner_id")
def repository_counts(spark, sf_dir):  # noqa: ANN001, ANN201
    return client.repository_counts(*tables(spark, sf_dir, "repositories"))


@register("shown_totals", with_sql("reviews", "repositories") + " SELECT p.id AS repository_id, CAST(CASE WHEN p.id % 3 = 1 THEN p.id ELSE coalesce(s.n, 0) END AS BIGINT) AS total FROM repositories p LEFT JOIN (SELECT repository_id, sum(total_issues) AS n FROM reviews GROUP BY ALL) s ON s.repository_id = p.id")
def shown_totals(spark, sf_dir):  # noqa: ANN001, ANN201
    reviews, repos = tables(spark, sf_dir, "reviews", "repositories")
    stored = F.when(F.col("id") % 3 == 1, F.col("id")).when(F.col("id") % 3 == 2, 0)
    return client.shown_totals(repos.select(F.col("id").alias("repository_id"), stored.alias("total")), reviews)


@register("quality_chart", with_sql("reviews") + " SELECT repository_id, id, strftime(created_at, '%B %-d, %Y') AS label, CAST(row_number() OVER (PARTITION BY repository_id ORDER BY created_at, id) AS INTEGER) AS place FROM reviews")
def quality_chart(spark, sf_dir):  # noqa: ANN001, ANN201
    return client.chart(tables(spark, sf_dir, "reviews")[0], "repository_id", "created_at").select("repository_id", "id", "label", "place")


@register(
    "commit_info",
    with_sql("commits", "file_changes") + """, s AS (SELECT repo_id, sha, count(DISTINCT coalesce(b_path, a_path)) AS f, sum(additions) AS a, sum(deletions) AS d FROM file_changes GROUP BY ALL)
SELECT c.repo_id, c.sha, substr(c.sha, 1, 8) AS short_sha, author_email, trim(message) AS message, coalesce(f, 0) AS total_files, CAST(coalesce(a, 0) AS BIGINT) AS insertions, CAST(coalesce(d, 0) AS BIGINT) AS deletions FROM commits c LEFT JOIN s ON s.repo_id = c.repo_id AND s.sha = c.sha""",
)
def commit_info(spark, sf_dir):  # noqa: ANN001, ANN201
    return gitstats.commit_info(*tables(spark, sf_dir, "commits", "file_changes")).drop("author_name", "committed_at")


@register(
    "branch_heads",
    with_sql("commits") + """, n AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY committed_at DESC, sha DESC) AS place FROM commits)
SELECT repo_id, 'b' || place AS name, place = 1 AS is_current, sha, author_name, substr(message, 1, 100) AS message, CASE WHEN place = 1 THEN 'origin/b1' END AS tracking FROM n WHERE place <= 3""",
)
def branch_heads(spark, sf_dir):  # noqa: ANN001, ANN201
    from pyspark.sql import Window

    commits = tables(spark, sf_dir, "commits")[0]
    newest = Window.partitionBy("repo_id").orderBy(F.col("committed_at").desc(), F.col("sha").desc())
    place = F.col("place")
    refs = commits.withColumn("place", F.row_number().over(newest)).where(place <= 3).select("repo_id", "sha", F.concat(F.lit("b"), place).alias("name"), (place == 1).alias("is_current"), F.when(place == 1, "origin/b1").alias("tracking"))
    return gitstats.branch_heads(refs, commits).drop("committed_at")


@register("provider_branches", "SELECT CASE n_nationkey % 3 WHEN 0 THEN 'github' WHEN 1 THEN 'gitlab' ELSE 'bitbucket' END AS provider, n_name AS name, n_nationkey % 3 < 2 AND n_nationkey % 2 = 0 AS protected, n_nationkey % 3 = 1 AND n_nationkey % 4 = 0 AS \"default\", md5(n_name) AS commit_sha, 'u/' || n_name AS commit_url FROM nation")
def provider_branches(spark, sf_dir):  # noqa: ANN001, ANN201
    df = spark.read.parquet(f"{sf_dir}/nation.parquet")
    sha, url = F.md5(F.col("n_name").cast("binary")), F.concat(F.lit("u/"), "n_name")
    name, protected = F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, True).alias("protected")
    github = df.where("n_nationkey % 3 = 0").select(name, protected, F.struct(sha.alias("sha"), url.alias("url")).alias("commit"))
    gitlab = df.where("n_nationkey % 3 = 1").select(name, protected, (F.col("n_nationkey") % 4 == 0).alias("default"), F.struct(sha.alias("id"), url.alias("web_url")).alias("commit"))
    bitbucket = df.where("n_nationkey % 3 = 2").select(name, F.struct(sha.alias("hash"), F.struct(F.struct(url.alias("href")).alias("html")).alias("links")).alias("target"))
    return readers.branches(github, gitlab, bitbucket)


@register(
    "insert_reviews",
    with_sql("reviews", "repositories") + """, m AS (SELECT max(id) AS last FROM reviews), a AS (SELECT *, row_number() OVER (ORDER BY id) AS place FROM repositories WHERE id % 2 = 0)
SELECT id, repository_id, author_id, title, status, progress, total_issues FROM reviews UNION ALL SELECT last + place, id, owner_id, 'New ' || id, 'pending', 0::DOUBLE, 0 FROM a, m""",
)
def insert_reviews(spark, sf_dir):  # noqa: ANN001, ANN201
    """A review asked for in each repository, by its owner or by a stranger, who is refused."""
    reviews, repos = tables(spark, sf_dir, "reviews", "repositories")
    author = F.when(F.col("id") % 2 == 0, F.col("owner_id")).otherwise(F.col("owner_id") + 1)
    asked = repos.select(F.col("id").alias("repository_id"), author.alias("author_id"), F.concat(F.lit("New "), "id").alias("title"), F.lit("completed").alias("status"), F.col("id").alias("seq"))
    return updates.inserted(reviews, "reviews", updates.reviews_allowed(asked, repos), AS_OF).select("id", "repository_id", "author_id", "title", "status", "progress", "total_issues")


@register(
    "insert_comments",
    with_sql("comments") + """, m AS (SELECT max(id) AS last FROM comments), n AS (SELECT *, row_number() OVER (ORDER BY id) AS place FROM comments WHERE parent_id IS NULL)
SELECT id, review_id, parent_id, comment_type, is_resolved FROM comments UNION ALL SELECT last + place, review_id, id, CASE WHEN id % 2 = 0 THEN 'issue' ELSE 'general' END, FALSE FROM n, m""",
)
def insert_comments(spark, sf_dir):  # noqa: ANN001, ANN201
    comments = tables(spark, sf_dir, "comments")[0]
    new = comments.where("parent_id IS NULL").select("review_id", "author_id", F.lit("Thanks").alias("content"), F.col("id").alias("parent_id"), F.when(F.col("id") % 2 == 0, "issue").alias("comment_type"), F.col("id").alias("seq"))
    return updates.inserted(comments, "comments", new, AS_OF).select("id", "review_id", "parent_id", "comment_type", "is_resolved")


@register("user_flags", with_sql("users") + " SELECT id, CASE WHEN id % 3 = 0 THEN FALSE ELSE is_active END AS is_active, CASE WHEN id % 5 = 0 THEN TRUE ELSE is_verified END AS is_verified FROM users")
def user_flags(spark, sf_dir):  # noqa: ANN001, ANN201
    users = tables(spark, sf_dir, "users")[0]
    off = updates.flagged(users, users.where("id % 3 = 0").select("id"), AS_OF, is_active=False)
    return updates.flagged(off, users.where("id % 5 = 0").select("id"), AS_OF, is_verified=True).select("id", "is_active", "is_verified")


@register("scanned_repositories", with_sql("repositories") + " SELECT id, CAST(CASE WHEN id % 2 = 0 THEN id ELSE size END AS INTEGER) AS size, CASE WHEN id % 4 = 0 THEN 'Go' ELSE language END AS language, CASE WHEN id % 2 = 0 THEN DATE '2001-08-01' ELSE CAST(last_analysis AS DATE) END AS analysed FROM repositories")
def scanned_repositories(spark, sf_dir):  # noqa: ANN001, ANN201
    repos = tables(spark, sf_dir, "repositories")[0]
    stats = repos.where("id % 2 = 0").select("id", F.col("id").alias("total_files"), F.when(F.col("id") % 4 == 0, "Go").alias("language"))
    return updates.repository_stats(repos, stats, AS_OF).select("id", "size", "language", F.col("last_analysis").cast("date").alias("analysed"))


@register("kept_after_delete", with_sql("reviews", "issues") + " SELECT review_id, count(*) AS issues FROM issues WHERE review_id IN (SELECT id FROM reviews WHERE repository_id % 3 <> 0) GROUP BY review_id")
def kept_after_delete(spark, sf_dir):  # noqa: ANN001, ANN201
    names = ("repositories", "reviews", "issues", "comments")
    held = dict(zip(names, tables(spark, sf_dir, *names)))
    return updates.cascade(held, held["repositories"].where("id % 3 = 0"))["issues"].groupBy("review_id").agg(F.count("*").alias("issues"))


@register(
    "shown_values",
    with_sql("reviews") + """ SELECT id, CASE WHEN coalesce(code_quality_score, 0) = 0 THEN 'muted' WHEN code_quality_score >= 8 THEN 'green' WHEN code_quality_score >= 6 THEN 'yellow' ELSE 'red' END AS band, CAST(floor(progress * 100 + 0.5::DOUBLE) AS BIGINT) AS percent,
  CAST(ceil(id / 60.0::DOUBLE) AS BIGINT) AS minutes, CASE WHEN progress > 0 AND progress < 1 THEN CAST(trunc(id / progress - id) AS BIGINT) END AS eta,
  CASE WHEN id < 60 THEN 'just now' WHEN id < 3600 THEN id // 60 || 'm ago' WHEN id < 86400 THEN id // 3600 || 'h ago' ELSE id // 86400 || 'd ago' END AS age,
  CASE id % 4 WHEN 0 THEN 0 WHEN 1 THEN 10 WHEN 2 THEN 20 + (id % 30) * 60 // 30 ELSE 100 END AS task_percent FROM reviews""",
)
def shown_values(spark, sf_dir):  # noqa: ANN001, ANN201
    k = F.col("id") % 4
    stage = F.when(k == 0, "starting").when(k == 1, "cloning").when(k == 2, "analysing").otherwise("finished")
    return tables(spark, sf_dir, "reviews")[0].select(
        "id", scores.band("code_quality_score").alias("band"), times.progress_percent("progress").alias("percent"), times.whole_minutes("id").alias("minutes"), times.eta_seconds(F.col("id").cast("double"), "progress").alias("eta"), times.relative("id").alias("age"),
        times.task_progress(stage, F.col("id") % 30, F.lit(30)).alias("task_percent"),
    )


@register(
    "shown_texts",
    with_sql("repositories") + """ SELECT id, 'customer_' || substr(name, 10) AS snake, 'Customer#' || substr(name, 10) AS pascal, CASE WHEN id % 2 = 0 THEN 'fooBarBaz' ELSE 'FooBarBaz' END = 'fooBarBaz' AS starts_small, 'foo_bar_baz' AS words,
  CASE WHEN length(description) > 15 THEN substr(description, 1, 15) || '...' ELSE description END AS short, CASE WHEN description IS NULL THEN 'AI' ELSE 'CO' END AS initials FROM repositories""",
)
def shown_texts(spark, sf_dir):  # noqa: ANN001, ANN201
    mixed = F.when(F.col("id") % 2 == 0, "fooBarBaz").otherwise("FooBarBaz")
    return tables(spark, sf_dir, "repositories")[0].select(
        "id", texts.to_snake_case(F.regexp_replace("name", "#", "_")).alias("snake"), texts.to_pascal_case(F.lower("name")).alias("pascal"), (~texts.is_pascal_case(mixed)).alias("starts_small"), texts.to_snake_case(mixed).alias("words"),
        texts.truncated("description", 15).alias("short"), texts.initials("description").alias("initials"),
    )
