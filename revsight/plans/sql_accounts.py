"""Queries over sign-ins, public profiles, addresses and records of providers, and what analyses are told, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..entities import with_sql
from ..operators import accounts
from . import sql_analytics  # noqa: F401  (registers the statistics of profiles)
from .registry import SQL, register, tables

_NAME = "CASE id % 5 WHEN 0 THEN upper(email) WHEN 1 THEN username WHEN 2 THEN upper(username) WHEN 3 THEN email ELSE 'x' || email END"


@register(
    "sign_ins",
    with_sql("users") + " SELECT id AS attempt, CASE WHEN id % 5 IN (0, 1, 3) AND is_active THEN id END AS user_id, CASE WHEN id % 5 IN (2, 4) THEN 'unknown' WHEN is_active THEN 'found' ELSE 'inactive' END AS outcome FROM users",
)
def sign_ins(spark, sf_dir):  # noqa: ANN001, ANN201
    users = tables(spark, sf_dir, "users")[0]
    return accounts.sign_ins(users, users.select(F.col("id").alias("attempt"), F.expr(_NAME).alias("name")))


@register("public_profiles", f"WITH s AS ({SQL['profile_stats']}), u AS ({with_sql('users')} SELECT * FROM users) SELECT u.id, u.username, u.full_name, u.is_verified, strftime(u.created_at, '%Y-%m-%d %H:%M:%S') AS created, s.* EXCLUDE (owner_id, username) FROM u JOIN s ON s.owner_id = u.id")
def public_profiles(spark, sf_dir):  # noqa: ANN001, ANN201
    shown = accounts.public_profiles(*tables(spark, sf_dir, "users", "repositories", "reviews"))
    return shown.withColumn("created", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")).drop("created_at", "avatar_url", "bio", "location", "company", "website")


_URL = """CASE c_custkey % 5 WHEN 0 THEN 'https://github.com/org' || c_custkey || '/repo.git/tree/main' WHEN 1 THEN 'https://bitbucket.org/team' || c_custkey || '/r-' || c_custkey WHEN 2 THEN 'https://gitlab.example.com/a/b/p' || c_custkey || '.git/' WHEN 3 THEN 'http://github.com/o/r' ELSE 'https://gitlab.com/g' || c_custkey || '/p?x=1' END"""


@register(
    "project_addresses",
    """SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'github' WHEN 1 THEN 'bitbucket' WHEN 3 THEN NULL ELSE 'gitlab' END AS provider, CASE c_custkey % 5 WHEN 0 THEN 'org' || c_custkey WHEN 1 THEN 'team' || c_custkey END AS owner,
  CASE c_custkey % 5 WHEN 0 THEN 'repo' WHEN 1 THEN 'r-' || c_custkey END AS name, CASE c_custkey % 5 WHEN 0 THEN 'org' || c_custkey || '/repo' WHEN 1 THEN 'team' || c_custkey || '/r-' || c_custkey WHEN 2 THEN 'a%2Fb%2Fp' || c_custkey WHEN 4 THEN 'g' || c_custkey || '%2Fp' END AS path FROM customer""",
)
def project_addresses(spark, sf_dir):  # noqa: ANN001, ANN201
    found = accounts.project_of(F.expr(_URL)).alias("p")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), found).select("id", "p.provider", "p.owner", "p.name", "p.path")


@register(
    "provider_records",
    with_sql("repositories")
    + """ SELECT provider, CASE provider WHEN 'bitbucket' THEN 'u' || id ELSE CAST(id AS VARCHAR) END AS id, name, full_name, description, 'https://h/' || id AS url, 'https://h/' || id || '.git' AS clone_url,
  CASE WHEN provider = 'bitbucket' AND id % 2 = 0 THEN 'main' ELSE 'dev' END AS default_branch, CASE WHEN provider <> 'gitlab' THEN language END AS language, id % 4 = 0 AS is_private, CASE WHEN provider = 'gitlab' OR id % 5 = 0 THEN 0 ELSE id END AS size,
  CASE WHEN provider = 'github' THEN 'o' || owner_id END AS owner FROM repositories""",
)
def provider_records(spark, sf_dir):  # noqa: ANN001, ANN201
    repos = tables(spark, sf_dir, "repositories")[0]
    own, lit = lambda p: repos.where(F.col("provider") == p), F.lit
    url, size = F.concat(lit("https://h/"), "id"), F.when(F.col("id") % 5 != 0, F.col("id")).alias("size")
    clone, private, then = F.concat(url, lit(".git")), F.col("id") % 4 == 0, F.lit("2024-01-01").alias("created_at")
    github = own("github").select("id", "name", "full_name", "description", url.alias("html_url"), clone.alias("clone_url"), lit("dev").alias("default_branch"), "language", private.alias("private"), size, F.struct(F.concat(lit("o"), "owner_id").alias("login")).alias("owner"), then, then.alias("updated_at"))
    gitlab = own("gitlab").select("id", "name", F.col("full_name").alias("path_with_namespace"), "description", url.alias("web_url"), clone.alias("http_url_to_repo"), lit("dev").alias("default_branch"), F.when(private, "private").otherwise("public").alias("visibility"), then, then.alias("last_activity_at"))
    links = F.struct(F.struct(url.alias("href")).alias("html"), F.array(F.struct(clone.alias("href")), F.struct(lit("ssh").alias("href"))).alias("clone")).alias("links")
    main = F.when(F.col("id") % 2 == 1, F.struct(lit("dev").alias("name"))).alias("mainbranch")
    bitbucket = own("bitbucket").select(F.concat(lit("{u"), "id", lit("}")).alias("uuid"), "name", "full_name", "description", links, main, "language", private.alias("is_private"), size, then.alias("created_on"), then.alias("updated_on"))
    return accounts.provider_records(github, gitlab, bitbucket).drop("created_at", "updated_at")


@register(
    "analysis_contexts",
    with_sql("files", "reviews", "repositories")
    + """ SELECT f.doc_id, p.name AS repository, p.language AS repository_language, p.description, f.path, CASE WHEN f.path LIKE '%.py' THEN 'python' WHEN f.path LIKE '%.js' THEN 'javascript' ELSE 'unknown' END AS language, len(string_split(f.content, chr(10))) AS lines
FROM files f LEFT JOIN (SELECT r.id, p.name, p.language, p.description FROM reviews r JOIN repositories p ON p.id = r.repository_id) p ON p.id = f.review_id""",
)
def analysis_contexts(spark, sf_dir):  # noqa: ANN001, ANN201
    files, reviews, repos = tables(spark, sf_dir, "files", "reviews", "repositories")
    # the document's number goes along in the path
    told = accounts.analysis_context(files.withColumn("path", F.concat_ws("#", "path", "doc_id")), reviews, repos)
    name = F.substring_index("path", "#", 1)
    from ..functions.paths import language

    return told.select(F.substring_index("path", "#", -1).cast("long").alias("doc_id"), F.col("repository_info.name").alias("repository"), F.col("repository_info.language").alias("repository_language"), F.col("repository_info.description").alias("description"), name.alias("path"), language(name).alias("language"), F.col("file_info.lines").cast("long").alias("lines"))
