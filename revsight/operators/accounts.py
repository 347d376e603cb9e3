"""Sign-in look-ups, public profiles, and repositories as their providers describe and name them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dashboards

#: Columns of a user that everyone may see.
PUBLIC = ("id", "username", "full_name", "avatar_url", "bio", "location", "company", "website", "created_at", "is_verified")


def sign_ins(users: DataFrame, logins: DataFrame) -> DataFrame:
    """Who each login (attempt, name) is: by e-mail in lower case, else by user name; outcome found, inactive or unknown.

    An inactive account is not looked for under another name.  Where several accounts have one e-mail or name, the first counts.
    """
    first = lambda key: users.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"_{key}")).agg(F.min(F.struct("id", "is_active")).alias(f"by_{key}"))
    met = logins.join(first("email"), F.lower("name") == F.col("_email"), "left").join(first("username"), F.col("name") == F.col("_username"), "left")
    who = F.coalesce("by_email", "by_username")
    outcome = F.when(who.isNull(), "unknown").when(F.coalesce(who["is_active"], F.lit(False)), "found").otherwise("inactive")
    return met.select("attempt", F.when(outcome == "found", who["id"]).alias("user_id"), outcome.alias("outcome"))


def public_profiles(users: DataFrame, repositories: DataFrame, reviews: DataFrame) -> DataFrame:
    """What everyone may see of each user, with the statistics of the profile; absent columns are null."""
    shown = users.select(*[F.col(c) if c in users.columns else F.lit(None).cast("string").alias(c) for c in PUBLIC])
    stats = dashboards.profile_stats(users, repositories, reviews).drop("username").withColumnRenamed("owner_id", "id")
    return shown.join(stats, "id", "left")


# Addresses of repositories.
GITHUB, BITBUCKET = r"^https://github\.com/([^/]+)/([^/]+)", r"^https://bitbucket\.org/([^/]+)/([^/]+)"


def project_of(url: Column | str) -> Column:
    """(provider, owner, name, path) that a repository's address names; null for an address of no provider.

    Two providers name an owner and a repository.  The third names a path of groups, encoded as its interface wants it: all
    hosts that bear its name are its own, whatever comes before the path.
    """
    u = F.col(url) if isinstance(url, str) else url
    plain = lambda c: F.replace(c, F.lit(".git"), F.lit(""))
    none = F.lit(None).cast("string")

    def pair(provider: str, pattern: str) -> Column:
        owner, name = F.regexp_extract(u, pattern, 1), plain(F.regexp_extract(u, pattern, 2))
        return F.struct(F.lit(provider).alias("provider"), owner.alias("owner"), name.alias("name"), F.concat(owner, F.lit("/"), name).alias("path"))

    host, rest = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    path = plain(F.btrim(rest, F.lit("/")))
    grouped = F.struct(F.lit("gitlab").alias("provider"), none.alias("owner"), none.alias("name"), F.replace(path, F.lit("/"), F.lit("%2F")).alias("path"))
    return F.when(u.rlike(GITHUB), pair("github", GITHUB)).when(u.rlike(BITBUCKET), pair("bitbucket", BITBUCKET)).when(host.contains("gitlab"), grouped)


RECORD = ("provider", "id", "name", "full_name", "description", "url", "clone_url", "default_branch", "language", "is_private", "size", "owner", "created_at", "updated_at")


def provider_records(github: DataFrame, gitlab: DataFrame, bitbucket: DataFrame) -> DataFrame:
    """Repositories as three providers describe them, in one form; what a provider doesn't tell is null, an unknown size 0."""
    c, none = F.col, F.lit(None).cast("string")

    def form(df: DataFrame, *values: Column) -> DataFrame:
        kinds = {"size": "long", "is_private": "boolean"}
        return df.select(*[v.cast(kinds.get(n, "string")).alias(n) for n, v in zip(RECORD, values)])

    size = lambda col: F.coalesce(c(col), F.lit(0))
    one = form(github, F.lit("github"), c("id"), c("name"), c("full_name"), c("description"), c("html_url"), c("clone_url"), c("default_branch"), c("language"), c("private"), size("size"), c("owner.login"), c("created_at"), c("updated_at"))
    two = form(gitlab, F.lit("gitlab"), c("id"), c("name"), c("path_with_namespace"), c("description"), c("web_url"), c("http_url_to_repo"), c("default_branch"), none, c("visibility") == "private", F.lit(0), none, c("created_at"), c("last_activity_at"))
    main = F.when(c("mainbranch").isNull(), "main").otherwise(c("mainbranch.name"))
    three = form(bitbucket, F.lit("bitbucket"), F.regexp_replace("uuid", r"^[{}]+|[{}]+$", ""), c("name"), c("full_name"), c("description"), c("links.html.href"), F.get(c("links.clone.href"), F.lit(0)), main, c("language"), c("is_private"), size("size"), none, c("created_on"), c("updated_on"))
    return one.unionByName(two).unionByName(three)


def analysis_context(files: DataFrame, reviews: DataFrame, repositories: DataFrame) -> DataFrame:
    """What an analysis is told of each file (review_id, path, content): its repository, language and number of lines."""
    from ..functions.paths import language

    about = reviews.select(F.col("id").alias("review_id"), "repository_id").join(repositories.select(F.col("id").alias("repository_id"), F.struct("name", "language", "description").alias("repository_info")), "repository_id").drop("repository_id")
    told = F.struct("path", language("path").alias("language"), F.size(F.split("content", "\n")).alias("lines")).alias("file_info")
    return files.select("review_id", "path", told).join(about, "review_id", "left")
