"""Lists: filters, orders and pages.  A filter that is None is left out; an unknown status or severity is ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import severity_rank
from ..functions.times import moment
from ..schemas import SEVERITIES, STATUSES


def page(df: DataFrame, skip: int = 0, limit: int = 100) -> DataFrame:
    """Rows skip .. skip + limit of an ordered table; 1 to 1000 rows."""
    if skip < 0 or not 1 <= limit <= 1000:
        raise ValueError("skip must be 0 or more and limit from 1 to 1000")
    return df.offset(skip).limit(limit)


def any_like(search: str, *columns: str) -> Column:
    """Any column holds the text, without case; % and _ in it are wild."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.col(c).ilike(f"%{search}%"), F.lit(False))
    return out


def any_contains(search: str, *columns: str) -> Column:
    """Any column holds the text, without case and without wildcards."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.lower(F.col(c)).contains(search.lower()), F.lit(False))
    return out


def by_key(df: DataFrame, **keys) -> DataFrame:  # noqa: ANN003
    """Rows that equal every key; a point look-up that reaches the scan as a filter."""
    for c, v in keys.items():
        df = df.where(F.col(c) == v)
    return df


def by_email(users: DataFrame, email: str) -> DataFrame:
    return by_key(users, email=email.lower())


def by_oauth(users: DataFrame, provider: str, account: str) -> DataFrame:
    """Users with that account at a provider; no rows for an unknown provider."""
    column = f"{provider}_id"
    return by_key(users, **{column: account}) if column in ("github_id", "gitlab_id", "bitbucket_id") else users.limit(0)


def repositories(df: DataFrame, owner_id: int | None = None, search: str | None = None, provider: str | None = None, is_active: bool | None = None) -> DataFrame:
    """Newest analysis first, never analysed ones before all, then newest."""
    if owner_id is not None:
        df = df.where(F.col("owner_id") == owner_id)
    if search:
        df = df.where(any_like(search, "name", "full_name", "description"))
    if provider:
        df = df.where(F.col("provider") == provider)
    if is_active is not None:
        df = df.where(F.col("is_active") == is_active)
    return df.orderBy(F.col("last_analysis").desc_nulls_first(), F.col("created_at").desc(), "id")


def reviews(df: DataFrame, repos: DataFrame, owner_id: int | None = None, repository_id: int | None = None, status: str | None = None) -> DataFrame:
    """Reviews of an owner's repositories, newest first."""
    out = df.join(repos.select(F.col("id").alias("repository_id"), "owner_id", F.col("name").alias("repository_name")), "repository_id")
    if owner_id is not None:
        out = out.where(F.col("owner_id") == owner_id)
    if repository_id is not None:
        out = out.where(F.col("repository_id") == repository_id)
    if status in STATUSES:
        out = out.where(F.col("status") == status)
    return out.orderBy(F.col("created_at").desc(), F.col("id").desc())


def issues(df: DataFrame, severity: str | None = None, category: str | None = None, resolved: bool | None = None) -> DataFrame:
    """Worst first, then by file and line."""
    if severity in SEVERITIES:
        df = df.where(F.col("severity") == severity)
    if category:
        df = df.where(F.col("category") == category)
    if resolved is not None:
        df = df.where(F.col("is_resolved") == resolved)
    return df.orderBy(severity_rank("severity").desc(), "file_path", "line_start", "id")


def users(df: DataFrame, search: str | None = None, order_by: str = "id", descending: bool = False, **flags: bool) -> DataFrame:
    """Users by text in email, username or full name and by flags; an unknown order column leaves them unordered."""
    if search:
        df = df.where(any_like(search.lower(), "email", "username", "full_name"))
    for flag, value in flags.items():
        df = df.where(F.col(flag) == value)
    if order_by in df.columns:
        df = df.orderBy(F.col(order_by).desc() if descending else F.col(order_by).asc(), "id")
    return df


def user_count(df: DataFrame, search: str | None = None, **flags: bool) -> DataFrame:
    """One row: how many users the list has without paging."""
    return users(df, search, "", **flags).agg(F.count("*").alias("users"))


def client_reviews(df: DataFrame, search: str | None = None, status: str | None = None) -> DataFrame:
    """The review list of the client: a status and plain text in the title."""
    if search:
        df = df.where(any_contains(search, "title"))
    return df.where(F.col("status") == status) if status else df


def sorted_issues(df: DataFrame, by: str = "severity", descending: bool = True) -> DataFrame:
    """The client's issue order by severity, category, file or creation; equal ones by id."""
    keys = {"severity": severity_rank("severity"), "category": F.col("category"), "file": F.col("file_path"), "created": F.col("created_at")}
    key = keys.get(by, keys["severity"])
    return df.orderBy(key.desc() if descending else key.asc(), "id")


def between(df: DataFrame, start: str, end: str) -> DataFrame:
    """Created from ``start`` to ``end``, both included, newest first."""
    return df.where(F.col("created_at").between(moment(start), moment(end))).orderBy(F.col("created_at").desc(), F.col("id").desc())


def prioritised(issues_: DataFrame, *ties: str) -> DataFrame:
    """Most severe first, then most certain; a missing confidence counts as 0.5."""
    return issues_.orderBy(severity_rank("severity").desc(), F.coalesce("confidence_score", F.lit(0.5)).desc(), *ties)


def client_issues(df: DataFrame, search: str | None = None, severity: str | None = None, category: str | None = None, status: str | None = None) -> DataFrame:
    """The issue list of the client: plain substring search, and a status of open, resolved or false_positive."""
    if search:
        df = df.where(any_contains(search, "title", "description", "file_path"))
    if severity:
        df = df.where(F.col("severity") == severity)
    if category:
        df = df.where(F.col("category") == category)
    states = {"open": ~F.col("is_resolved") & ~F.col("is_false_positive"), "resolved": F.col("is_resolved"), "false_positive": F.col("is_false_positive")}
    return df.where(states[status]) if status in states else df


#: The order of names as readers of a language expect it, by Unicode's rules; ``UNICODE`` is that of English.
LOCALE = "UNICODE"


def by_name(column: str = "name", locale: str = LOCALE) -> Column:
    """A sort and paging key: letters before accents before case, as the locale orders them; equal keys need a tie."""
    return F.collate(F.col(column), locale)


def client_repositories(df: DataFrame, by: str = "last_analysis", locale: str = LOCALE) -> DataFrame:
    """The repository list of the client: never analysed ones last, or by name in the locale's order; ties by id."""
    order = {"last_analysis": F.col("last_analysis").desc_nulls_last(), "name": by_name("name", locale).asc(), "created_at": F.col("created_at").desc()}
    return df.orderBy(order.get(by, order["last_analysis"]), "id")


def client_search(df: DataFrame, search: str = "") -> DataFrame:
    """Repositories whose name or description holds the text, without case; a null description holds nothing."""
    return df.where(any_contains(search, "name", "description"))


def repositories_after(df: DataFrame, name: str, last_id: int, limit: int = 100, locale: str = LOCALE) -> DataFrame:
    """The next page by name: what follows the row of that name and id in the locale's order, by key and not by number."""
    key, at = by_name("name", locale), F.collate(F.lit(name), locale)
    return df.where((key > at) | ((key == at) & (F.col("id") > last_id))).orderBy(key.asc(), "id").limit(limit)
