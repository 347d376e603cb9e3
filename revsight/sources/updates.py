"""Writes as pure transforms: a table and a change give the table after it, ready to be written or merged.

Changes are tables of their own, so one join applies any number of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import clamp
from ..functions.times import moment
from ..session import shared_folder


def updated(df: DataFrame, changes: DataFrame, key: str = "id", now: str | None = None) -> DataFrame:
    """Rows whose key is in ``changes`` take its non-null columns; with ``now``, those rows get that updated_at."""
    names = [c for c in changes.columns if c != key]
    new = changes.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in names])
    out = df.join(new, F.col(key) == F.col("_key"), "left")
    columns: list[Column] = []
    for c in df.columns:
        value = F.coalesce(F.col(f"_{c}"), F.col(c)) if c in names else F.col(c)
        if c == "updated_at" and now is not None and c not in names:
            value = F.when(F.col("_key").isNotNull(), moment(now)).otherwise(F.col(c))
        columns.append(value.alias(c))
    return out.select(*columns)


# What a new row of each entity holds where nothing is given, as SQL.
DEFAULTS = {
    "users": {"is_active": "true", "is_verified": "false", "is_superuser": "false", "preferences": "'{}'", "notification_settings": "'{}'"},
    "repositories": {"default_branch": "'main'", "is_private": "false", "is_active": "true", "is_archived": "false", "analysis_enabled": "true", "auto_review": "true", "review_rules": "'{}'", "notification_settings": "'{}'", "size": "0", "total_reviews": "0", "total_issues": "0", "avg_review_time": "0"},
    "reviews": {"status": "'pending'", "progress": "0.0D", "total_files": "0", "analyzed_files": "0", "total_issues": "0", "critical_issues": "0", "high_issues": "0", "medium_issues": "0", "low_issues": "0", "ai_recommendations": "'[]'", "analysis_metadata": "'{}'"},
    "issues": {"confidence_score": "0.0D", "is_resolved": "false", "is_false_positive": "false"},
    "comments": {"comment_type": "'general'", "is_resolved": "false"},
}
#: Columns that a new row takes from its entity whatever is given.
FORCED = {"reviews": ("status", "progress", "ai_recommendations", "analysis_metadata")}


def inserted(df: DataFrame, entity: str, new: DataFrame, now: str) -> DataFrame:
    """The table with ``new`` rows, to be appended: absent or null columns take the entity's defaults, created_at is now.

    Ids go on from the largest one held, in the order of the new rows' ``seq`` column; they are dealt out per partition of
    a range, so no task sees all new rows.
    """
    from pyspark.sql.types import LongType

    last = df.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("_last"))
    rows = numbered(new, "seq").join(F.broadcast(last)).withColumn("id", (F.col("_last") + F.col("_place")).cast(LongType()))
    out = []
    for f in df.schema.fields:
        default = DEFAULTS[entity].get(f.name)
        given = F.col(f.name) if f.name in rows.columns else F.lit(None)
        if f.name == "created_at":
            value = moment(now)
        elif default is not None and f.name in FORCED.get(entity, ()):
            value = F.expr(default)
        else:
            value = given if default is None else F.coalesce(given, F.expr(default))
        out.append(value.cast(f.dataType).alias(f.name))
    return df.unionByName(rows.select(*out))


def numbered(df: DataFrame, order: str, block: int = 1 << 16) -> DataFrame:
    """``df`` with ``_place``, the 1-based place of each row by ``order`` (distinct whole numbers): places within blocks of that
    order, and sums of the blocks before, of which there is one row for ``block`` values."""
    blocks = df.withColumn("_block", F.floor(F.col(order) / block))
    sizes = blocks.groupBy("_block").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")).drop("_n")
    placed = blocks.withColumn("_at", F.row_number().over(Window.partitionBy("_block").orderBy(order)))
    return placed.join(before, "_block").withColumn("_place", F.col("_at") + F.col("_before")).drop("_block", "_at", "_before")


def reviews_allowed(new: DataFrame, repositories: DataFrame) -> DataFrame:
    """New reviews (repository_id, author_id, ...) whose author owns the repository; others are refused."""
    own = repositories.select(F.col("id").alias("repository_id"), F.col("owner_id").alias("author_id"))
    return new.join(own, ["repository_id", "author_id"], "left_semi")


def flagged(users: DataFrame, ids: DataFrame, now: str, **flags: bool) -> DataFrame:
    """Users after ``ids`` (one column) were activated, deactivated or verified: each given flag is set on them."""
    return updated(users, ids.select(F.col(ids.columns[0]).alias("id"), *[F.lit(v).alias(k) for k, v in flags.items()]), now=now)


def repository_stats(repositories: DataFrame, stats: DataFrame, now: str) -> DataFrame:
    """Repositories after a scan (id, total_files, language): size is the number of files; what is null stays as it was."""
    return updated(repositories, stats.select("id", F.col("total_files").cast("int").alias("size"), "language", moment(now).alias("last_analysis")))


def with_status(reviews: DataFrame, changes: DataFrame, now: str) -> DataFrame:
    """Reviews after ``changes`` (id, status): completed also sets the completion time and full progress."""
    done = changes.where(F.col("status") == "completed").select("id", "status", F.lit(1.0).alias("progress"), moment(now).alias("completed_at"))
    rest = changes.where(F.col("status") != "completed").select("id", "status", F.lit(None).cast("double").alias("progress"), F.lit(None).cast("timestamp_ntz").alias("completed_at"))
    return updated(reviews, done.unionByName(rest), now=now)


def with_progress(reviews: DataFrame, changes: DataFrame) -> DataFrame:
    """Reviews after ``changes`` (id, progress): progress is kept between 0 and 1."""
    return updated(reviews, changes.select("id", clamp("progress").alias("progress")))


def issues_resolved(issues: DataFrame, changes: DataFrame, now: str) -> DataFrame:
    """Issues after ``changes`` (id, is_resolved): resolving also sets resolved_at."""
    marked = changes.select(F.col("id").alias("_key"), F.col("is_resolved").alias("_new"))
    out = issues.join(marked, F.col("id") == F.col("_key"), "left")
    at = F.when(F.col("_new"), moment(now))
    return out.withColumn("resolved_at", F.coalesce(at, F.col("resolved_at")) if "resolved_at" in issues.columns else at).withColumn("is_resolved", F.coalesce("_new", "is_resolved")).drop("_key", "_new")


def merged_json(old: Column, new: Column) -> Column:
    """Two JSON objects of plain values as one; the newer value of a name stays.  Names come out sorted."""
    a, b = (F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>")) for c in (old, new))
    kept = F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept))))


def deleted(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """``df`` without the rows whose ``column`` is one of ``keys`` (one column)."""
    return df.join(keys.select(F.col(keys.columns[0]).alias(column)), column, "left_anti")


def cascade(tables: dict[str, DataFrame], repositories: DataFrame) -> dict[str, DataFrame]:
    """The tables after ``repositories`` (id) are gone: their reviews, and issues and comments of those, go with them."""
    gone = repositories.select("id")
    reviews = tables["reviews"].join(gone.select(F.col("id").alias("repository_id")), "repository_id", "left_semi").select("id")
    return {
        "repositories": deleted(tables["repositories"], gone, "id"),
        "reviews": deleted(tables["reviews"], gone, "repository_id"),
        "issues": deleted(tables["issues"], reviews, "review_id"),
        "comments": deleted(tables["comments"], reviews, "review_id"),
    }


#: Fixed value: numbers that are tried behind a taken name; beyond them a name ends in a code.
MOST_NUMBER = 9998
#: Digits of a number at a name's end that are looked at where numbers have no end; a long holds them.
MOST_DIGITS = 18


def unique_usernames(wanted: DataFrame, taken: DataFrame, most: int | None = MOST_NUMBER) -> DataFrame:
    """A free name for each of ``wanted`` (id, username), all different; see :func:`offered_usernames`.

    Different names can be given the same one (ann1 and 2, ann and 12); the smaller id then keeps it and the others ask again,
    which few do.  Each round is written to the shared folder.
    """
    spark, given = wanted.sparkSession, None
    while True:
        path = shared_folder(spark, "usernames")
        offered_usernames(wanted, taken, most).withColumn("_turn", F.row_number().over(Window.partitionBy("username").orderBy("id"))).write.parquet(path)
        offered = spark.read.parquet(path)
        won = offered.where("_turn = 1").drop("_turn")
        given = won if given is None else given.unionByName(won)
        lost = offered.where("_turn > 1")
        if lost.isEmpty():
            return given
        wanted = wanted.join(lost.select("id"), "id", "left_semi")
        taken = taken.select("username").unionByName(won.select("username"))


def offered_usernames(wanted: DataFrame, taken: DataFrame, most: int | None = MOST_NUMBER) -> DataFrame:
    """For each of ``wanted`` (id, username) the name itself if it is free and asked first, else with the least free number.

    ``taken``: username.  Requests for one name are served by id.  Numbers in use are counted per name, not looped over:
    the n-th request takes the n-th number that no taken name bears, and where all numbers up to ``most`` are taken an
    underscore and eight hexadecimal digits that follow from the name and the id; with ``most`` None numbers have no end.
    """
    own = taken.select(F.col("username").alias("name")).distinct()
    digits = len(str(most)) - 1 if most else MOST_DIGITS - 1
    number = lambda i: F.regexp_extract("name", rf"^(.*?)([1-9]\d{{0,{digits}}})$", i)
    # a name may end in several numbers: ann12 is ann and 12, and ann1 and 2
    ends = F.transform(F.sequence(F.lit(1), F.length(number(2))), lambda i: F.struct(F.concat(number(1), F.substr(number(2), F.lit(1), F.length(number(2)) - i)).alias("username"), F.substr(number(2), F.length(number(2)) - i + 1).alias("no")))
    numbered = own.where(number(2) != "").select(F.explode(ends).alias("e")).where(~F.col("e.no").startswith("0")).select("e.username", F.col("e.no").cast("long").alias("no"))
    exact = own.select(F.col("name").alias("username"), F.lit(0).cast("long").alias("no"))
    # the j-th taken number has no - j free ones before it, so the k-th free number is k and as many as have less than k
    before = F.row_number().over(Window.partitionBy("username").orderBy("no"))
    used = numbered.distinct().select("username", (F.col("no") - before).alias("free"), F.lit(None).cast("long").alias("id"))
    asked = wanted.join(exact, "username", "left").withColumn("n", F.row_number().over(Window.partitionBy("username").orderBy("id")))
    placed = asked.select("username", (F.col("n") - 1 + F.when(F.col("no").isNotNull(), 1).otherwise(0)).cast("long").alias("free"), "id", F.lit(True).alias("asks"))
    both = placed.unionByName(used.withColumn("asks", F.lit(False)))
    # at one count of free numbers the request comes first
    passed = F.count(F.when(~F.col("asks"), 1)).over(Window.partitionBy("username").orderBy("free", F.col("asks").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    code = F.concat(F.lit("_"), F.substring(F.md5(F.concat_ws("/", "username", F.col("id").cast("string")).cast("binary")), 1, 8))
    told = both.withColumn("number", F.col("free") + passed).where("asks")
    end = F.col("number").cast("string") if most is None else F.when(F.col("number") <= most, F.col("number").cast("string")).otherwise(code)
    return told.select("id", F.when(F.col("free") == 0, F.col("username")).otherwise(F.concat("username", end)).alias("username"))


def upsert_accounts(users: DataFrame, logins: DataFrame, provider: str) -> DataFrame:
    """What each login (account, email, username) does: update by account, link by email, or insert."""
    column = f"{provider}_id"
    by_account = users.where(F.col(column).isNotNull()).select(F.col(column).alias("account"), F.col("id").alias("account_user"))
    by_email = users.select(F.col("email").alias("login_email"), F.col("id").alias("email_user"))
    out = logins.join(by_account, "account", "left").join(by_email, F.lower("email") == F.col("login_email"), "left")
    action = F.when(F.col("account_user").isNotNull(), "update").when(F.col("email_user").isNotNull(), "link").otherwise("insert")
    return out.select("account", F.lower("email").alias("email"), "username", F.coalesce("account_user", "email_user").alias("user_id"), action.alias("action"))
