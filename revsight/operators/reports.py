"""Team reports and per-review quality: weekly trends, issue patterns, recommendations, quality metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import after_dot
from ..functions.scores import count_if, quality_metrics, round2, severity_rank, trend, truthy
from ..functions.texts import issue_lines
from ..functions.times import moment, week_key, whole_days_between
from ..schemas import SEVERITIES
from .dashboards import done, owned_reviews


def in_period(reviews: DataFrame, start: str, end: str) -> DataFrame:
    """Reviews created from ``start`` to ``end``, both included."""
    return reviews.where(F.col("created_at").between(moment(start), moment(end)))


def weekly_trends(reviews: DataFrame, repositories: DataFrame, band: float = 0.5) -> DataFrame:
    """Per owner: trend of weekly mean quality over completed reviews.

    Zeros and nulls are left out of a week's mean; weeks sort as text; the older half of the weeks, rounded down, is held
    against the rest.  Fewer than two reviews: insufficient_data; fewer than two weeks: stable.  All reviews count as data points.
    """
    own = owned_reviews(reviews, repositories)
    weeks = own.where(truthy("code_quality_score")).groupBy("owner_id", week_key("created_at").alias("week")).agg(F.avg("code_quality_score").alias("mean"))
    order = Window.partitionBy("owner_id").orderBy("week")
    placed = weeks.withColumn("place", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("owner_id")))
    old = F.col("place") <= F.floor(F.col("n") / 2)
    halves = placed.groupBy("owner_id").agg(F.max("n").alias("weeks"), F.avg(F.when(old, F.col("mean"))).alias("a"), F.avg(F.when(~old, F.col("mean"))).alias("b"))
    counts = own.groupBy("owner_id").agg(F.count("*").alias("data_points"))
    change = F.col("b") - F.col("a")
    few = F.coalesce("weeks", F.lit(0)) < 2
    direction = F.when(F.col("data_points") < 2, "insufficient_data").when(few, "stable").otherwise(trend(change, band))
    return counts.join(halves, "owner_id", "left").select("owner_id", direction.alias("trend"), F.when(few, F.lit(0.0)).otherwise(round2(change)).alias("change"), F.coalesce("weeks", F.lit(0)).cast("long").alias("weeks"), "data_points")


def issue_patterns(issues: DataFrame) -> DataFrame:
    """Counts by category, by severity and by file extension in one pass, as rows (dimension, value, issues)."""
    cut = issues.select("category", "severity", after_dot("file_path", "unknown").alias("extension"))
    sets = cut.groupingSets([[F.col("category")], [F.col("severity")], [F.col("extension")]], F.col("category"), F.col("severity"), F.col("extension"))
    counted = sets.agg(F.grouping_id("category", "severity", "extension").alias("g"), F.count("*").alias("issues"))
    name = F.when(F.col("g") == 3, "category").when(F.col("g") == 5, "severity").otherwise("extension")
    return counted.select(name.alias("dimension"), F.coalesce("category", "severity", "extension").alias("value"), "issues")


def pattern_summary(issues: DataFrame) -> DataFrame:
    """One row: number of issues, the most frequent category (ties by name) and the share resolved in percent."""
    counts = issues.groupBy("category").agg(F.count("*").alias("n"), count_if(F.col("is_resolved")).alias("r"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return counts.agg(total.alias("total_issues"), F.min_by("category", F.struct((-F.col("n")).alias("n"), "category")).alias("most_common_category"), F.when(total > 0, round2(F.sum("r") / total * 100.0)).otherwise(F.lit(0.0)).alias("resolution_rate"))


# When a recommendation is made, and how urgent it is.
RECOMMENDATIONS = (
    ("code_quality", "high", "avg_quality < 7.0"),
    ("security", "high", "avg_security < 8.0"),
    ("critical_issues", "high", "critical > 2 * reviews"),
    ("process", "medium", "completion < 0.8"),
)


def recommendations(reviews: DataFrame, repositories: DataFrame) -> DataFrame:
    """Per owner, one row for each threshold that is crossed; a score that nothing measured counts as 0 and crosses its own."""
    own = owned_reviews(reviews, repositories)
    mean = lambda c: F.coalesce(F.avg(F.when(truthy(c), F.col(c))), F.lit(0.0))
    facts = own.groupBy("owner_id").agg(mean("code_quality_score").alias("avg_quality"), mean("security_score").alias("avg_security"), F.coalesce(F.sum("critical_issues"), F.lit(0)).alias("critical"), F.count("*").alias("reviews"), (count_if(done()) / F.count("*")).alias("completion"))
    rows = F.filter(F.array(*[F.when(F.expr(test), F.struct(F.lit(area).alias("area"), F.lit(priority).alias("priority"))) for area, priority, test in RECOMMENDATIONS]), lambda x: x.isNotNull())
    return facts.select("owner_id", F.explode(rows).alias("r")).select("owner_id", "r.area", "r.priority")


def team_report(reviews: DataFrame, repositories: DataFrame, issues: DataFrame, start: str, end: str) -> DataFrame:
    """Per owner with reviews in the period: totals, the trend of completed reviews, issues by category, and recommendations.

    ``days`` is whole days.  Owners without a review have no row.  Issues are those of the period's reviews.  Only completed
    reviews count in the issue sums, the mean quality, the trend and the recommendations.
    """
    held = in_period(owned_reviews(reviews, repositories), start, end)
    plain = held.drop("owner_id")
    facts = held.groupBy("owner_id").agg(
        F.count("*").alias("total_reviews"),
        count_if(done()).alias("completed_reviews"),
        F.coalesce(F.avg(F.when(done() & truthy("code_quality_score"), F.col("code_quality_score"))), F.lit(0.0)).alias("q"),
        F.coalesce(F.sum(F.when(done(), F.col("total_issues"))), F.lit(0)).cast("long").alias("total_issues_found"),
        F.coalesce(F.sum(F.when(done(), F.col("critical_issues"))), F.lit(0)).cast("long").alias("critical_issues_found"),
    )
    trends = weekly_trends(plain.where(done()), repositories).select("owner_id", "trend", F.col("change").alias("trend_change"))
    named = issues.join(held.select(F.col("id").alias("review_id"), "owner_id"), "review_id")
    counts = named.groupBy("owner_id", "category").agg(F.count("*").alias("n")).groupBy("owner_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("category", "n"))), lambda x: F.concat(x["category"], F.lit("="), x["n"].cast("string"))), ",").alias("issues_by_category"))
    advised = recommendations(plain.where(done()), repositories).groupBy("owner_id").agg(F.array_join(F.array_sort(F.collect_list("area")), ",").alias("recommendations"))
    out = facts.join(trends, "owner_id", "left").join(counts, "owner_id", "left").join(advised, "owner_id", "left")
    return out.select(
        "owner_id",
        whole_days_between(moment(start), moment(end)).cast("long").alias("days"),
        "total_reviews",
        "completed_reviews",
        round2(F.col("completed_reviews") / F.col("total_reviews") * 100.0).alias("completion_rate"),
        round2(F.col("q")).alias("average_quality_score"),
        "total_issues_found",
        "critical_issues_found",
        F.coalesce("trend", F.lit("insufficient_data")).alias("trend"),
        F.coalesce("trend_change", F.lit(0.0)).alias("trend_change"),
        F.coalesce("issues_by_category", F.lit("")).alias("issues_by_category"),
        F.coalesce("recommendations", F.lit("")).alias("recommendations"),
    )


_REPLIED = "array<struct<title:string,description:string,category:string,severity:string,line_number:int,code_snippet:string,suggested_fix:string,explanation:string>>"
# What a replied issue holds where the reply says nothing.
REPLY_DEFAULTS = {"title": "AI Detected Issue", "description": "", "category": "general", "code_snippet": "", "suggested_fix": "", "explanation": ""}


def replied_issues(replies: DataFrame) -> DataFrame:
    """Issues written as a JSON array somewhere in ``reply``: from the first [ to the last ].  Rows keep the other columns.

    No array, or one that can't be read: no rows.  Missing fields take defaults; an unknown severity is medium.
    """
    keys = [c for c in replies.columns if c != "reply"]
    found = F.from_json(F.regexp_extract("reply", r"(?s)\[.*\]", 0), _REPLIED)
    rows = replies.select(*keys, F.posexplode(found).alias("place", "i")).where("i IS NOT NULL")
    text = {c: F.coalesce(F.col(f"i.{c}"), F.lit(v)) for c, v in REPLY_DEFAULTS.items()}
    severity = F.when(F.col("i.severity").isin(*SEVERITIES), F.col("i.severity")).otherwise("medium")
    return rows.select(
        *keys, "place", text["title"].alias("title"), text["description"].alias("description"), text["category"].alias("category"), severity.alias("severity"), F.lit("ai_analysis").alias("rule_id"),
        F.coalesce("i.line_number", F.lit(1)).alias("line_start"), text["code_snippet"].alias("code_snippet"), text["suggested_fix"].alias("suggested_fix"), text["explanation"].alias("ai_explanation"), F.lit(0.75).alias("confidence_score"),
    )


def top_issues(issues: DataFrame, limit: int = 10) -> DataFrame:
    """Per review, the text that lists its worst issues (by severity, certainty, id)."""
    order = Window.partitionBy("review_id").orderBy(severity_rank("severity").desc(), F.coalesce("confidence_score", F.lit(0.5)).desc(), "id")
    best = issues.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= limit)
    listed = best.groupBy("review_id").agg(F.array_sort(F.collect_list(F.struct("_place", "title", "severity", "file_path", "line_start"))).alias("rows"))
    return listed.select("review_id", issue_lines(F.col("rows")).alias("top_issues"))


def quality_of(issues: DataFrame, reviews: DataFrame) -> DataFrame:
    """Counts and the four scores of every review; a review without issues scores 10 throughout."""
    kinds = {s: count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low")}
    fields = {c: count_if(F.col("category") == c).alias(c) for c in ("security", "maintainability", "performance")}
    counts = issues.groupBy("review_id").agg(F.count("*").alias("total"), *kinds.values(), *fields.values())
    all_of = reviews.select(F.col("id").alias("review_id"), "total_files").join(counts, "review_id", "left").na.fill(0)
    scores = quality_metrics(*[F.col(c) for c in (*kinds, *fields)], F.col("total_files"))
    return all_of.select("review_id", "total", *kinds, *fields, *[c.alias(n) for n, c in scores.items()])


def summary(quality: DataFrame) -> DataFrame:
    """The deterministic text that stands in for a written summary: risk and overall judgement of each review."""
    risk = F.when(F.col("critical") > 0, "High").when(F.col("high") > 5, "Medium").otherwise("Low")
    overall = F.when(F.col("total") > 10, "Needs Improvement").when(F.col("total") > 3, "Good").otherwise("Excellent")
    said = F.format_string("Found %d issues: %d critical, %d high, %d medium, %d low", "total", "critical", "high", "medium", "low")
    return quality.select("review_id", risk.alias("risk"), overall.alias("overall"), said.alias("summary"))


# What is advised where a category has issues.
ADVICE = {
    "security": ("high", "Address security vulnerabilities"),
    "performance": ("medium", "Optimise performance bottlenecks"),
    "code_quality": ("medium", "Improve code quality"),
}


def advice(issues: DataFrame) -> DataFrame:
    """Per review, one row for each of three categories that has issues."""
    counts = issues.where(F.col("category").isin(*ADVICE)).groupBy("review_id", "category").agg(F.count("*").alias("issues"))
    pick = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in ADVICE.items() for x in (k, v[i])]), F.col("category"))
    return counts.select("review_id", "category", pick(0).alias("priority"), pick(1).alias("advice"), "issues")
