"""The review of source files from end to end: scans, first findings kept, order, and the scores of each review."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import reports, scan, syntax

#: Order of the analyzers that find issues; earlier ones win where two agree.
STEPS = ("syntax", "pattern", "context", "custom")
_COLUMNS = ("review_id", "path", "title", "category", "severity", "rule_id", "line_start", "suggested_fix", "confidence_score", "seq")


def findings(files: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """Issues of the code files among ``files`` (review_id, path, content), each kind of finding at most once per place."""
    code = scan.code_files(files.select("review_id", "path", "content"))
    # one pass over the nodes gives the findings of two steps
    parsed = syntax.issues(syntax.nodes(code), ["review_id", "path"], nesting=True)
    parts = [
        parsed.withColumn("step", F.when(F.col("rule_id").isin(*syntax.SECURITY_RULES), STEPS.index("context")).otherwise(STEPS.index("syntax"))),
        scan.pattern_issues(code).withColumn("step", F.lit(STEPS.index("pattern"))),
        scan.context_issues(code).withColumn("step", F.lit(STEPS.index("context"))),
        scan.custom_issues(code, rules or []).withColumn("step", F.lit(STEPS.index("custom"))),
    ]
    # a step's own order takes less than 48 bits
    numbered = [p.withColumn("seq", F.col("seq") + F.shiftleft(F.col("step").cast("long"), 48)).select(*_COLUMNS) for p in parts]
    return scan.deduplicated(reduce(DataFrame.unionByName, numbered), within=("review_id",))


def ranked(found: DataFrame) -> DataFrame:
    """Findings with their place in the order in which a review shows them."""
    from pyspark.sql import Window

    order = Window.partitionBy("review_id").orderBy(*scan.priority(), "path", "line_start")
    return found.withColumn("place", F.row_number().over(order))


def reviewed(files: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """Counts and scores of every review that has files, whether or not anything was found."""
    totals = files.groupBy(F.col("review_id").alias("id")).agg(F.count("*").cast("int").alias("total_files"))
    return reports.quality_of(findings(files, rules), totals)
