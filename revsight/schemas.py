"""Column contracts of the entity tables, as Spark DDL."""

from __future__ import annotations

from pyspark.sql.types import StructType

USERS = (
    "id LONG NOT NULL, email STRING NOT NULL, username STRING NOT NULL, full_name STRING, hashed_password STRING NOT NULL, avatar_url STRING, bio STRING, location STRING, "
    "company STRING, website STRING, is_active BOOLEAN NOT NULL, is_verified BOOLEAN NOT NULL, is_superuser BOOLEAN NOT NULL, github_id STRING, gitlab_id STRING, bitbucket_id STRING, "
    "preferences STRING, notification_settings STRING, last_login TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ NOT NULL, updated_at TIMESTAMP_NTZ"
)
REPOSITORIES = (
    "id LONG NOT NULL, name STRING NOT NULL, full_name STRING NOT NULL, description STRING, url STRING NOT NULL, clone_url STRING NOT NULL, default_branch STRING, language STRING, size INT, "
    "is_private BOOLEAN, is_active BOOLEAN, is_archived BOOLEAN, provider STRING NOT NULL, external_id STRING NOT NULL, webhook_id STRING, analysis_enabled BOOLEAN, auto_review BOOLEAN, "
    "review_rules STRING, notification_settings STRING, total_reviews INT, total_issues INT, avg_review_time INT, created_at TIMESTAMP_NTZ NOT NULL, updated_at TIMESTAMP_NTZ, "
    "last_analysis TIMESTAMP_NTZ, owner_id LONG NOT NULL"
)
REVIEWS = (
    "id LONG NOT NULL, title STRING NOT NULL, description STRING, status STRING NOT NULL, progress DOUBLE, pr_number INT, pr_title STRING, pr_url STRING, source_branch STRING, target_branch STRING, "
    "total_files INT, analyzed_files INT, total_issues INT, critical_issues INT, high_issues INT, medium_issues INT, low_issues INT, code_quality_score DOUBLE, security_score DOUBLE, "
    "maintainability_score DOUBLE, test_coverage DOUBLE, ai_summary STRING, ai_recommendations STRING, analysis_metadata STRING, created_at TIMESTAMP_NTZ NOT NULL, updated_at TIMESTAMP_NTZ, "
    "completed_at TIMESTAMP_NTZ, repository_id LONG NOT NULL, author_id LONG NOT NULL"
)
ISSUES = (
    "id LONG NOT NULL, title STRING NOT NULL, description STRING NOT NULL, category STRING NOT NULL, severity STRING NOT NULL, rule_id STRING, file_path STRING NOT NULL, line_start INT NOT NULL, "
    "line_end INT, column_start INT, column_end INT, code_snippet STRING, suggested_fix STRING, ai_explanation STRING, confidence_score DOUBLE, is_resolved BOOLEAN, is_false_positive BOOLEAN, "
    "created_at TIMESTAMP_NTZ NOT NULL, updated_at TIMESTAMP_NTZ, resolved_at TIMESTAMP_NTZ, review_id LONG NOT NULL"
)
COMMENTS = (
    "id LONG NOT NULL, content STRING NOT NULL, comment_type STRING, file_path STRING, line_number INT, is_resolved BOOLEAN, created_at TIMESTAMP_NTZ NOT NULL, updated_at TIMESTAMP_NTZ, "
    "author_id LONG NOT NULL, review_id LONG, issue_id LONG, parent_id LONG"
)
#: A found issue before it has an id; ``seq`` is the order of discovery, by analyzer, rule and match.
FOUND = "file_path STRING, title STRING, description STRING, category STRING, severity STRING, rule_id STRING, line_start INT, line_end INT, code_snippet STRING, suggested_fix STRING, confidence_score DOUBLE, seq LONG"

STATUSES = ("pending", "in_progress", "completed", "failed")
SEVERITIES = ("low", "medium", "high", "critical")
PROVIDERS = ("github", "gitlab", "bitbucket")


def schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def required(ddl: str) -> list[str]:
    """Columns that may not be null."""
    return [f.name for f in schema(ddl).fields if not f.nullable]
