"""Entity views over the driver tables: deterministic projections, written once and used by Spark and by the checking SQL.

Each column is an expression that both engines read alike, or a pair (Spark, checking engine) where they differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

Expr = str | tuple[str, str]

#: The moment that relative-time questions refer to.
AS_OF = "2001-08-01 00:00:00"


def text(e: str) -> str:
    return f"CAST({e} AS {{text}})"


def plus_hours(ts: str, hours: str) -> Expr:
    return (f"{ts} + make_dt_interval(0, CAST({hours} AS INT), 0, 0)", f"{ts} + to_hours(CAST({hours} AS INTEGER))")


def fixed(ts: str) -> Expr:
    return (f"TIMESTAMP_NTZ '{ts}'", f"TIMESTAMP '{ts}'")


def both(template: str, **parts: Expr) -> Expr:
    """A template whose parts may differ between the engines."""
    pick = lambda i: template.format(text="{text}", **{k: v if isinstance(v, str) else v[i] for k, v in parts.items()})
    return pick(0), pick(1)


_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'in_progress' ELSE CASE WHEN o_orderpriority = '5-LOW' THEN 'failed' ELSE 'pending' END END"
_ISSUE_PATH = f"'src/m' || {text('l_partkey % 50')} || '/f' || {text('l_partkey')} || CASE l_partkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.java' ELSE '.go' END"
_SCORE = "CAST(CASE WHEN o_orderkey % {null} = 0 THEN NULL WHEN o_orderkey % {zero} = 0 THEN 0 ELSE (o_orderkey * {k}) % 101 END AS DOUBLE) / CAST(10 AS DOUBLE)"

ENTITIES: dict[str, tuple[str, dict[str, Expr]]] = {
    "users": (
        "nation",
        {
            "id": "CAST(n_nationkey AS BIGINT)",
            "username": "lower(n_name)",
            "email": "lower(n_name) || '@example.org'",
            "full_name": "'User ' || n_name",
            "is_active": "n_nationkey % 4 <> 0",
            "is_verified": "n_nationkey % 3 = 0",
            "is_superuser": "n_nationkey = 0",
            "github_id": f"CASE WHEN n_nationkey % 2 = 0 THEN 'gh' || {text('n_nationkey')} END",
            "gitlab_id": f"CASE WHEN n_nationkey % 5 = 0 THEN 'gl' || {text('n_nationkey')} END",
            "bitbucket_id": "CAST(NULL AS {text})",
            "created_at": both("{a}", a=plus_hours("@2001-06-20 12:00:00", "n_nationkey * 50")),
        },
    ),
    "repositories": (
        "customer",
        {
            "id": "c_custkey",
            "owner_id": "CAST(c_nationkey AS BIGINT)",
            "name": "c_name",
            "full_name": "'org/' || c_name",
            "description": "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'Code of the ' || lower(c_mktsegment) || ' team' END",
            "language": "CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 10 = 0 THEN '' ELSE c_mktsegment END",
            "provider": "CASE c_custkey % 3 WHEN 0 THEN 'github' WHEN 1 THEN 'gitlab' ELSE 'bitbucket' END",
            "external_id": text("c_custkey * 7 % 1000"),
            "size": "CAST(c_custkey % 500 AS INT)",
            "is_active": "c_acctbal > 0",
            "is_archived": "c_custkey % 10 = 0",
            "created_at": both("{a}", a=plus_hours("@1995-01-01 00:00:00", "c_custkey * 11 % 9000")),
            "last_analysis": both("CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE {a} END", a=plus_hours("@2000-01-01 00:00:00", "c_custkey * 13 % 9000")),
        },
    ),
    "reviews": (
        "orders",
        {
            "id": "o_orderkey",
            "repository_id": "o_custkey",
            "author_id": "o_custkey % 25",
            "title": f"'Review ' || {text('o_orderkey')}",
            "status": _STATUS,
            "total_files": "CAST(o_orderkey % 30 + 1 AS INT)",
            "total_issues": "CAST(CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderkey % 20 END AS INT)",
            "critical_issues": "CAST(o_orderkey % 4 AS INT)",
            "high_issues": "CAST(o_orderkey % 5 AS INT)",
            "progress": f"CASE WHEN {_STATUS} = 'completed' THEN CAST(1 AS DOUBLE) ELSE CAST(o_orderkey % 10 AS DOUBLE) / CAST(10 AS DOUBLE) END",
            "code_quality_score": _SCORE.format(null=13, zero=17, k=1),
            "security_score": _SCORE.format(null=11, zero=23, k=3),
            "maintainability_score": _SCORE.format(null=7, zero=29, k=7),
            "performance_score": _SCORE.format(null=5, zero=31, k=11),
            "created_at": "o_orderdate",
            "updated_at": plus_hours("o_orderdate", "o_orderkey % 72 + 1"),
            "completed_at": both("CASE WHEN {s} = 'completed' THEN {a} END", s=_STATUS, a=plus_hours("o_orderdate", "o_orderkey % 72")),
        },
    ),
    "issues": (
        "lineitem",
        {
            "review_id": "l_orderkey",
            "id": "l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)",
            "title": f"'Finding ' || {text('l_partkey % 20')}",
            "description": f"'Found by check ' || {text('l_suppkey % 7')}",
            "category": "CASE l_suppkey % 5 WHEN 0 THEN 'security' WHEN 1 THEN 'performance' WHEN 2 THEN 'maintainability' WHEN 3 THEN 'style' ELSE 'code_quality' END",
            "severity": "CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'critical' WHEN l_returnflag = 'R' THEN 'high' WHEN l_returnflag = 'A' THEN 'medium' ELSE 'low' END",
            "rule_id": f"'rule_' || {text('l_suppkey % 7')}",
            "file_path": _ISSUE_PATH,
            "line_start": "CAST(l_quantity AS INT)",
            "line_end": "CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber % 5 = 0 THEN 0 ELSE CAST(l_quantity AS INT) + l_linenumber END",
            "confidence_score": "CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_linenumber AS DOUBLE) / CAST(10 AS DOUBLE) END",
            "is_resolved": "l_linestatus = 'F'",
            "is_false_positive": "l_partkey % 11 = 0",
            "created_at": "l_shipdate",
        },
    ),
    "comments": (
        "conversations",
        {
            "id": "conv_id * 1000 + turn",
            "review_id": "conv_id",
            "author_id": "conv_id % 25",
            "content": "text",
            "comment_type": "CASE role WHEN 'user' THEN 'general' WHEN 'assistant' THEN 'suggestion' ELSE 'question' END",
            "is_resolved": "turn % 2 = 0",
            "parent_id": "CASE WHEN turn = 0 THEN NULL WHEN turn % 3 = 0 THEN 0 ELSE conv_id * 1000 + turn - turn % 3 END",
            "created_at": plus_hours("@2001-01-01 00:00:00", "conv_id % 100 + turn * 7 % 5"),
        },
    ),
    "files": (
        "documents",
        {
            "review_id": "doc_id % 100",
            "path": f"CASE doc_id % 7 WHEN 0 THEN 'conf/.env' || {text('doc_id')} WHEN 1 THEN 'conf/app' || {text('doc_id')} || '.yaml' WHEN 2 THEN 'test/case' || {text('doc_id')} || '.py' WHEN 3 THEN 'lib/m' || {text('doc_id')} || '.js' "
            f"WHEN 4 THEN 'deps/setup.py' WHEN 5 THEN 'docs/page' || {text('doc_id')} || '.MD' ELSE 'src/f' || {text('doc_id')} || '.py' END",
            "doc_id": "doc_id",
            "content": "text",
        },
    ),
    "requests": ("events", {"request_id": "event_id", "client": f"'c' || {text('user_id')}", "ts": "ts"}),
    "commits": (
        "orders",
        {
            "repo_id": "o_custkey % 60",
            "sha": f"md5({text('o_orderkey')})",
            "author_name": f"'dev ' || {text('o_orderkey % 17')}",
            "author_email": f"'dev' || {text('o_orderkey % 17')} || '@example.org'",
            "message": f"'Change ' || {text('o_orderkey')} || CASE WHEN o_orderkey % 10 = 0 THEN ' with a long account of what was done and why it had to be done in just this way and no other, at length' ELSE '' END",
            "committed_at": plus_hours("o_orderdate", "o_orderkey % 24"),
        },
    ),
    "file_changes": (
        "lineitem",
        {
            "repo_id": "l_orderkey % 60",
            "sha": f"md5({text('l_orderkey')})",
            "a_path": f"CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE {_ISSUE_PATH} END",
            "b_path": f"CASE WHEN l_linenumber % 5 = 0 THEN NULL WHEN l_linenumber % 6 = 0 THEN 'moved/' || {text('l_partkey')} ELSE {_ISSUE_PATH} END",
            "additions": "CAST(l_quantity AS INT)",
            "deletions": "CAST(l_linenumber AS INT)",
        },
    ),
}


def _at(sql: str, engine: int) -> str:
    """Literal moments are written @yyyy-mm-dd hh:mm:ss."""
    import re

    return re.sub(r"@(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)", r"TIMESTAMP_NTZ '\1'" if engine == 0 else r"TIMESTAMP '\1'", sql)


def rendered(expr: Expr, engine: int) -> str:
    one = expr if isinstance(expr, str) else expr[engine]
    return _at(one, engine).replace("{text}", "STRING" if engine == 0 else "VARCHAR")


def entity(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, columns = ENTITIES[name]
    return spark.read.parquet(f"{sf_dir}/{base}.parquet").selectExpr(*[f"{rendered(e, 0)} AS {c}" for c, e in columns.items()])


def with_sql(*names: str) -> str:
    """The WITH clause that defines the named entities for the checking engine."""
    parts = []
    for name in names:
        base, columns = ENTITIES[name]
        parts.append(f"{name} AS (SELECT " + ", ".join(f"{rendered(e, 1)} AS {c}" for c, e in columns.items()) + f" FROM {base})")
    return "WITH " + ",\n".join(parts)
