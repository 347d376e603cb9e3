"""Queries over source text, diffs and requests, with checking SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..entities import with_sql
from ..operators import diffs, rules, scan, syntax
from ..streaming import limiter
from . import review
from .registry import register, tables

#: Python, JavaScript, Java and C sources that break rules, one file each, beside the stored files, whose texts are prose.
SOURCES = (
    ("app/a.py", 'password = "hunter2hunter2"\ncur.execute("select 1")\nx = 5 % 2\ndebug = True\n'),
    ("app/b.py", "def Work(a, b, c, d, e, f=[]):\n    y = 7\n    for i in range(3):\n        z.append(i)\n    return 1\n    eval('2')\n"),
    ("app/c.py", "try:\n    subprocess.run('x', shell=True)\nexcept:\n    pass\nassert x == None\n"),
    ("app/d.py", "def broken(:\n"),
    ("web/e.js", "function go(a) {\n  el.innerHTML = a + b;\n  document.write(eval(a));\n}\n"),
    ("srv/F.java", 'import java.io.File;\npublic class F extends G {\n  public void run(String s) {\n    new File("/x" + s);\n  }\n}\n'),
    ("lib/g.c", "#include <stdio.h>\nstruct {\nint main(void) {\n"),
)


def source_files(spark, sf_dir):  # noqa: ANN001, ANN201
    """All stored files, each under a path of its own, and the planted sources."""
    own = F.when(F.col("path") == "deps/setup.py", F.concat(F.lit("deps/"), "doc_id", F.lit("/setup.py"))).otherwise(F.col("path"))
    stored = tables(spark, sf_dir, "files")[0].select("review_id", own.alias("path"), "content")
    return stored.unionByName(spark.createDataFrame([(i % 2, p, c) for i, (p, c) in enumerate(SOURCES)], "review_id long, path string, content string"))


def _secret_sql(pattern: str) -> str:
    flat = pattern.replace("'", "''")
    return f"(?i){flat}"


def _count(pattern: str) -> str:
    return f"len(regexp_extract_all(content, '{_secret_sql(pattern)}'))"


def _line_sum(pattern: str) -> str:
    """Sum over matches of the line they start on: one, and the line feeds before."""
    p = _secret_sql(pattern)
    return f"list_sum(list_transform(range(1, len(regexp_extract_all(content, '{p}')) + 1), lambda i: 1 + length(array_to_string(regexp_split_to_array(content, '{p}')[1:i], '')) - length(replace(array_to_string(regexp_split_to_array(content, '{p}')[1:i], ''), chr(10), ''))))"


@register(
    "config_secrets",
    with_sql("files")
    + ", c AS (SELECT * FROM files WHERE regexp_matches(path, '/\\.env[^/]*$|\\.yaml$')) "
    + " UNION ALL ".join(f"SELECT '{t}' AS title, CAST(coalesce(sum({_count(p)}), 0) AS BIGINT) AS issues, CAST(coalesce(sum({_line_sum(p)}), 0) AS BIGINT) AS line_sum FROM c HAVING sum({_count(p)}) > 0" for p, t in rules.CONFIG_SECRETS),
)
def config_secrets(spark, sf_dir):  # noqa: ANN001, ANN201
    found = scan.context_issues(tables(spark, sf_dir, "files")[0]).where("rule_id = 'config_secrets'")
    return found.groupBy("title").agg(F.count("*").alias("issues"), F.sum("line_start").alias("line_sum"))


@register(
    "custom_rules",
    with_sql("files") + f", c AS (SELECT doc_id, {' + '.join(_count(p) for p in rules.CUSTOM['no_hardcoded_secrets'])} AS n FROM files) SELECT doc_id, CAST(n AS BIGINT) AS issues FROM c WHERE n > 0",
)
def custom_rules(spark, sf_dir):  # noqa: ANN001, ANN201
    found = scan.custom_issues(tables(spark, sf_dir, "files")[0], ["no_hardcoded_secrets", "not_a_rule"])
    return found.groupBy("doc_id").agg(F.count("*").alias("issues"))


@register(
    "python_patterns",
    with_sql("files")
    + ", c AS (SELECT * FROM files WHERE path LIKE '%.py') "
    + " UNION ALL ".join(f"SELECT '{r.rule_id}' AS rule_id, CAST(sum({_count(r.pattern)}) AS BIGINT) AS issues FROM c HAVING sum({_count(r.pattern)}) > 0" for r in rules.SECURITY["python"]),
)
def python_patterns(spark, sf_dir):  # noqa: ANN001, ANN201
    return scan.pattern_issues(tables(spark, sf_dir, "files")[0]).where("path LIKE '%.py'").groupBy("rule_id").agg(F.count("*").alias("issues"))


@register("code_chunks", with_sql("files") + " SELECT doc_id, CAST(ceil(len(string_split(content, chr(10))) / 20.0::DOUBLE) AS BIGINT) AS chunks, len(string_split(content, chr(10))) AS split_lines FROM files")
def code_chunks(spark, sf_dir):  # noqa: ANN001, ANN201
    files = tables(spark, sf_dir, "files")[0].withColumn("path", F.col("doc_id").cast("string"))
    parts = scan.chunks(files).groupBy("path").agg(F.count("*").alias("chunks"))
    return parts.join(scan.line_counts(files), "path").select(F.col("path").cast("long").alias("doc_id"), "chunks", F.col("split_lines").cast("long").alias("split_lines"))


@register("review_findings")
def review_findings(spark, sf_dir):  # noqa: ANN001, ANN201
    return review.ranked(review.findings(source_files(spark, sf_dir), ["no_todo_comments"])).select("review_id", "place", "path", "rule_id", "severity", "category", "line_start")


@register("review_scores")
def review_scores(spark, sf_dir):  # noqa: ANN001, ANN201
    return review.reviewed(source_files(spark, sf_dir))


@register("code_structure")
def code_structure(spark, sf_dir):  # noqa: ANN001, ANN201
    files = source_files(spark, sf_dir)
    python = syntax.definitions(syntax.nodes(files.select("path", "content")))
    return python.select("path", F.lit("python").alias("language"), "kind", "name", "line").unionByName(scan.structure(files).select("path", "language", "kind", "name", "line"))


def change_diffs(spark, sf_dir):  # noqa: ANN001, ANN201
    """A unified diff of each review, made from its line items: one file each, with as many added and removed lines as the item says."""
    items = tables(spark, sf_dir, "issues")[0].select("review_id", "id", "file_path", "line_start", F.when(F.col("severity") == "low", 1).otherwise(0).alias("gone"))

    def file(x):  # noqa: ANN001, ANN202
        body = F.concat(F.repeat(F.lit("+import x\n"), x["line_start"]), F.repeat(F.lit("-def y(a):\n"), x["gone"] * 3), F.lit(" same\n"))
        name = F.concat(F.lit("a/"), x["file_path"], F.lit(" b/"), x["file_path"])
        return F.concat(F.lit("diff --git "), name, F.lit("\nindex 1a2b3c4..5d6e7f8 100644\n--- a/"), x["file_path"], F.lit("\n+++ b/"), x["file_path"], F.lit("\n@@ -1,1 +1,1 @@ here\n"), body)

    # what tells an item is gathered, not its text, which is many times as long
    told = F.sort_array(F.collect_list(F.struct("id", "file_path", "line_start", "gone")))
    return items.groupBy(F.col("review_id").alias("diff_id")).agg(F.array_join(F.transform(told, file), "").alias("diff_text"))


_ITEMS = """, i AS (SELECT review_id AS diff_id, id, file_path, CAST(line_start AS BIGINT) AS additions, CAST(CASE WHEN severity = 'low' THEN 3 ELSE 0 END AS BIGINT) AS deletions FROM issues)"""


@register(
    "diff_totals",
    with_sql("issues") + _ITEMS + """ SELECT diff_id, count(*) AS total_files, CAST(sum(additions) AS BIGINT) AS total_additions, CAST(sum(deletions) AS BIGINT) AS total_deletions, CAST(sum(additions + deletions) AS BIGINT) AS total_changes,
  round((least(count(*) / 10.0::DOUBLE, 1) + least(sum(additions + deletions) / 500.0::DOUBLE, 1)) * 5, 2) AS complexity_score FROM i GROUP BY diff_id""",
)
def diff_totals(spark, sf_dir):  # noqa: ANN001, ANN201
    made = change_diffs(spark, sf_dir)
    return diffs.totals(made, diffs.files(made))


@register("diff_types", with_sql("issues") + _ITEMS + " SELECT diff_id, string_split(file_path, '.')[-1] AS extension, count(*) AS files, CAST(sum(additions) AS BIGINT) AS additions, CAST(sum(deletions) AS BIGINT) AS deletions FROM i GROUP BY ALL")
def diff_types(spark, sf_dir):  # noqa: ANN001, ANN201
    return diffs.by_type(diffs.files(change_diffs(spark, sf_dir)))


@register("diff_largest", with_sql("issues") + _ITEMS + ", r AS (SELECT *, additions + deletions AS changes, CAST(row_number() OVER (PARTITION BY diff_id ORDER BY additions + deletions DESC, id) AS INTEGER) AS place FROM i) SELECT diff_id, place, file_path, changes, additions, deletions FROM r WHERE place <= 5")
def diff_largest(spark, sf_dir):  # noqa: ANN001, ANN201
    return diffs.largest(diffs.files(change_diffs(spark, sf_dir)))


@register("request_counts", with_sql("requests") + " SELECT client, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS requests FROM requests GROUP BY ALL")
def request_counts(spark, sf_dir):  # noqa: ANN001, ANN201
    counted = limiter.counts(tables(spark, sf_dir, "requests")[0])
    return counted.select("client", F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "requests")


@register(
    "trailing_requests",
    with_sql("requests") + " SELECT request_id, client, count(*) OVER (PARTITION BY client ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS in_window FROM requests",
)
def trailing_requests(spark, sf_dir):  # noqa: ANN001, ANN201
    return limiter.trailing_counts(tables(spark, sf_dir, "requests")[0], 3600).select("request_id", "client", "in_window")


_HELD = "list_filter(s.held, lambda h: h > n.u - 3600000000)"


@register(
    "rate_limit",
    with_sql("requests").replace("WITH ", "WITH RECURSIVE ", 1) + f""", n AS (SELECT request_id, client, epoch_us(ts) AS u, row_number() OVER (PARTITION BY client ORDER BY ts, request_id) AS k FROM requests),
s AS (SELECT client, k, request_id, TRUE AS accepted, [u] AS held FROM n WHERE k = 1
  UNION ALL SELECT n.client, n.k, n.request_id, len({_HELD}) < 3, CASE WHEN len({_HELD}) < 3 THEN list_append({_HELD}, n.u) ELSE {_HELD} END FROM s JOIN n ON n.client = s.client AND n.k = s.k + 1)
SELECT request_id, client, accepted FROM s""",
)
def rate_limit(spark, sf_dir):  # noqa: ANN001, ANN201
    return limiter.limited(tables(spark, sf_dir, "requests")[0], 3, 3600).select("request_id", "client", "accepted")
