"""Hand-worked cases and edges of the library's operators."""

from __future__ import annotations

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from revsight.functions import paths as P
from revsight.functions import texts
from revsight.functions import times as T
from revsight.functions.scores import round2, truthy
from revsight.operators import client, dashboards, diffs, gitstats, listing, relations, reports, rules, scan, syntax
from revsight.plans import review
from revsight.sources import readers, updates
from revsight.streaming import limiter

REVIEW = "id long, repository_id long, status string, created_at timestamp_ntz, completed_at timestamp_ntz, code_quality_score double, security_score double, total_issues int"


def one(df):  # noqa: ANN001, ANN201
    return df.collect()[0]


def test_week_key_and_round(spark) -> None:
    rows = spark.sql("SELECT timestamp_ntz'2024-01-06 00:00:00' AS a, timestamp_ntz'2024-01-07 00:00:00' AS b").select(T.week_key("a"), T.week_key("b"), round2(F.lit(2.575)), truthy(F.lit(0.0)))
    assert tuple(one(rows)) == ("2024-W00", "2024-W01", 2.58, False)


def test_trends_of_three_scores(spark) -> None:
    def reviews(scores):  # noqa: ANN001, ANN202
        return spark.createDataFrame([(i, 1, "completed", f"2001-07-{i + 1:02d} 00:00:00", None, s, None, None) for i, s in enumerate(scores)], REVIEW.replace("timestamp_ntz", "string")).withColumn("created_at", F.col("created_at").cast("timestamp_ntz")).withColumn("completed_at", F.col("completed_at").cast("timestamp_ntz"))

    users = spark.createDataFrame([(1,), (2,)], "id long")
    repos = spark.createDataFrame([(1, 1)], "id long, owner_id long")
    got = {r["owner_id"]: r for r in dashboards.quality_trends(users, repos, reviews([6.0, 7.0, 9.0]), "2001-08-01 00:00:00").collect()}
    assert (got[1]["trend"], got[1]["improvement"], got[2]["trend"]) == ("stable", 2.0, "stable")
    assert one(dashboards.repository_stats(reviews([6.0, 7.0, 9.0])))["quality_trend"] == "improving"
    assert one(dashboards.repository_stats(reviews([6.0, 0.0, 9.0])))["quality_trend"] == "stable"
    assert one(dashboards.quality_trends(users.where("id = 1"), repos, reviews([6.0]), "2001-08-01 00:00:00"))["trend"] == "insufficient_data"


def test_null_order_of_repositories(spark) -> None:
    df = spark.sql("SELECT * FROM VALUES (1L, NULL, 'a'), (2L, timestamp_ntz'2024-01-02 00:00:00', 'b'), (3L, timestamp_ntz'2024-01-01 00:00:00', 'c') AS t(id, last_analysis, name)").withColumn("created_at", F.lit("x")).withColumn("owner_id", F.lit(1))
    assert [r["id"] for r in listing.repositories(df).collect()] == [1, 2, 3]
    assert [r["id"] for r in listing.client_repositories(df).collect()] == [2, 3, 1]
    with pytest.raises(ValueError):
        listing.page(df, 0, 1001)


def test_threads(spark) -> None:
    df = spark.createDataFrame([(1, None, 1, "general"), (2, 1, 3, "general"), (3, 1, 2, "issue"), (4, 0, 4, "general")], "id long, parent_id long, created_at long, comment_type string").withColumn("content", F.lit("x"))
    got = {r["id"]: [x["id"] for x in r["replies"] or []] for r in relations.threads(df).collect()}
    assert got == {1: [3, 2], 4: []}
    assert [r["id"] for r in relations.threads_of_type(relations.threads(df), "issue").collect()] == [1]


def test_file_tree(spark) -> None:
    df = spark.createDataFrame([(1, "src/a.py"), (1, "src/a.py"), (1, "src/b.py"), (1, "top.py")], "review_id long, file_path string")
    assert [tuple(r) for r in client.file_tree(df).collect()] == [(1, "src", 3, 2, 6)]


def test_file_tree_deals_rows_once_in_parts_of_a_size(spark, monkeypatch) -> None:
    monkeypatch.setattr(client, "PART_ROWS", 100)
    df = spark.range(1_000).select((F.col("id") % 90).alias("review_id"), F.concat(F.lit("a/b"), (F.col("id") % 4).cast("string"), F.lit("/f"), "id").alias("file_path"))
    made = client.file_tree(df)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan and made.rdd.getNumPartitions() == 10
    want: dict = {}
    for i in range(1_000):
        for folder in ("a", f"a/b{i % 4}"):
            want[i % 90, folder] = want.get((i % 90, folder), 0) + 1
    assert {(r["review_id"], r["folder"]): (r["issues"], r["files"], r["compat"]) for r in made.collect()} == {k: (n, n, n * n) for k, n in want.items()}


def test_paths(spark) -> None:
    df = spark.createDataFrame([("a/.env",), ("A/B.Py",), ("x.tar.gz",), ("setup.py",), ("settings.py",), ("test/y.go",), ("node_modules/a.js",)], "path string")
    got = {r[0]: tuple(r[1:]) for r in df.select("path", P.suffix("path"), P.language("path"), P.is_config_file("path"), P.is_test_file("path"), P.is_dependency_file("path"), P.is_scanned("path")).collect()}
    assert got["a/.env"] == ("", "unknown", True, False, False, False)
    assert got["A/B.Py"] == (".py", "python", False, False, False, True)
    assert got["x.tar.gz"][0] == ".gz"
    assert got["setup.py"][4] and not got["settings.py"][2] and got["test/y.go"][3] and not got["node_modules/a.js"][5]
    assert one(spark.range(1).select(P.repository_name(F.lit("https://x.org/a/my repo.git"))))[0] == "my_repo"


SOURCE = 'password = "hunter2hunter2"\ncur.execute("select 1")\nx = 5 % 2\ndebug = True\n'


def test_review_of_one_file(spark) -> None:
    files = spark.createDataFrame([(1, "app/a.py", SOURCE)], "review_id long, path string, content string")
    found = [(r["rule_id"], r["severity"], r["line_start"], r["category"]) for r in review.ranked(review.findings(files)).orderBy("place").collect()]
    assert found == [
        ("hardcoded_password", "critical", 1, "security"),
        ("hardcoded_credential", "high", 1, "code_quality"),
        ("command_injection", "high", 3, "security"),
        ("debug_mode", "medium", 4, "security"),
        ("magic_number", "low", 3, "code_quality"),
    ]
    assert one(review.reviewed(files).select("code_quality_score", "security_score", "maintainability_score", "performance_score")) == (1.5, 4.0, 8.0, 10.0)


def test_blank_and_broken_files(spark) -> None:
    files = spark.createDataFrame([(1, "a.py", " \n\t"), (2, "b.py", "def (:\n"), (3, "c.txt", SOURCE), (4, "d.py", None)], "review_id long, path string, content string")
    assert [(r["review_id"], r["rule_id"]) for r in review.findings(files).collect()] == [(2, "syntax_error")]
    assert review.findings(files.limit(0)).count() == 0


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(['password = "abcdefgh1"', "x", "\n", "\r\n", "debug=True", "é", " eval (", "%"]), max_size=12))
def test_match_lines_like_a_plain_search(spark, parts) -> None:
    text = "".join(parts)
    df = spark.createDataFrame([("a.py", text)], "path string, content string")
    want = sorted((r.rule_id, text[: m.start()].count("\n") + 1) for r in rules.SECURITY["python"] for m in re.finditer(r.pattern, text, re.I | re.M))
    assert sorted((r["rule_id"], r["line_start"]) for r in scan.pattern_issues(df).collect()) == want


def test_syntax_rules(spark) -> None:
    text = "import os\ndef F(a, b, c, d, e, f=[], g=1, h={}):\n    global q\n    x = 5\n    print(x == None)\n    return 2\n    y = '%s' % a\nfor i in z:\n    z.append(i)\n    t += 'x'\nclass bad_name:\n    async def m(self):\n        pass\n"
    df = spark.createDataFrame([("a.py", text)], "path string, content string")
    tree = syntax.nodes(df)
    found = {(r["rule_id"], r["line_start"]) for r in syntax.issues(tree).collect()}
    assert found == {
        ("function_naming", 2), ("long_parameter_list", 2), ("too_many_params", 2), ("missing_docstring", 2), ("mutable_default", 2), ("unused_variable", 2), ("global_usage", 3), ("magic_number", 4),
        ("none_comparison", 5), ("magic_number", 6), ("unreachable_code", 7), ("old_string_format", 7), ("inefficient_loop", 8), ("string_concat_loop", 8), ("class_naming", 11), ("missing_class_docstring", 11),
    }
    kinds = {(r["kind"], r["name"], r["detail"]) for r in syntax.definitions(tree).collect()}
    assert {("import", "os", None), ("function", "F", "a,b,c,d,e,f,g,h"), ("class", "bad_name", ""), ("variable", "x", "int"), ("variable", "y", "unknown")} == kinds


DIFF = "diff --git a/app/auth.py b/app/auth.py\nindex 1a2b3c4..5d6e7f8 100644\n--- a/app/auth.py\n+++ b/app/auth.py\n@@ -10,3 +10,4 @@ class A\n x = 1\n-def old(a):\n+def new(a):\n+    # note\n"


def test_diff(spark) -> None:
    df = spark.createDataFrame([(1, DIFF), (2, " "), (3, None)], "diff_id long, diff_text string")
    files = diffs.files(df)
    assert one(files.select("file_path", "old_file", "new_file", "change_type", "additions", "deletions", "changes")) == ("app/auth.py", "pp/auth.py", "app/auth.py", "modified", 2, 1, 3)
    assert [(r["kind"], r["line_number"], r["true_line"]) for r in diffs.changes(df).orderBy("at").collect()] == [("context", 10, 10), ("removed", 10, 11), ("added", 10, 11), ("added", 11, 12)]
    assert {r["diff_id"]: r["complexity_score"] for r in diffs.totals(df, files).collect()} == {1: 0.53, 2: 0.0, 3: 0.0}
    assert [tuple(r) for r in diffs.risks(files).collect()] == [(1, "app/auth.py", "critical_file", "high", ".*auth.*")]
    assert one(diffs.patterns(df)) == (1, 0, 0, 0, 1, 1, 1)
    assert {r["name"] for r in diffs.changed_functions(df).collect()} == {"new", "old"}


ODD_DIFF = """Subject: a note
diff --git a/docs/READ.md b/docs/READ.md
new file mode 100644
index 0000000..abc1234
--- /dev/null
+++ b/docs/READ.md
@@ -0,0 +1,2 @@
+# title
+import x
diff --git a/b/old.bin b/b/new.bin
index 1111111..2222222 100644
Binary files a/b/old.bin and b/b/new.bin differ
diff --git a/test/gone.py b/test/gone.py
deleted file mode 100755
--- a/test/gone.py
+++ /dev/null
@@ -3,4 +3,4 @@ def f():
 kept
-def same(a):
---- not a removed line
-class Old:
+def same(a):
+++ neither
\\ No newline at end of file
@@ broken hunk @@
+never counted
-nor this
"""


def test_diffs_with_new_binary_and_deleted_files(spark) -> None:
    df = spark.createDataFrame([(7, ODD_DIFF)], "diff_id long, diff_text string")
    got = {r["file_path"]: r for r in diffs.files(df).collect()}
    assert [(r["file"], r["change_type"], r["mode_change"], r["is_binary"], r["additions"], r["deletions"]) for r in sorted(got.values(), key=lambda r: r["file"])] == [
        (1, "added", "100644", False, 2, 0),
        (2, "modified", None, True, 0, 0),
        (3, "removed", "100755", False, 1, 2),
    ]
    assert (got["docs/READ.md"]["old_file"], got["docs/READ.md"]["new_hash"]) == ("docs/READ.md", "abc1234")
    assert got["b/new.bin"]["old_file"] == "b/old.bin" and got["test/gone.py"]["new_file"] == "test/gone.py"
    # counts agree with those of numbered lines
    kinds = {(r["file"], r["kind"]): r["n"] for r in diffs.changes(df).groupBy("file", "kind").agg(F.count("*").alias("n")).collect()}
    assert kinds == {(1, "added"): 2, (3, "added"): 1, (3, "removed"): 2, (3, "context"): 1}
    # the removed twin of an added definition counts as added
    assert diffs.patterns(df).collect()[0].asDict() == {"diff_id": 7, "test_changes": 3, "documentation_changes": 2, "import_changes": 1, "function_additions": 2, "function_deletions": 1, "comment_changes": 1}
    assert {(r["type"], r["file_path"]) for r in diffs.risks(diffs.files(df)).collect()} == {("new_file", "docs/READ.md"), ("binary_change", "b/new.bin"), ("file_deletion", "test/gone.py")}
    assert df.select(diffs.commit_message(F.col("diff_text"))).first()[0] == "a note"



def test_rate_limit(spark) -> None:
    rows = [(i, "c", 0) for i in range(100)] + [(100, "c", 1), (101, "c", 59), (102, "c", 60)]
    df = spark.createDataFrame(rows, "request_id long, client string, s int").select("request_id", "client", (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("s"))).alias("ts"))
    got = {r["request_id"]: r["accepted"] for r in limiter.limited(df).collect()}
    assert [i for i in range(103) if not got[i]] == [100, 101]


def test_stream_equals_table(spark, tmp_path) -> None:
    base = [(i, f"c{i % 3}", i * 7 % 200) for i in range(300)]
    base.sort(key=lambda r: (r[2], r[0]))
    df = spark.createDataFrame(base, "request_id long, client string, s int").select("request_id", "client", (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(secs=F.col("s"))).alias("ts"))
    for k, (a, b) in enumerate([(0, 66), (66, 133), (133, 201)]):
        df.where((F.second("ts") + F.minute("ts") * 60 >= a) & (F.second("ts") + F.minute("ts") * 60 < b)).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    # a request is decided once event time has passed it: one more, far later, moves it on
    spark.sql("SELECT -1L AS request_id, 'z' AS client, timestamp'2030-01-01 00:00:00' AS ts").coalesce(1).write.parquet(str(tmp_path / "in" / "last"))
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = limiter.limited_stream(stream, 5, 60).writeStream.format("memory").queryName("accepted").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(90)
    want = limiter.limited(df.withColumn("ts", F.col("ts").cast("timestamp_ntz")), 5, 60)
    assert {(r["request_id"], r["accepted"]) for r in spark.table("accepted").collect()} == {(r["request_id"], r["accepted"]) for r in want.collect()}


def test_updates(spark) -> None:
    names = spark.createDataFrame([(1, "ann"), (2, "ann"), (3, "bob"), (4, "ann")], "id long, username string")
    taken = spark.createDataFrame([("ann",), ("ann2",)], "username string")
    assert {r["id"]: r["username"] for r in updates.unique_usernames(names, taken).collect()} == {1: "ann1", 2: "ann3", 3: "bob", 4: "ann4"}
    merged = spark.range(1).select(updates.merged_json(F.lit('{"a":"1","b":"2"}'), F.lit('{"b":"3"}')), updates.merged_json(F.lit(None).cast("string"), F.lit(None).cast("string")))
    assert tuple(one(merged)) == ('{"a":"1","b":"3"}', "{}")


def test_source_tree_and_pages(spark, tmp_path) -> None:
    (tmp_path / "r" / "node_modules").mkdir(parents=True)
    (tmp_path / "r" / "a.py").write_bytes(b"x = 1\n\xff")
    (tmp_path / "r" / "node_modules" / "b.py").write_text("y")
    (tmp_path / "r" / "c.txt").write_text("z")
    assert [tuple(r) for r in readers.source_tree(spark, str(tmp_path / "r")).collect()] == [("a.py", "x = 1\n")]
    (tmp_path / "p").mkdir()
    for page, n in ((1, 100), (2, 3), (3, 5)):
        items = ", ".join(f'{{"id": {page * 1000 + i}, "name": "n"}}' for i in range(n))
        (tmp_path / "p" / f"{page}.json").write_text(f'{{"page": {page}, "items": [{items}]}}\n')
    assert readers.pages(spark, str(tmp_path / "p")).count() == 103


def test_violations(spark) -> None:
    from revsight.schemas import COMMENTS

    df = spark.createDataFrame([(1, "x", 5), (1, None, 6)], "id long, content string, author_id long")
    users = spark.createDataFrame([(5,)], "id long")
    got = {(r["rule"], r["column"]): r["rows"] for r in readers.violations(df, COMMENTS, ("id",), {"author_id": users}).collect()}
    assert got == {("required", "content"): 1, ("unique", "id"): 1, ("reference", "author_id"): 1}


def test_texts(spark) -> None:
    sizes = spark.createDataFrame([(0, "0 Bytes"), (1, "1 Bytes"), (100, "100 Bytes"), (1023, "1023 Bytes"), (1024, "1 KB"), (1536, "1.5 KB"), (1 << 20, "1 MB"), (10 << 30, "10 GB"), (5 << 40, "5120 GB"), (1234567, "1.18 MB")], "n long, want string")
    assert all(r["got"] == r["want"] for r in sizes.select("want", texts.file_size("n").alias("got")).collect())
    names = spark.createDataFrame([("HTTPServer", "http_server", "Httpserver"), ("getURL2Now", "get_url2_now", "Geturl2now"), ("a_bC", "a_b_c", "ABc"), ("", "", "")], "name string, snake string, pascal string")
    assert all((r[1], r[3]) == (r[2], r[4]) for r in names.select("name", "snake", texts.to_snake_case("name"), "pascal", texts.to_pascal_case("name")).collect())
    styles = spark.createDataFrame([("ab_c", True, False), ("Abc", False, True), ("A_b", False, False), ("_", False, False), ("9a", True, False)], "name string, snake boolean, pascal boolean")
    assert all((r[0], r[1]) == (r[2], r[3]) for r in styles.select("snake", "pascal", texts.is_snake_case("name"), texts.is_pascal_case("name")).collect())
    people = spark.createDataFrame([(" ann  b cole ", "AB"), ("x", "X"), ("  ", "AI"), (None, "AI")], "name string, want string")
    assert all(r[0] == r[1] for r in people.select("want", texts.initials("name")).collect())
    short = spark.range(1).select(texts.truncated(F.lit("abcd"), 3), texts.truncated(F.lit("abc"), 3), texts.truncated(F.lit(None).cast("string"), 3))
    assert tuple(one(short)) == ("abc...", "abc", None)


def test_account_faults(spark) -> None:
    rows = [("a@b.c", "ann", None, "12345678", "12345678", []), ("a@b", "an", "x" * 101, "1234567", "12345678", ["email", "username", "full_name", "password", "repeated"]), (None, None, None, None, None, ["email", "username", "password", "repeated"])]
    df = spark.createDataFrame(rows, "e string, u string, f string, p string, r string, want array<string>")
    assert all(r[0] == r[1] for r in df.select("want", texts.account_faults("e", "u", "f", "p", "r")).collect())


def test_rounding_of_halves(spark) -> None:
    df = spark.createDataFrame([(0.125, 0.13), (2.675, 2.68), (-0.125, -0.13), (1.005, 1.01), (0.124999, 0.12)], "x double, want double")
    assert all(r[0] == r[1] for r in df.select("want", round2(F.col("x"))).collect())


def test_new_rows_are_numbered_across_blocks(spark) -> None:
    held = spark.sql("SELECT 7L AS id, 'x' AS content, 'question' AS comment_type, true AS is_resolved, timestamp_ntz'2001-01-01 00:00:00' AS created_at, 'kept' AS extra")
    new = spark.createDataFrame([(70_000, "b", None), (3, "a", "issue"), (200_000, "c", None)], "seq long, content string, comment_type string")
    got = [tuple(r) for r in updates.inserted(held, "comments", new, "2002-01-01 00:00:00").orderBy("id").select("id", "content", "comment_type", "is_resolved", "extra").collect()]
    assert got == [(7, "x", "question", True, "kept"), (8, "a", "issue", False, None), (9, "b", "general", False, None), (10, "c", "general", False, None)]
    assert updates.inserted(held, "comments", new.limit(0), "2002-01-01 00:00:00").count() == 1
    assert updates.inserted(held.limit(0), "comments", new, "2002-01-01 00:00:00").agg(F.min("id"), F.max("id")).first() == (1, 3)


def test_deep_nesting_of_chains_and_elifs(spark) -> None:
    deep = "".join(" " * i + "while a:\n" for i in range(11))
    pad = " " * 11
    text = deep + f"{pad}if b and c and d:\n{pad} pass\n{pad}elif e or g:\n{pad} x = 1 if h else 0\n{pad}else:\n{pad} if k:\n{pad}  pass\n"
    df = spark.createDataFrame([("a.py", text)], "path string, content string")
    got = sorted((r["line_start"], r["description"].split()[-1]) for r in syntax.deep_nesting(syntax.nodes(df)).collect())
    # the if at depth 11, its condition's two ands and the elif's or below it, the conditional expression, the if in else
    assert got == [(12, "11)"), (12, "12)"), (12, "12)"), (14, "12)"), (15, "12)"), (17, "12)")]


def test_replies_that_cannot_be_read(spark) -> None:
    df = spark.createDataFrame([(1, None), (2, ""), (3, "no array"), (4, "[]"), (5, "[{'a"), (6, 'x [{"line_number": 4, "title": "t"}, {"severity": "low"}] y')], "id long, reply string")
    assert [(r["id"], r["place"], r["title"], r["severity"], r["line_start"]) for r in reports.replied_issues(df).orderBy("id", "place").collect()] == [(6, 0, "t", "medium", 4), (6, 1, "AI Detected Issue", "low", 1)]


def test_empty_tables_of_new_operators(spark) -> None:
    repos = spark.createDataFrame([], "id long, owner_id long")
    reviews = spark.createDataFrame([], REVIEW).withColumn("critical_issues", F.lit(0))
    issues = spark.createDataFrame([], "id long, review_id long, category string, severity string, title string, file_path string, line_start int, confidence_score double")
    assert reports.team_report(reviews, repos, issues, "2001-01-01 00:00:00", "2002-01-01 00:00:00").count() == 0
    assert reports.top_issues(issues).count() == client.categories(issues).count() == 0


def test_patch_counts_and_summary(spark) -> None:
    assert tuple(one(spark.range(1).select(*gitstats.patch_counts(F.lit("+a\n+++ b\n-c\n--- d\n-e\n x"))))) == (1, 2)
    df = spark.createDataFrame([(1, DIFF), (2, "")], "diff_id long, diff_text string")
    said = {r["diff_id"]: r["summary"] for r in diffs.summary(df, diffs.files(df)).collect()}
    assert said == {1: "Changed 1 file(s)\n2 additions\n1 deletions\nMost changed files:\n  - app/auth.py: 3 changes", 2: "No changes detected."}


def test_requests_of_one_client_over_many_batches(spark) -> None:
    df = spark.range(30_000).select(F.col("id").alias("request_id"), F.when(F.col("id") % 3 > 0, "busy").alias("client"), (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") / 50)).alias("ts"))
    got: dict = {}
    for r in limiter.limited(df, 100, 60).collect():
        got.setdefault(r["client"], {})[r["request_id"]] = r["accepted"]
    for client_rows in got.values():
        ids = sorted(client_rows)
        assert [client_rows[i] for i in ids] == limiter.decided([i * 20 for i in ids], [], 100, 60_000)[0]
