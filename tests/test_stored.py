"""Keyed tables under failures and repeats; streams that arrive out of order; one-pass diffs and syntax rules."""

from __future__ import annotations

import ast
import random

import pytest
from pyspark.sql import functions as F

from revsight.operators import difflines, diffs, syntax
from revsight.plans import sql_diffs, sql_sources, sql_streams
from revsight.sources.keyed import Conflict, KeyedTable
from revsight.streaming import limiter, progress

ROW = "id long, name string, n int"


def rows_of(df):  # noqa: ANN001, ANN201
    return sorted(tuple(r) for r in df.collect())


def files_of(path):  # noqa: ANN001, ANN201
    return {str(p): (p.stat().st_mtime_ns, p.read_bytes()) for p in path.rglob("*.parquet")}


@pytest.fixture
def table(spark, tmp_path):  # noqa: ANN001, ANN201
    return KeyedTable.create(spark.createDataFrame([(i, f"n{i}", i) for i in range(40)], ROW), f"file://{tmp_path}/t", buckets=8)


def test_ops_of_a_merge(spark, table) -> None:
    changes = [(1, "x", None, "update"), (2, None, 7, "upsert"), (3, None, None, "delete"), (4, "no", 1, "insert"), (50, "new", None, "insert"), (51, None, 5, "upsert"), (52, "no", 1, "update"), (53, None, None, "delete")]
    assert table.merge(spark.createDataFrame(changes, f"{ROW}, _op string"), "w", 0)
    got = {r[0]: r[1:] for r in rows_of(table.read())}
    want = {i: (f"n{i}", i) for i in range(40)} | {1: ("x", 1), 2: ("n2", 7), 50: ("new", None), 51: (None, 5)}
    del want[3]
    assert got == want
    assert rows_of(table.read(0)) == [(i, f"n{i}", i) for i in range(40)]


def test_only_touched_buckets_are_written(spark, table, tmp_path) -> None:
    before = files_of(tmp_path / "t")
    held = table.manifest()["folders"]
    table.merge(spark.createDataFrame([(5, "y", None, "update")], f"{ROW}, _op string"), "w", 0)
    after = files_of(tmp_path / "t")
    assert all(after[p] == before[p] for p in before)
    now = table.manifest()["folders"]
    assert sum(held[b] != now[b] for b in held) == 1
    written = [p for p in after if p not in before]
    assert len({p.rsplit("/", 1)[0] for p in written}) == 1


def test_a_batch_counts_once(spark, table) -> None:
    change = spark.createDataFrame([(5, "y", None, "update"), (60, "z", 1, "insert")], f"{ROW}, _op string")
    assert table.merge(change, "w", 3)
    version, rows = table.manifest()["version"], rows_of(table.read())
    assert not table.merge(change, "w", 3)
    assert not table.merge(change.withColumn("name", F.lit("late")), "w", 2)
    assert (table.manifest()["version"], rows_of(table.read())) == (version, rows)
    assert table.merge(change.withColumn("name", F.lit("other")).where("id = 5"), "v", 0)
    assert dict((r[0], r[1]) for r in rows_of(table.read()))[5] == "other"


@pytest.mark.parametrize("at", ["_write", "_commit"])
def test_a_write_that_dies_leaves_the_old_table(spark, table, monkeypatch, at) -> None:
    before = rows_of(table.read())
    change = spark.createDataFrame([(i, "y", None, "update") for i in range(40)], f"{ROW}, _op string")
    real = KeyedTable._write

    def dies(self, *args):  # noqa: ANN001, ANN002, ANN202
        if at == "_write":
            real(self, *args)  # all files are there, but nothing names them
        raise OSError("killed")

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, at, dies)
        with pytest.raises(OSError, match="killed"):
            table.merge(change, "w", 0)
    assert rows_of(table.read()) == before and table.versions() == [0]
    assert table.merge(change, "w", 0)
    assert {r[1] for r in rows_of(table.read())} == {"y"}
    kept = rows_of(table.read())
    assert table.vacuum() > 0
    assert rows_of(table.read()) == kept and len(table.versions()) == 1


def test_two_writers_of_one_version(spark, table, monkeypatch) -> None:
    change = spark.createDataFrame([(5, "mine", None, "update")], f"{ROW}, _op string")
    other = spark.createDataFrame([(5, "theirs", None, "update")], f"{ROW}, _op string")
    real = KeyedTable._write

    def slow(self, *args):  # noqa: ANN001, ANN002, ANN202
        monkeypatch.setattr(KeyedTable, "_write", real)
        KeyedTable(spark, self.path).merge(other, "v", 0)
        return real(self, *args)

    monkeypatch.setattr(KeyedTable, "_write", slow)
    with pytest.raises(Conflict):
        table.merge(change, "w", 0)
    assert dict((r[0], r[1]) for r in rows_of(table.read()))[5] == "theirs"
    assert table.merge(change, "w", 0)
    with pytest.raises(Conflict):
        KeyedTable.create(other.drop("_op"), table.path)


def test_changes_that_are_refused(spark, table) -> None:
    ddl = f"{ROW}, _op string"
    for bad in ([(None, "x", 1, "update")], [(1, "x", 1, "replace")], [(1, "x", 1, None)], [(1, "x", 1, "update"), (1, "y", 1, "update")]):
        with pytest.raises(ValueError, match="change"):
            table.merge(spark.createDataFrame(bad, ddl), "w", 0)
    twice = spark.createDataFrame([(1, "x", 1, "update", 2), (1, "y", 1, "update", 3), (2, "z", 1, "delete", 9), (2, "z", 1, "update", 1)], f"{ddl}, at int")
    assert table.merge(twice, "w", 0, order="at")
    got = dict((r[0], r[1]) for r in rows_of(table.read()))
    assert got[1] == "y" and 2 not in got


def test_empty_tables_and_batches(spark, tmp_path) -> None:
    empty = KeyedTable.create(spark.createDataFrame([], ROW), f"file://{tmp_path}/e", buckets=4)
    assert empty.read().count() == 0 and empty.read().columns == ["id", "name", "n"]
    assert empty.merge(spark.createDataFrame([], f"{ROW}, _op string"), "w", 0)
    assert empty.merge(spark.createDataFrame([(1, "a", 1, "upsert")], f"{ROW}, _op string"), "w", 1)
    assert empty.merge(spark.createDataFrame([(1, "delete")], "id long, _op string"), "w", 2)
    assert empty.read().count() == 0
    with pytest.raises(FileNotFoundError):
        KeyedTable(spark, f"file://{tmp_path}/none").read()


# ---- streams


def test_limits_of_a_shuffled_stream_with_restarts(spark, tmp_path) -> None:
    rnd = random.Random(3)
    base = [(i, f"c{rnd.randint(0, 3)}", rnd.randint(0, 900)) for i in range(500)] + [(1000, None, 5)]
    df = spark.createDataFrame(base, "request_id long, client string, s int").select("request_id", "client", (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(secs=F.col("s"))).alias("ts"))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def run(folder: str) -> None:
        stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(folder)
        query = limiter.limited_stream(stream, 5, 60, late="200 seconds").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        assert query.awaitTermination(120)

    last = spark.sql("SELECT -1L AS request_id, 'z' AS client, timestamp'2030-01-01 00:00:00' AS ts")
    sql_streams.landed(df, 3, run, last, late_s=100)
    want = limiter.limited(df.withColumn("ts", F.col("ts").cast("timestamp_ntz")), 5, 60)
    got = spark.read.parquet(out)
    assert rows_of(got.select("request_id", "accepted")) == rows_of(want.select("request_id", "accepted"))
    assert got.where("NOT accepted").count() > 100


def test_limits_across_ranges_of_time(spark, monkeypatch) -> None:
    monkeypatch.setattr(limiter, "RANGE", 2)
    rnd = random.Random(12)
    rows = [(i, rnd.choice(["a", "b", None]), round(rnd.choice([rnd.uniform(0, 400), rnd.uniform(3000, 3100)]), 1)) for i in range(400)] + [(900 + i, "c", 60.0 * i) for i in range(9)] + [(950 + i, "d", 59.9 * i) for i in range(9)]
    df = spark.createDataFrame(rows, "request_id long, client string, s double").select("request_id", "client", (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("s"))).alias("ts"))
    want = {}
    for client in ("a", "b", None, "c", "d"):
        own = sorted((round(s * 1_000_000), i) for i, c, s in rows if c == client)
        want |= dict(zip([i for _, i in own], limiter.decided([t for t, _ in own], [], 5, 60_000_000)[0]))
    assert {r["request_id"]: r["accepted"] for r in limiter.limited(df, 5, 60).collect()} == want
    cut = {(r["client"], r["stretch"]) for r in limiter.stretches(df, 60).where("client IN ('c', 'd')").collect()}
    assert cut == {("c", i) for i in range(1, 10)} | {("d", 1)}
    assert limiter.limited(df.limit(0)).count() == 0


def plain_states(reports, as_of: int, timeout: int):  # noqa: ANN001, ANN201
    percent_of = {"starting": 0, "cloning": 10, "scoring": 80, "saving": 90, "finished": 100, "failed": 0}
    out = {}
    for task in {r[0] for r in reports}:
        rows = []
        for _, s, stage, done, total in (r for r in reports if r[0] == task):
            p = percent_of[stage] if stage in percent_of else min(80, 20 + done * 60 // max(total, 1))
            rows.append((s, {"failed": 101, "finished": 102}.get(stage, p), p, stage))
        state, last = None, None
        for s, _, p, stage in sorted(rows):
            if state and state[2] != "in_progress":
                break
            if state and s - last > timeout:
                break
            last = s
            if stage in ("failed", "finished"):
                state = (max(state[0] if state else 0, p), stage, "failed" if stage == "failed" else "completed", s, "reported" if stage == "failed" else None)
            elif state is None or p > state[0]:
                state = (p, stage, "in_progress", s, None)
        if state[2] == "in_progress" and as_of - last > timeout:
            state = (state[0], "failed", "failed", last + timeout, "timeout")
        out[task] = state
    return out


def test_task_states(spark, tmp_path) -> None:
    rnd = random.Random(5)
    stages = ["starting", "cloning", "analysing", "analysing", "scoring", "saving", "finished", "failed"]
    reports = [(t, rnd.randint(0, 4000), rnd.choice(stages[: rnd.randint(1, 8)]), rnd.randint(0, 9), rnd.choice([0, 5, 8])) for t in range(60) for _ in range(rnd.randint(1, 8))]
    reports += rnd.choices(reports, k=40)
    epoch = 1_704_067_200
    df = spark.createDataFrame(reports, "task_id long, s long, stage string, done long, total long").withColumn("ts", F.timestamp_seconds(F.col("s") + epoch)).drop("s")
    odd = spark.createDataFrame([(None, "starting"), (900, "dancing")], "task_id long, stage string").select("task_id", F.timestamp_seconds(F.lit(epoch)).alias("ts"), "stage", F.lit(None).cast("long").alias("done"), F.lit(None).cast("long").alias("total"))
    df = df.unionByName(odd)
    shown = lambda d: {r["task_id"]: tuple(r)[1:] for r in d.select("task_id", "percent", "stage", "status", (F.unix_seconds("updated_at") - epoch).alias("s"), "error").collect()}
    want = plain_states(reports, 1_000_000, 900)
    assert shown(progress.task_states(df, "2024-06-01 00:00:00", 900)) == want
    assert {v[4] for v in want.values()} == {None, "timeout", "reported"}
    early = shown(progress.task_states(df, "2024-01-01 00:10:00", 900))
    assert early == plain_states([r for r in reports if r[1] <= 600], 600, 900)
    assert progress.task_states(df.limit(0), "2024-06-01 00:00:00").count() == 0

    table = KeyedTable.create(spark.createDataFrame([], "task_id long, percent long, stage string, status string, updated_at timestamp, error string"), f"file://{tmp_path}/tasks", key="task_id", buckets=4)

    def run(folder: str) -> None:
        stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(folder)
        moves = progress.as_changes(progress.task_stream(stream, 900, "10 minutes"))
        query = moves.writeStream.foreachBatch(table.sink("tasks", order="_order")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)

    # every report twice, so that repeats come late as well
    last = spark.sql("SELECT -1L AS task_id, 'starting' AS stage, 0L AS done, 1L AS total, timestamp'2024-06-01 00:00:00' AS ts").select(*df.columns)
    sql_streams.landed(df.unionByName(df), 2, run, last, late_s=300)
    assert shown(table.read()) == want


# ---- diffs and syntax


def test_diff_operators_shuffle_nothing(spark) -> None:
    df = spark.createDataFrame([(1, "x")], "diff_id long, diff_text string")
    for made in (diffs.files(df), diffs.lines(df), diffs.hunks(df), diffs.changes(df), diffs.changed_functions(df), diffs.risks(diffs.files(df))):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan and "Join" not in plan


def plain_changes(text: str) -> list[tuple]:
    out, file, hunk, good = [], 0, 0, None
    for line in text.split("\n"):
        if line.startswith("diff --git a/") and " b/" in line:
            file, hunk, good = file + 1, 0, None
        elif file and line.startswith("@@"):
            hunk, good = hunk + 1, None
            m = __import__("re").match(diffs.HUNK, line)
            if m:
                good = {"old": int(m[1]), "new": int(m[3]), "added": 0, "removed": 0, "context": 0, "o": 0, "n": 0}
        elif good:
            kind = "added" if line.startswith("+") and not line.startswith("+++") else "removed" if line.startswith("-") and not line.startswith("---") else "context" if line.startswith(" ") else None
            if kind:
                start, place = (good["new"], good["n"]) if kind == "added" else (good["old"], good["o"])
                out.append((file, hunk, kind, start + good[kind], start + place, line[1:]))
                good[kind] += 1
                good["n"] += kind != "removed"
                good["o"] += kind != "added"
    return out


def test_changes_like_a_plain_reader(spark) -> None:
    rnd = random.Random(8)
    parts = ["diff --git a/x b/x", "@@ -1,2 +3 @@ f", "@@ -7 +9,9 @@", "@@ bad @@", "+a", "-b", " c", "+++ d", "--- e", "\\ No newline", "", "+", "-", "index 12..34"]
    texts = ["\n".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) + rnd.choice(["", "\n"]) for _ in range(150)] + ["", "+a\n-b", "\n".join(["diff --git a/y b/y", "@@ -1 +1 @@"] + ["+x", " y"] * 20_000)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "diff_id long, diff_text string")
    got: dict[int, list] = {}
    for r in diffs.changes(df).collect():
        got.setdefault(r["diff_id"], []).append((r["file"], r["hunk"], r["kind"], r["line_number"], r["true_line"], r["content"]))
    assert {k: sorted(v) for k, v in got.items()} == {i: sorted(w) for i, t in enumerate(texts) if (w := plain_changes(t))}


def test_changes_that_hold_a_text_keep_their_numbers(spark, monkeypatch) -> None:
    monkeypatch.setattr(difflines, "PART", 40)
    rnd = random.Random(9)
    parts = ["diff --git a/x b/x", "diff --git none", "@@ -1,2 +3 @@ f", "@@ -7 +9,9 @@", "@@ bad", "+def é(", "-  def b(", " def", "+++ d", "- x", "\\ No newline", "+"]
    texts = ["\n".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) + rnd.choice(["", "\n"]) for _ in range(80)] + [""]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "diff_id long, diff_text string").coalesce(1)
    got = sorted((r["diff_id"], r["file"], r["hunk"], r["kind"], r["line_number"], r["true_line"], r["content"]) for r in diffs.changes(df, ("def",)).collect())
    assert got == sorted((i, *r) for i, t in enumerate(texts) for r in plain_changes(t) if "def" in r[-1])
    # a change is handed on by its number, not gathered into lists that hold every line of a hunk
    assert "explode" not in diffs.changed_functions(df)._jdf.queryExecution().executedPlan().toString().lower()


def test_slim_files_and_summaries_like_the_whole_ones(spark, monkeypatch) -> None:
    monkeypatch.setattr(difflines, "PART", 150)
    rnd = random.Random(11)
    parts = ["diff --git a/x b/config.py", "diff --git a/y b/\u00e9 b/Auth\u00fc", "diff --git a/z\r b/z", "diff --git a/SQL b/s.SQL", "diff --git none", "new file mode 100644", "deleted file mode 1", "new filed", "+deleted file mode", "x Binary files a and b differ", "Binary files", "differ"]
    parts += ["@@ -1,2 +3 @@ f", "@@ -7 +9,9 @@", "@@ bad", "@@", "@@ -1 +1 @@\r", *["+a", "-b", " c"] * 4, "+++ d", "--- e", "++", "--", "++-", "+", "-", "", "\u00e9"]
    texts = ["\n".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) + rnd.choice(["", "\n"]) for _ in range(300)] + ["", "\n", "+", "++", "diff --git a/x b/x\n@@ -1 +1 @@\n+", "++", "diff --git a/x b/x\n@@ -1 +1 @@\n-", "--x", "Binary fi", "les differ"]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "diff_id long, diff_text string").coalesce(1)
    whole, slim = diffs.files(df), diffs.slim_files(df)
    assert sorted(map(tuple, slim.collect()), key=str) == sorted(map(tuple, whole.select(*slim.columns).collect()), key=str)
    assert sorted(map(tuple, diffs.risks(slim).collect()), key=str) == sorted(map(tuple, diffs.risks(whole).collect()), key=str)
    assert {(r["type"], r["pattern"]) for r in diffs.risks(slim).collect()} >= {("critical_file", ".*config.*"), ("critical_file", ".*auth.*"), ("critical_file", r".*\.sql"), ("binary_change", None), ("new_file", None), ("file_deletion", None)}
    assert sorted(map(tuple, diffs.summaries(df).collect())) == sorted(map(tuple, diffs.summary(df, whole).collect()))
    # a file's first ten lines stay where they are read, and a summary needs no other row
    assert "head" not in slim.columns and "array" not in slim._jdf.queryExecution().executedPlan().toString()
    assert not any(x in diffs.summaries(df)._jdf.queryExecution().executedPlan().toString() for x in ("Exchange", "Window", "Join"))


def test_sums_and_kinds_of_lines_like_a_plain_reader(spark, monkeypatch) -> None:
    """Only sums leave a batch, and a hunk's text only where asked for."""
    monkeypatch.setattr(difflines, "PART", 200)
    monkeypatch.setattr(difflines, "_SHORT", 2)
    rnd = random.Random(10)
    parts = ["diff --git a/x b/x", "@@ -1,2 +3 @@ f", "@@ -3 +3 @@", "@@ bad", "+def f(a):", "-def f(a):", "-  def f(a):", "+\t \x0b function g", "-    class A:", "+import x", "- from y", "+#include <a>", "+ # c", "-/* d", "+//", " def z", "+", "-     ", "+de", "+def", "+function", "+functio\u00e9 ", "+require('x')", "- *"]
    texts = ["\n".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) + rnd.choice(["", "\n"]) for _ in range(120)] + ["", "diff --git a/x b/x\n@@ -1 +1 @@\n+" + " " * 100 + "de", "f g("]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "diff_id long, diff_text string").coalesce(1)
    sums, kinds = {}, {}
    for i, t in enumerate(texts):
        rows = plain_changes(t)
        came = {(f, h, n, c) for f, h, k, n, _, c in rows if k == "added"}
        for f, h, k, n, place, c in rows:
            own = sums.setdefault((i, f, k), [0, 0, 0])
            own[:] = own[0] + 1, own[1] + n, own[2] + place
            if k != "context":
                x, out = c.lstrip(" \t\x0b\f\r"), kinds.setdefault((i, f), [0, 0, 0, 0])
                defines = x.startswith(("def ", "function ", "class "))
                as_added = k == "added" or (f, h, n, c) in came
                for at, told in enumerate((x.startswith(("import ", "from ", "#include", "require(")), defines and as_added, defines and not as_added, x.startswith(("#", "//", "/*", "*")) and not x.startswith("#include"))):
                    out[at] += told
    made = diffs.change_sums(df)
    assert {(r["diff_id"], r["file"], r["kind"]): [r["n"], r["numbers"], r["true_lines"]] for r in made.collect()} == sums
    assert "content" not in made._jdf.queryExecution().executedPlan().toString()
    got = {(r["diff_id"], r["file"]): [r[c] for c in ("import_changes", "function_additions", "function_deletions", "comment_changes")] for r in diffs.files(df, counted=True).collect()}
    assert {k: v for k, v in got.items() if any(v)} == {k: v for k, v in kinds.items() if any(v)}
    assert sum(v[1] for v in kinds.values()) and sum(v[2] for v in kinds.values())
    whole, slim = diffs.hunks(df), diffs.hunks(df, text=False)
    assert sorted(map(str, slim.collect())) == sorted(map(str, whole.drop("text").collect()))
    assert "text" not in {f.name for f in difflines.hunk_rows(df, text=False).schema}


def test_texts_of_diffs_are_not_gathered(spark, sf) -> None:
    for made in (sql_diffs.varied_diffs(spark, sf), sql_sources.change_diffs(spark, sf)):
        lists = [x for x in made._jdf.queryExecution().optimizedPlan().toString().split("\n") if "collect_list(" in x]
        assert lists and all("repeat(" not in x.split("collect_list(")[1].split(")")[0] for x in lists)


def test_syntax_rules_take_one_parse_and_no_join(spark) -> None:
    tree = syntax.nodes(spark.createDataFrame([("a.py", "x = 1\n")], "path string, content string"))
    for made in (syntax.issues(tree, helpers=True, nesting=True), syntax.definitions(tree), syntax.deep_nesting(tree)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Exchange" not in plan and "Join" not in plan


def test_a_worker_holds_few_nodes(spark) -> None:
    assert syntax.BATCH * len(syntax._FIELDS) <= 1 << 18
    df = spark.range(4_000).coalesce(1).select("id", F.lit("a.py").alias("path"), F.lit("x = 1\n").alias("content"))
    assert syntax.nodes(df).where("kind = 'Constant'").select("id").distinct().count() == 4_000


def test_files_that_are_hard_to_hold(spark) -> None:
    texts = ["x = '\\ud800 %s' % 1\n", "y = 0x" + "f" * 9000 + "\n", "(" * 150 + ")" * 150, "def f():\n  '''\\udfff'''\n", "\x00", "z = 1\n" * 30_000, "", None]
    df = spark.createDataFrame([(i, "a.py", t) for i, t in enumerate(texts)], "n int, path string, content string").repartition(2)
    found = {(r["n"], r["rule_id"]) for r in syntax.issues(syntax.nodes(df), ["n"]).collect()}
    assert {(0, "old_string_format"), (1, "magic_number"), (4, "syntax_error")} <= found
    assert syntax.nodes(df).where("n = 5 AND kind = 'Assign'").count() == 30_000
    assert [(r["n"], r["kind"]) for r in syntax.definitions(syntax.nodes(df.where("n = 4")), ["n"]).collect()] == [(4, "error")]


def test_functions_with_their_context(spark) -> None:
    notes = ["int", "'X'", "a.b.C", "list[int]", "dict[str, list[a.b]]", "int | None", "Callable[[int, str], None]", "tuple[int, ...]", "tuple[()]", "Literal['a', \"b\", -1]", "x[1:2, ::3]", "f(1, *a, k=2, **d)", "lambda x: x", "(yield)", "[i for i in j]", "{1: 2}", "{*a}", "x if y else z", "not a and b or c", "a < b <= c", "-x ** 2", "f'{x!r:>{w}}'", "b'x'", "(a := 1)", "await_", "..."]
    texts = [f"@d\ndef f{i}(a, /, b: int = 1, *c, k, **d) -> {n}:\n    def g(self): return 1\n    if a and b and c:\n        assert a\n    return f\r\n" for i, n in enumerate(notes)]
    df = spark.createDataFrame([(i, "a.py", t) for i, t in enumerate(texts)] + [(90, "a.js", "function f() {"), (91, "b.py", "def (")], "n int, path string, content string")
    got = {(r["n"], r["name"]): r for r in syntax.bodies(df).collect()}
    assert len(got) == 2 * len(texts)
    for i, text in enumerate(texts):
        node = ast.parse(text).body[0]
        r = got[i, f"f{i}"]
        assert r["returns"] == ast.unparse(node.returns)
        assert (r["line_start"], r["line_end"], r["args"], r["docstring"], r["complexity"]) == (2, 6, ["b"], None, 3 + sum(isinstance(x, (ast.BoolOp, ast.comprehension)) for x in ast.walk(node.returns)))
        assert r["body"] == "\n".join(text.splitlines()[1:6])
        assert got[i, "g"]["args"] == ["self"] and got[i, "g"]["returns"] is None
