"""Changing trees, duplicate code, paged sources, names."""

from __future__ import annotations

import ast
import json
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from revsight.operators import accounts, clones, listing, relations, scan
from revsight.sources import paged, readers, snapshots, updates

FILE = "path string, content string"


# ---- snapshots


def test_findings_after_deltas_equal_those_from_scratch(spark) -> None:
    rnd = random.Random(4)
    texts = ['password = "abcdefgh1"\n', "eval(x)\n", "x = 1\n", "debug = True\n", ""]
    names = [f"{d}{i}{e}" for i in range(12) for d in ("src/", "test/") for e in (".py", ".js", ".txt")]
    tree = {n: rnd.choice(texts) + rnd.choice(["", "\n"]) for n in rnd.sample(names, 30)}
    read: list[int] = []

    def analyse(files):  # noqa: ANN001, ANN202
        read.append(files.count())
        return scan.pattern_issues(files).unionByName(scan.context_issues(files)).select("path", "rule_id", "line_start")

    shown = lambda df: sorted(map(tuple, df.select("path", "rule_id", "line_start").collect()))
    frame = lambda t: spark.createDataFrame(list(t.items()), FILE)
    found = analyse(frame(tree)).cache()
    for _ in range(3):
        read.clear()
        later = dict(tree)
        for n in rnd.sample(sorted(later), 4):
            later[n] = rnd.choice(texts) + "z = 2\n"
        for n in rnd.sample(sorted(later), 5):
            del later[n]
        free = [n for n in names if n not in tree]
        for n in rnd.sample(sorted(later), 5):  # renamed, to another kind of file at times
            later[free.pop(rnd.randrange(len(free)))] = later.pop(n)
        changes = snapshots.difference(snapshots.snapshot(frame(tree)), snapshots.snapshot(frame(later))).cache()
        found = snapshots.rescanned(found, changes, frame(later), analyse).cache()
        again = read.pop()
        assert shown(found) == shown(analyse(frame(later)))
        told = {r["path"]: r["change"] for r in changes.collect()}
        same = {n for n in later if tree.get(n) == later[n]}
        assert {n for n, c in told.items() if c == "same"} == same
        assert set(told) == set(tree) | set(later)
        renamed = [r for r in changes.collect() if r["change"] == "renamed"]
        assert all(tree[r["from_path"]] == later[r["path"]] and r["from_path"] not in later and r["path"] not in tree for r in renamed)
        assert len({r["from_path"] for r in renamed}) == len(renamed) == sum(c == "moved" for c in told.values())
        assert again <= len(later) - len(same) and renamed
        tree = later


def test_differences_of_empty_and_repeated(spark) -> None:
    none = spark.createDataFrame([], FILE)
    some = spark.createDataFrame([("a", None), ("b", ""), ("c", "x")], FILE)
    shot = snapshots.snapshot
    assert snapshots.difference(shot(none), shot(none)).count() == 0
    assert {r["change"] for r in snapshots.difference(shot(none), shot(some)).collect()} == {"added"}
    moved = spark.createDataFrame([("d", ""), ("e", ""), ("f", "")], FILE)
    got = {r["path"]: (r["change"], r["from_path"]) for r in snapshots.difference(shot(some), shot(moved)).collect()}
    assert got == {"a": ("moved", None), "b": ("moved", None), "c": ("removed", None), "d": ("renamed", "a"), "e": ("renamed", "b"), "f": ("added", None)}


# ---- clones


def plain_shape(node: ast.AST) -> tuple:
    skipped = (ast.expr_context, ast.operator, ast.boolop, ast.unaryop, ast.cmpop)
    op = ",".join(type(o).__name__ for o in node.ops) if isinstance(node, ast.Compare) else type(node.op).__name__ if hasattr(node, "op") else type(node.ctx).__name__ if isinstance(node, ast.Name) else None
    if isinstance(node, ast.ExceptHandler):
        op = "bare" if node.type is None else "typed"
    value = type(node.value).__name__ if isinstance(node, ast.Constant) else None
    below = [(f, plain_shape(c)) for f, v in ast.iter_fields(node) for c in (v if isinstance(v, list) else [v]) if isinstance(c, ast.AST) and not isinstance(c, skipped)]
    return (type(node).__name__, op, value, tuple(below))


def test_clones_against_all_pairs_of_subtrees(spark) -> None:
    one = "def {0}(a, b):\n    if a > b:\n        {0} = [a * {1}, b.c(a)]\n    return {0}\n"
    texts = [one.format("f", 1), "x = 5\n" + one.format("g", 2) + one.format("h", 3), one.format("k", "'s'"), "class C:\n" + "".join("    " + line + "\n" for line in one.format("m", 4).splitlines()), "y = [a * 1, b.c(a)]\n" * 3, "def (", ""]
    least = 8
    spots = []  # file, node, shape, size, parent's shape
    for i, t in enumerate(texts):
        try:
            tree = ast.parse(t)
        except SyntaxError:
            continue
        above = {id(c): n for n in ast.walk(tree) for c in ast.iter_child_nodes(n)}
        size = lambda s: 1 + sum(map(size, [c for _, c in s[3]]))
        for n in ast.walk(tree):
            s = plain_shape(n)
            if size(s) >= least and not isinstance(n, ast.Module) and hasattr(n, "lineno"):
                spots.append((i, n, s, size(s), above.get(id(n))))
    twins: dict[int, set[int]] = {k: {k} for k in range(len(spots))}
    for a, b in combinations(range(len(spots)), 2):
        if spots[a][2] == spots[b][2]:
            twins[a].add(b)
            twins[b].add(a)
    again = {id(spots[k][1]) for k in twins if len(twins[k]) > 1}
    want = sorted((i, type(n).__name__, n.lineno, n.end_lineno, size_, len(twins[k])) for k, (i, n, _, size_, up) in enumerate(spots) if id(n) in again and id(up) not in again)
    df = spark.createDataFrame([(i, f"{i}.py", t) for i, t in enumerate(texts)], "n int, path string, content string")
    got = sorted((r["n"], r["kind"], r["line_start"], r["line_end"], r["nodes"], r["copies"]) for r in clones.clones(df, least).collect())
    assert got == want and len(want) >= 6
    assert clones.clones(df.limit(0)).count() == 0


# ---- paged source


class Counted(paged.Landed):
    """Writes down every page that is asked for."""

    def page(self, account: str, number: int) -> list[dict]:
        with (self.root.parent / "asked.txt").open("a") as f:
            f.write(f"{account}/{number}\n")
        return super().page(account, number)


def land(root, account, counts, start=0) -> None:  # noqa: ANN001
    folder = root / account
    folder.mkdir(parents=True, exist_ok=True)
    for page, n in counts.items():
        (folder / f"{page}.json").write_text(json.dumps([{"id": page * 1000 + i, "name": f"{account}{i}", "size": i, "private": i % 2 == 0} for i in range(start, n)]))


@pytest.fixture
def landed(spark, tmp_path, monkeypatch):  # noqa: ANN001, ANN201
    root = tmp_path / "pages"
    land(root, "ann", {1: 4, 2: 4, 3: 2, 4: 4})  # a page after a short one is no page
    land(root, "bob", {1: 4, 2: 4})
    land(root, "cid", {})
    paged.register(spark)
    asked = tmp_path / "asked.txt"

    def pages() -> list[str]:
        out = sorted(asked.read_text().split()) if asked.exists() else []
        asked.unlink(missing_ok=True)
        return out

    return root, pages


def source(spark, root):  # noqa: ANN001, ANN201
    return spark.read.format("provider_pages").option("root", str(root)).option("client", "tests.test_trees:Counted").option("per_page", "4").load()


def test_pages_are_read_once_up_to_a_short_one(spark, landed) -> None:
    root, asked = landed
    got = source(spark, root).collect()
    assert {(a, p): sum(r["account"] == a and r["page"] == p for r in got) for a, p in {(r["account"], r["page"]) for r in got}} == {("ann", 1): 4, ("ann", 2): 4, ("ann", 3): 2, ("bob", 1): 4, ("bob", 2): 4}
    assert asked() == ["ann/1", "ann/2", "ann/3", "bob/1", "bob/2", "bob/3", "cid/1"]
    # the same records as those of landed pages, whose full page holds a hundred
    files = root.parent / "one"
    files.mkdir()
    land(root, "dan", {1: 100, 2: 30, 3: 100})
    for k in (1, 2, 3):
        (files / f"{k}.json").write_text(json.dumps({"page": k, "items": json.loads((root / "dan" / f"{k}.json").read_text())}) + "\n")
    live = spark.read.format("provider_pages").option("root", str(root)).load().where("account = 'dan'").drop("account")
    want = readers.pages(spark, str(files))
    assert sorted(map(str, live.select(*want.columns).collect())) == sorted(map(str, want.collect())) and want.count() == 130


def test_filters_reach_the_client(spark, landed) -> None:
    root, asked = landed
    df = source(spark, root)
    assert df.where("account = 'ann' AND size < 2").count() == 6
    assert asked() == ["ann/1", "ann/2", "ann/3"]
    assert df.where("account IN ('bob', 'nobody') AND page = 1").select("id").count() == 4
    assert asked() == ["bob/1"]


def test_stream_of_pages_goes_on_from_its_offset(spark, landed, tmp_path) -> None:
    root, asked = landed
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def run() -> None:
        stream = spark.readStream.format("provider_pages").option("root", str(root)).option("client", "tests.test_trees:Counted").option("per_page", "4").load()
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(once=True).start()
        assert q.awaitTermination(120)

    run()
    first = spark.read.parquet(out)
    assert first.count() == 18
    land(root, "ann", {3: 4, 4: 1})  # page 3 has grown to a full one
    land(root, "cid", {1: 3})
    run()
    got = spark.read.parquet(out)
    assert got.count() == 18 + 2 + 1 + 3
    assert got.select("account", "id").distinct().count() == got.count()


# ---- names and look-ups


def test_names_of_many_requests(spark) -> None:
    wanted = spark.range(10_050).select("id", F.lit("ann").alias("username")).unionByName(spark.createDataFrame([(20_000 + i, "ann1") for i in range(30)], "id long, username string"))
    taken = spark.createDataFrame([("ann",), ("ann5",), ("ann12",)], "username string")
    got = {r["id"]: r["username"] for r in updates.unique_usernames(wanted, taken).collect()}
    assert len(got) == 10_080 == len(set(got.values())) and not {"ann", "ann5", "ann12"} & set(got.values())
    assert got[0] == "ann1" and got[3] == "ann4" and got[4] == "ann6"
    coded = [n for n in got.values() if n.startswith("ann_")]
    assert len(coded) >= 10_050 - 9_998 and all(len(n) == 12 for n in coded)


def test_names_past_the_largest_number(spark) -> None:
    wanted = spark.range(10_050).select("id", F.lit("ann").alias("username"))
    taken = spark.createDataFrame([("ann",), ("ann5",), ("ann6",), ("ann10001",)], "username string")
    got = [r["username"] for r in updates.unique_usernames(wanted, taken, most=None).orderBy("id").collect()]
    assert got == [f"ann{n}" for n in range(1, 10_054) if n not in (5, 6, 10_001)]


def test_names_in_the_order_of_a_locale(spark) -> None:
    names = ["Zoe", "ähnlich", "Ahorn", "ahorn", "école", "Ecole", "eclair", "_x", "a b", "ab", None]
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string").withColumn("last_analysis", F.lit(None).cast("timestamp")).withColumn("created_at", F.lit(1))
    got = [r["name"] for r in listing.client_repositories(df, by="name").collect()]
    assert got == [None, "_x", "a b", "ab", "ähnlich", "ahorn", "Ahorn", "eclair", "Ecole", "école", "Zoe"]
    # pages by key meet every row once
    seen, name, last = [], "_x", 7
    while page := listing.repositories_after(df, name, last, 3).select("id", "name").collect():
        seen += [r["name"] for r in page]
        last, name = page[-1]
    assert seen == got[2:]
    # a locale of its own puts its letters elsewhere
    swedish = [r["name"] for r in listing.client_repositories(df.where("name IN ('Zoe', 'ähnlich', 'ab')"), by="name", locale="sv").collect()]
    assert swedish == ["ab", "Zoe", "ähnlich"]
    assert [r["name"] for r in listing.client_search(df.withColumn("description", F.when(F.col("id") == 0, "An École")), "ÉCOLE").orderBy("id").collect()] == ["Zoe", "école"]


def test_numbered_lines(spark) -> None:
    df = spark.createDataFrame([("a", "x\n\ny"), ("b", ""), ("c", None)], FILE)
    assert sorted(map(tuple, relations.numbered_lines(df).collect())) == [("a", 1, "x"), ("a", 2, ""), ("a", 3, "y"), ("b", 1, "")]


def test_sign_ins_and_addresses(spark) -> None:
    users = spark.createDataFrame([(1, "a@x.org", "ann", True), (2, "b@x.org", "a@x.org", True), (3, "c@x.org", "cid", False), (4, None, None, True), (5, "e@x.org", "eve", None)], "id long, email string, username string, is_active boolean")
    logins = spark.createDataFrame(list(enumerate(["A@X.org", "ann", "a@x.org", "CID", "cid", None, "", "eve"])), "attempt long, name string")
    got = {r["attempt"]: (r["user_id"], r["outcome"]) for r in accounts.sign_ins(users, logins).collect()}
    # an address that is also someone's name is the address
    assert got == {0: (1, "found"), 1: (1, "found"), 2: (1, "found"), 3: (None, "unknown"), 4: (None, "inactive"), 5: (None, "unknown"), 6: (None, "unknown"), 7: (None, "inactive")}
    assert accounts.sign_ins(users.limit(0), logins).where("outcome = 'unknown'").count() == 8

    urls = ["https://github.com/o/r.git", "https://github.com/o/r/", "https://github.com/o", "https://bitbucket.org/w/r/src", "https://git.gitlab.io/a/b/c.git/", "ssh://x@gitlab.com/a", "https://example.org/a/b", "", None]
    found = [r["p"] for r in spark.createDataFrame(list(enumerate(urls)), "n int, u string").orderBy("n").select(accounts.project_of("u").alias("p")).collect()]
    assert [p and tuple(p) for p in found] == [("github", "o", "r", "o/r"), ("github", "o", "r", "o/r"), None, ("bitbucket", "w", "r", "w/r"), ("gitlab", None, None, "a%2Fb%2Fc"), ("gitlab", None, None, "a"), None, None, None]
