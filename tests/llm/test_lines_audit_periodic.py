"""Line dedup, filter audit and run detection against plain versions, and their edges."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from revsight.llm import audit, lines, periodic

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ENDS = " \t\n\x0b\f\r"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOC = "doc_id long, text string, lang string"


def docs(spark, rows):  # noqa: ANN001, ANN201
    return spark.createDataFrame(rows, DOC)


# ---- 12 lines


def plain_lines(texts: list[str | None], least: int) -> list[tuple[int, int, str]]:
    split = [(t or "").split("\n") for t in texts]
    key = lambda x: x.strip(ENDS).translate(UPPER)
    held = Counter(k for own in split for k in {key(x) for x in own})
    out = []
    for own in split:
        kept = [x for x in own if not key(x) or held[key(x)] < least]
        out.append((len(own), len(own) - len(kept), "\n".join(kept)))
    return out


def line_rows(df):  # noqa: ANN001, ANN201
    return sorted((r["line_counts"]["n_lines"], r["line_counts"]["n_dropped"], r["text"]) for r in df.collect())


ODD_LINES = ["  Ab \nx", "aB\n\ny\x0b", None, "", "\n\n", "ÄB\nİ\nΣΑΣ\nǅ x", "äb\nAB", "ab", "ab\nab\nab", "\x0b\x0cAB\r", " AB", "é" * 50_000 + "\nab", "x" * 200_000]


@pytest.mark.parametrize("least", [1, 2, 3, 100])
def test_lines_against_a_plain_version(spark, least):  # noqa: ANN001
    df = docs(spark, [(i // 2, t, "en") for i, t in enumerate(ODD_LINES)])
    assert line_rows(lines.without_common_lines(df, least_docs=least)) == sorted(plain_lines(ODD_LINES, least))


def test_lines_by_shuffle_equal_lines_by_broadcast(spark, monkeypatch):  # noqa: ANN001
    rnd = random.Random(3)
    texts = ["\n".join(rnd.choice(["a", " B", "c ", "", f"u{rnd.random()}"]) for _ in range(rnd.randint(0, 9))) for _ in range(200)]
    df = docs(spark, [(i, t, "en") for i, t in enumerate(texts)])
    monkeypatch.setattr(lines, "BROADCAST_ROWS", 0)
    assert line_rows(lines.without_common_lines(df)) == sorted(plain_lines(texts, lines.LEAST_DOCS))


def test_lines_edges(spark):  # noqa: ANN001
    empty = lines.report(docs(spark, []))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    # ten copies of one text under one id, nulls included, are ten documents
    many = docs(spark, [(1, "only", "en")] * 10 + [(None, "Only ", None)] * 3 + [(2, None, "en")] * 12)
    got = Counter(tuple(r) for r in lines.report(many).collect())
    none = hashlib.sha256(b"").hexdigest()
    assert got == Counter({(1, 1, 1, none): 10, (None, 1, 1, none): 3, (2, 1, 0, none): 12})
    clash = docs(spark, [(1, "a\nb", "en")]).select("*", *[F.lit(9).alias(c) for c in ("line_mark", "LINE_OWN", "line_parts", "line_at", "x", "y", "at", "k")])
    out = lines.without_common_lines(clash, least_docs=1)
    assert out.columns == [*clash.columns, "line_counts"] and out.first()["text"] == "" and out.first()["x"] == 9


def test_line_keys_change_only_ascii(spark):  # noqa: ANN001
    # every code point that some change of case may touch
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and (chr(c).lower() != chr(c) or chr(c).upper() != chr(c) or chr(c).isalpha())]
    rows = [("x" + "Q".join(points[i : i + 7]),) for i in range(0, len(points), 7)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select("t", lines.ascii_lower(F.col("t")).alias("k")).collect()
    assert all(r["k"] == r["t"].translate(UPPER) for r in got)


# ---- 11 audit


def plain_audit(rows, labels):  # noqa: ANN001, ANN201
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    least: dict[str, int] = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    facts = []
    for i, t, part in rows:
        t = t or ""
        w = SPACE.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]}
        facts.append((part or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part in {f[0] for f in facts}:
        own = [f for f in facts if f[0] == part]
        total = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                total[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone), f]
        for key, row in out.items():
            if key[0] == part:
                row[6] = total[row[6]]
    return out


def audited(spark, rows, labels):  # noqa: ANN001, ANN201
    df = audit.report(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = df.collect()
    out = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in names] for r in got}
    assert len(out) == len(got)
    return out


def test_audit_against_a_plain_version(spark, monkeypatch):  # noqa: ANN001
    rnd = random.Random(5)
    base = [" ".join(rnd.choice(["w%d" % rnd.randint(0, 400), "The", "x"]) for _ in range(rnd.choice([5, 199, 200, 300]))) for _ in range(40)]
    texts = [rnd.choice(base) + rnd.choice(["", "", " #", " ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 3]) for _ in range(150)] + [None, "", " \t", "é" * 30_000]
    rows = [(rnd.choice([i, i, i // 2, None]), t, rnd.choice(["en", "de", None, ""])) for i, t in enumerate(texts)] + [(3, "same", "fr")] * 3
    labels = [(rnd.randint(0, 160), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for _ in range(120)] + [(None, 1, 1), (9999, 1, 1)]
    want = plain_audit(rows, labels)
    assert audited(spark, rows, labels) == want
    monkeypatch.setattr(audit, "BROADCAST_ROWS", 0)
    assert audited(spark, rows, labels) == want


def test_audit_edges(spark):  # noqa: ANN001
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.report(docs(spark, []), labels).count() == 0
    clean = " ".join(f"w{i}" for i in range(200))
    assert {tuple(v) for v in audited(spark, [(1, clean, None)], [(1, 1, 1)]).values()} == {(1, 0, 0, 0, 0, 0, 0)}
    clash = docs(spark, [(1, clean, "en"), (2, clean, "en")]).select("*", *[F.lit(0).alias(c) for c in ("row", "part", "digest", "A", "t", "w", "done", "good", "filter")])
    out = audit.report(clash, labels)
    assert out.count() == 600 and out.where("substr(filter_order, step, 1) = 'E' AND removed = 1 AND shapley = 120").count() == 120


def test_audit_of_other_filters(spark):  # noqa: ANN001
    rows = spark.createDataFrame([(i, "p", i % 2, 0) for i in range(10)], "row long, part string, good int, toxic int")
    failing = {"X": rows.where("row < 4").select("row"), "Y": rows.where("row BETWEEN 2 AND 5").select("row")}
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["shapley"]) for r in audit.audit(rows, failing).collect()}
    assert got == {("XY", 1): (6, 4, 0, 2, 2, 6), ("XY", 2): (4, 2, 2, 2, 1, 6), ("YX", 1): (6, 4, 0, 2, 2, 6), ("YX", 2): (4, 2, 2, 2, 1, 6)}


# ---- 13 periodic


def plain_runs(w) -> list[tuple[int, int, int]]:  # noqa: ANN001
    out: dict[tuple[int, int], int] = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > s and i - s + q >= max(12, 2 * q):
                out.setdefault((s, i - s + q), q)
            i += i == s
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def some_words(rnd: random.Random) -> list[int]:
    k, n, kind = rnd.choice([1, 2, 3, 4, 30]), rnd.randint(0, 70), rnd.random()
    if kind < 0.3:
        return [rnd.randrange(k) for _ in range(n)]
    if kind < 0.5:
        a, b = [0], [0, 1]  # Fibonacci words have as many runs as any
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    w: list[int] = []
    while len(w) < n:
        w += [rnd.randrange(k) for _ in range(rnd.randint(1, 14))] * rnd.randint(1, 5)
        if rnd.random() < 0.3:
            w += w
    return w[:400]


def found(texts: list[list[int]]) -> list[list[tuple[int, int, int]]]:
    starts = np.cumsum([0, *map(len, texts)])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, *run in zip(*[c.tolist() for c in periodic.runs_of(np.array(sum(texts, []), np.int64), starts)]):
        out[k].append(tuple(run))
    return out


def test_runs_against_brute_force():
    rnd = random.Random(1)
    n = 0
    for _ in range(1500):
        texts = [some_words(rnd) for _ in range(rnd.randint(1, 4))]
        want = [plain_runs(t) for t in texts]
        assert found(texts) == want
        n += sum(map(len, want))
    assert n > 3000


def test_runs_in_chunks(monkeypatch):  # noqa: ANN001
    monkeypatch.setattr(periodic, "_CHUNK", 3)
    rnd = random.Random(2)
    for _ in range(60):
        texts = [some_words(rnd) for _ in range(2)]
        assert found(texts) == [plain_runs(t) for t in texts]


def test_long_runs():
    n = 300_000
    assert found([[7] * n]) == [[(0, n, 1)]]
    block = np.random.default_rng(0).permutation(50_000).tolist()
    assert found([[-1 + 50_001, *block, *block, *block[:9], 50_001]]) == [[(1, 100_009, 50_000)]]


def test_runs_of_texts(spark):  # noqa: ANN001
    def plain(text: str | None) -> tuple:
        w = SPACE.findall(text or "")
        runs = plain_runs(w)
        drop = {i for s, n, q in runs for i in range(s + q, s + n)}
        return len(w), [tuple(r) for r in runs], " ".join(x for i, x in enumerate(w) if i not in drop)

    rnd = random.Random(4)
    texts = [rnd.choice([" ", "\n", "\t "]).join(f"é{x}" for x in some_words(rnd)) for _ in range(120)] + [None, "", " \x0b", "a " * 30_000, "a\xa0b " * 12]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "repeat_text int, text string, repetition string")
    got = periodic.with_runs(df).orderBy("repeat_text").collect()
    assert [(r["repetition"]["n_words"], [tuple(x) for x in r["repetition"]["runs"]], r["repetition"]["collapsed"]) for r in got[:-2]] == [plain(t) for t in texts[:-2]]
    assert got[-2]["repetition"]["collapsed"] == "a" and [tuple(x) for x in got[-2]["repetition"]["runs"]] == [(0, 30_000, 1)]
    assert got[-1]["text"] == texts[-1] and got[-1]["repetition"]["collapsed"] == "a\xa0b"
    assert periodic.with_runs(df.where("false")).count() == 0


def test_report_of_planted_runs(spark):  # noqa: ANN001
    rnd = random.Random(6)
    rows = [(i, " ".join(f"w{rnd.randint(0, 3000)}" for _ in range(rnd.randint(0, 200))) + rnd.choice(["", " and on" * 9]), "en") for i in range(400)] + [(None, "x y " * 8, None), (7, None, None), (7, "", "")]

    def plain(doc_id, text):  # noqa: ANN001, ANN202
        w = SPACE.findall(text or "")
        h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w)
        drop = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))

    got = periodic.report(docs(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((plain(i, t) for i, t, _ in rows), key=repr)
    assert sum(r["n_runs"] > 0 for r in got) > 100
    assert got[0].asDict().keys() == {"doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"}
