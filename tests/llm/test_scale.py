"""Operators beyond the sizes of the test tables: many shards, many languages, branching threads, clashing names."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from revsight.llm import chat, langid, ngram, simhash


def test_scores_do_not_depend_on_the_number_of_shards(spark) -> None:
    rnd = random.Random(2)
    rows = [(i, " ".join(f"w{min(rnd.randrange(300), rnd.randrange(300))}" for _ in range(rnd.randint(0, 60)))) for i in range(60)] + [(90, None), (91, "w1 unseen w2")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    scores = []
    for shards in (1, 3, 5000):
        model = ngram.train(df.where("doc_id < 50").select("text"), shards=shards)
        assert model["shards"] == shards
        scores.append({r["doc_id"]: (r["n_known"], r["score"]) for r in ngram.scored(df, model).collect()})
    for other in scores[1:]:
        assert other.keys() == scores[0].keys()
        assert all(other[k][0] == v[0] and abs(other[k][1] - v[1]) < 1e-9 for k, v in scores[0].items())


def test_a_table_of_many_shards_maps_few_of_them(tmp_path) -> None:
    def maps() -> int:
        with open("/proc/self/maps") as f:
            return sum(str(tmp_path) in line for line in f)

    shards = 5000
    table = ngram.Table(str(tmp_path), "t", ("count", "place"), shards, maps=40)
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 63, 60_000, dtype=np.uint64) * np.uint64(2))
    place = ngram.shard_of(keys, shards)
    counts, order = rng.integers(1, 70_000, len(keys)), np.arange(len(keys))
    for shard, own in ngram.split(place):
        if shard % 7:  # some shards have no file
            table.write(shard, keys[own], [counts[own], order[own]])
    held = place % 7 > 0
    sought = np.concatenate([keys, keys + np.uint64(1)])[rng.permutation(2 * len(keys))]
    for _ in range(2):
        got = table.get(sought)
        assert maps() <= 40
    at = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
    known = (keys[at] == sought) & held[at]
    assert (got[0] == np.where(known, counts[at], 0)).all() and (got[1] == np.where(known, order[at], 0)).all()


def test_more_languages_than_the_model_holds(spark, monkeypatch) -> None:
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 2)
    rows = [(i, "the cat sat on the mat and the dog", "en") for i in range(40)] + [(100 + i, "der hund und die katze sind nicht da", "de") for i in range(30)] + [(200 + i, "xq zq", f"l{i}") for i in range(20)] + [(300, "the", "b"), (301, None, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, sample = langid.sampled(df)
    assert names == ["de", "en"] and {r["lang"] for r in sample.collect()} == {"de", "en"}
    got = {r["doc_id"]: r["lang_pred"] for r in langid.report(df).collect()}
    assert len(got) == len(rows) and set(got.values()) == {"de", "en", "und"}
    assert all(got[i] == "en" for i in range(40)) and got[301] == "und"


def plain_paths(rows):  # noqa: ANN001, ANN201
    nodes = {(t, n): (p, s or 0.0) for t, n, p, s in rows}
    out: dict = {}
    for t, n, *_ in rows:
        if any(x == t and p == n for x, _, p, _ in rows):
            continue
        path, total, at = [], 0.0, n
        while (t, at) in nodes and at not in path:
            path.append(at)
            total += nodes[t, at][1]
            at = nodes[t, at][0]
        if (t, at) not in nodes:
            out.setdefault(t, []).append((-total, n, path[::-1]))
    return {t: sorted(v) for t, v in out.items()}


def test_branches_like_a_plain_walk(spark) -> None:
    rnd = random.Random(9)
    rows = []
    for t in range(25):
        n = rnd.randint(1, 40)
        for i in range(n):
            rows.append((t, i, rnd.choice([None, -5, *range(max(0, i - 3), i)]) if i else None, rnd.choice([None, float(rnd.randint(-3, 9))])))
    rows += [(90, 1, 2, 1.0), (90, 2, 1, 1.0), (90, 3, 2, 1.0), (91, 7, 7, 1.0)]  # on and under cycles
    rows += [(92, i, i - 1 if i else None, 1.0) for i in range(130)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, score double").select("*", F.lit("assistant").alias("role"), F.col("node").cast("string").alias("text"))
    # names that the operator uses itself
    df = df.select("*", *[F.lit("x").alias(c) for c in ("has", "key", "leaf", "up", "rank", "above", "turns", "total")])
    want = plain_paths([(t, n, p, s) for t, n, p, s in rows])
    for branches in (1, 3, None):
        got: dict = {}
        for r in chat.conversations(df, branches).collect():
            said = [x["text"] for x in spark.createDataFrame([(r["formatted"],)], "f string").select(chat.read_turns(F.col("f")).alias("t")).first()["t"]] if branches == 1 and r["tree"] in (0, 92) else None
            got.setdefault(r["tree"], []).append((r["rank"], -r["score"], r["leaf"], r["n_turns"], said))
        assert got.keys() == want.keys()
        for t, found in got.items():
            plain = want[t][:branches]
            assert [x[1:4] for x in sorted(found)] == [(s, leaf, len(path)) for s, leaf, path in plain]
            assert [x[0] for x in sorted(found)] == list(range(1, len(plain) + 1))
            if found[0][4] is not None:
                assert found[0][4] == [str(x) for x in plain[0][2]]


def test_training_steps_like_the_written_formula() -> None:
    """Follow-the-regularised-leader, coordinate by coordinate, and the temperature by trying many."""
    rng = np.random.default_rng(4)
    dims, classes = 30, 3
    model = langid.Ftrl(dims, classes, alpha=0.3, beta=1.0, l1=0.05, l2=0.02)
    z, n = [[0.0] * classes for _ in range(dims + 1)], [[0.0] * classes for _ in range(dims + 1)]

    def weight(i: int, c: int) -> float:
        if abs(z[i][c]) <= 0.05:
            return 0.0
        return -(z[i][c] - (0.05 if z[i][c] > 0 else -0.05)) / ((1.0 + n[i][c] ** 0.5) / 0.3 + 0.02)

    for _ in range(150):
        at = rng.choice(dims, rng.integers(1, 6), replace=False)
        x, y = rng.random(len(at)), int(rng.integers(0, classes))
        model.step(at, x, np.eye(classes)[y])
        active = [*zip(at.tolist(), x.tolist()), (dims, 1.0)]
        w = {(i, c): weight(i, c) for i, _ in active for c in range(classes)}
        raw = [sum(v * w[i, c] for i, v in active) for c in range(classes)]
        e = [np.exp(r - max(raw)) for r in raw]
        for c in range(classes):
            g = e[c] / sum(e) - (c == y)
            for i, v in active:
                before = n[i][c]
                n[i][c] += (g * v) ** 2
                z[i][c] += g * v - (n[i][c] ** 0.5 - before**0.5) / 0.3 * w[i, c]
    assert np.allclose(model.z, z) and np.allclose(model.n, n)
    assert np.allclose(model.weights(), [[weight(i, c) for c in range(classes)] for i in range(dims + 1)])
    assert (model.weights()[:-1] == 0).any()

    truth = rng.integers(0, classes, 400)
    scores = 3.0 * (np.eye(classes)[truth] + rng.normal(0, 0.8, (400, classes)))
    loss = lambda t: -np.log(langid.softmax(scores / t)[np.arange(400), truth]).mean()
    best = min(np.exp(np.linspace(np.log(0.05), np.log(20), 2000)), key=loss)
    assert abs(langid.temperature(scores, truth) / best - 1) < 0.01
    assert langid.temperature(scores[:0], truth[:0]) == 1.0


def test_a_group_of_near_copies_lists_no_square_of_its_members(spark, monkeypatch) -> None:
    """Texts of a large bucket whose smallest node and hubs resemble few: members that belong together are joined by few pairs."""
    rnd = random.Random(5)
    rows = []
    for i in range(340):
        words = [f"w{k}" for k in range(200)]
        # two changes leave texts alike, six don't
        for k in rnd.sample(range(5, 195), 2 if i >= 200 else 6):
            words[k] = f"x{i}-{k}"
        rows.append((i, " ".join(words)))
    sets = [set(simhash.shingles(t, 5)) for _, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if x == old else x for x in root]
    want = {i: r for i, r in enumerate(root) if root.count(r) > 1}
    assert len(want) >= 140
    listed, checked = [], simhash._checked

    def counted(candidates, *rest):  # noqa: ANN001, ANN002, ANN202
        listed.append(candidates.count())
        return checked(candidates, *rest)

    monkeypatch.setattr(simhash, "_checked", counted)
    monkeypatch.setattr(simhash, "HUBS", 1)
    monkeypatch.setattr(simhash, "_marked_pairs", lambda texts, *_: texts.sparkSession.createDataFrame([], "a long, b long"))
    got = {r["node"]: r["component"] for r in simhash.similar_groups(spark.createDataFrame(rows, "node long, text string")).collect()}
    assert got == want
    assert sum(listed[1:]) < 10 * len(rows)
