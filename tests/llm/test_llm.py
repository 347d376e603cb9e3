"""The training-data operators against plain versions, and their edges: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from compare import connection, differences
from pyspark.sql import functions as F

from revsight.llm import caps, chat, langid, mixing, ngram, packing, quality, queries, secrets, simhash, toxicity
from revsight.llm.components import components

DOC = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):  # noqa: ANN001, ANN201
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in rows], DOC)


def roots(links, nodes):  # noqa: ANN001, ANN201
    up = {n: n for n in nodes}

    def find(x):  # noqa: ANN001, ANN202
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


@pytest.fixture(scope="module")
def real(spark, sf):  # noqa: ANN001, ANN201
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(real):  # noqa: ANN001, ANN201
    return {r["doc_id"]: r["text"] for r in real.select("doc_id", "text").collect()}


ODD = [(1, None, "en", "a"), (2, "", "en", None), (3, " \t\n", None, "a"), (4, "Word", "en", "a"), (4, "Word", "en", "a"), (None, "no id here at all", "de", ""), (5, "é " * 40000, "fr", "b"), (6, "\\### x </turn>  <|endoftext|>", "es", "ü")]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_agrees_with_sql(spark, sf, name):  # noqa: ANN001
    assert differences(queries.queries()[name](spark, sf), queries.oracle_sql()[name], connection(sf)) == []


# ---- 1 chat


def test_chat_trees(spark) -> None:
    rows = [(1, 1, None, "user", "a#<\\b", 1.0), (1, 2, 1, "assistant", "x", 5.0), (1, 3, 1, "assistant", None, 2.0), (1, 4, 3, None, "</turn>\n", 9.0), (2, 9, 8, "user", "orphan", None), (3, 1, 2, "user", "cycle", 1.0), (3, 2, 1, "user", "cycle", 1.0), (None, 1, None, "a:b", "null tree", 1.0)]
    trees = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    made = chat.conversations(trees, None).select("tree", "leaf", "rank", "score", "n_turns", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("said")).collect()
    got = {(r["tree"], r["leaf"]): (r["rank"], r["score"], [tuple(t) for t in r["turns"]], r["said"]) for r in made}
    assert got == {
        (1, 4): (1, 12.0, [("user", "a#<\\b"), ("assistant", ""), ("", "</turn>\n")], ""),
        (1, 2): (2, 6.0, [("user", "a#<\\b"), ("assistant", "x")], "x"),
        (2, 9): (1, 0.0, [("user", "orphan")], ""),
        (None, 1): (1, 1.0, [("a:b", "null tree")], ""),
    }
    assert {(r["tree"], r["leaf"]) for r in chat.conversations(trees, 1).collect()} == {(1, 4), (2, 9), (None, 1)}
    assert chat.conversations(trees.limit(0)).count() == 0


def test_chat_rows(spark) -> None:
    rows = [(7, None, "user", "late"), (7, 1, "user", "b"), (7, 1, "user", "a"), (7, 1, "user", "a"), (8, 0, "assistant", "long " * 5000)] + [(9, i, "user", str(i)) for i in range(70)]
    got = {r["conv_id"]: r for r in chat.report(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    said = "".join(f"user\n{t}\n" for t in ("a", "a", "b", "late"))
    assert got[7]["n_turns"] == 4 and got[7]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert got[8]["loss_chars"] == 25000 and got[9]["n_turns"] == 70
    assert got[-7]["loss_sha256"] == hashlib.sha256(chat.PLANTED.encode()).hexdigest()
    plan = chat.report(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- 2 secrets


def plain_secrets(t: str) -> list[tuple[int, int, int]]:
    spans = [(m.start(), 0, m.end()) for m in re.finditer(secrets.ASSIGN.pattern, t, re.I | re.A) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return sorted(spans + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32])


def test_secret_patterns(spark, real, texts) -> None:
    extra = {1001: "é token=secret=abcdefgh12 api-key: x PASSWORD : 'abcdefgh", 1002: "AKIAAKIA0123456789 " + "ab12" * 10 + "é" + "0" * 33, 1003: "", 1004: "a" * 31 + " " + "f" * 32, 1005: 'token: "secret" = "abcdefghijk"'}
    df = real.unionByName(docs(spark, [(i, t, "en", "s") for i, t in extra.items()]))
    for r in secrets.report(df).collect():
        t = extra.get(r["doc_id"], texts.get(r["doc_id"])) or ""
        want = plain_secrets(t)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in want) for i in range(3)]
        joined = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert ",".join(x for x in r["spans"].split(",") if not x.startswith("random")) == joined


def test_random_tokens(spark, real) -> None:
    rng = np.random.default_rng(5)
    alphabet = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
    planted = {2000 + i: "".join(rng.choice(alphabet, 40)) for i in range(20)}
    words = {3000 + i: w for i, w in enumerate(["antidisestablishmentarianism" * 2, "state-of-the-art-multi-purpose-thing", "A" * 60, "abababababababababababababababab", "12345678901234567890"])}
    df = real.unionByName(docs(spark, [(i, f"see {t} there", "en", "s") for i, t in (planted | words).items()]))
    got = {r["doc_id"]: r for r in secrets.report(df).collect()}
    assert sum(got[i]["n_random"] for i in planted) >= 18
    assert [i for i in words if got[i]["n_random"]] == []
    assert sum(r["n_random"] for i, r in got.items() if i < 2000) == 0


def test_secret_offsets_are_linear_in_the_text() -> None:
    import time

    text = "é token " + "x9" * 20 + " word " + "é"
    t0 = time.perf_counter()
    spans, tokens, _ = secrets.found_in([None, "é" + "ab12" * 10, text * 300_000, ""])
    assert time.perf_counter() - t0 < 20
    assert spans[1] == [(1, 2, 41, 1)] and tokens[1] == [(1, 41, b"ab12" * 10)]
    assert len(tokens[2]) == 300_000 and tokens[2][-1][0] == 299_999 * len(text) + 8
    batch = secrets.pa.RecordBatch.from_arrays([secrets.pa.array(["a" * 3_000_000, None, "b" * 3_000_000, "c"])], names=["t"])
    assert [p.num_rows for p in secrets.sliced(batch)] == [3, 1]


def test_evidence_against_a_plain_version_and_its_mean() -> None:
    rng = np.random.default_rng(12)
    counts = np.zeros(256)
    counts[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = rng.integers(50, 5000, 26)
    counts[[ord(c) for c in "0123456789ABCDEF"]] = 40
    share = secrets.ordinary(counts)
    token = b"".join(bytes([c]) for c in range(256) if secrets._TOKEN[c])
    assert abs(sum(2 ** share[c] for c in token) - 1) < 1e-9
    one = bytes(rng.choice(np.frombuffer(b"0123456789abcdef", np.uint8), 32))
    held = [a for _, a in secrets.ENCODINGS if all(c in a for c in one)]
    p = min(secrets.battery(np.array([list(held[0]).index(c) for c in one]), len(held[0])))
    as_text = max(math.prod(2 ** share[c] / sum(2 ** share[x] for x in a) for c in one) for a in held)
    assert p >= secrets.LEVEL / 3
    want = min(1, 3 * p) * sum(len(a) ** -32.0 for a in held) / len(secrets.ENCODINGS) / as_text
    assert math.isclose(2 ** secrets.evidence(one, share), want, rel_tol=1e-9)
    # tokens drawn from the corpus, whole or in one encoding: the mean of the e-value is at most one
    for alphabet in (np.flatnonzero(secrets._TOKEN), *[a for _, a in secrets.ENCODINGS[:5]]):
        chance = 2.0 ** share[alphabet]
        drawn = rng.choice(alphabet, (1500, 24), p=chance / chance.sum())
        assert np.mean([2 ** secrets.evidence(bytes(r.astype(np.uint8)), share) for r in drawn]) < 1


def test_secret_edges(spark) -> None:
    df = docs(spark, [*ODD, (10, None, None, None), (10, None, None, None), (11, "password=abcdefgh1", "en", "s"), (11, "password=abcdefgh1", "en", "s")]).withColumn("spans", F.lit("mine"))
    got = secrets.report(df).collect()
    assert len(got) == df.count() and sum(r["n_assign"] for r in got if r["doc_id"] == 11) == 2
    assert secrets.report(df.limit(0)).count() == 0
    assert dict(secrets.with_spans(df).dtypes)["spans"].startswith("array") and len(secrets.with_spans(df).columns) == len(df.columns)


def test_redaction(spark) -> None:
    df = docs(spark, [*ODD, (9, "x token = abcdefgh12 y", "en", "s")]).withColumn("spans", F.lit(1))
    got = {r["doc_id"]: r for r in secrets.redacted(df).collect()}
    assert got[9]["text"] == "x token = [SECRET] y" and got[9]["n_chars"] == len("x token = [SECRET] y")
    assert got[1]["text"] is None and got[5]["n_chars"] == 80000 and secrets.redacted(df).columns == df.columns
    assert secrets.redacted(df.limit(0)).count() == 0


# ---- 3 packing


def check_pieces(rows, want: dict) -> None:  # noqa: ANN001
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(want)
    for i, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            ids = want[i]
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(want[i])
    used = padded = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
        used += at
        padded += 0 if at & (at - 1) == 0 else 4096 - at
    assert padded <= 0.02 * used + 4096


def test_packing(spark, real, texts) -> None:
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = {1007: "again", 1001: None, 1002: "", 1003: "İstanbul ǅ ﬁ Σας. it's 3.14, x.y ź é ß!!. <|ENDOFTEXT|>", 1004: "<|endoftext|> a<|startoftext|>b", 1005: "word " * 9000, 1006: "﻿a​b ...,. #hash @x"}
    df = real.unionByName(docs(spark, [(i, t, "en", "s") for i, t in odd.items()])).withColumn("start", F.lit(1))
    want = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in (texts | odd).items()}
    check_pieces(packing.report(df).collect(), want)
    assert packing.report(df.limit(0)).count() == 0


def test_every_limit_binds(spark) -> None:
    rng = np.random.default_rng(7)
    limits = packing.Limits()
    ids = lambda n: rng.integers(5, 900, n).astype("<u4").tobytes()
    mixed = [(i, ids(int(n))) for i, n in enumerate([*rng.integers(100, 900, 900), *[20_000] * 5])]
    short = [(i, ids(int(rng.integers(1, 60)))) for i in range(3000)]
    seen = set()
    for documents in (mixed, short, [(1, ids(1))], []):
        got = defaultdict(list)
        for packed in packing.sequences(iter(documents), limits):
            sizes = np.array([p.size() for p in packed]).sum(axis=0)
            assert (sizes <= limits.array()).all()
            full = [sizes[0] > limits.tokens - limits.tolerance - 1, sizes[1] == limits.segments, sizes[2] > limits.loss - limits.tolerance - 1 and sizes[0] < limits.tokens - limits.tolerance]
            seen |= {k for k, x in enumerate(full) if x and sum(full) == 1}
            for p in packed:
                got[p.doc_id].append((p.start, p.data))
        assert {i: b"".join(d for _, d in sorted(own)) for i, own in got.items()} == dict(documents)
    assert seen == {0, 1, 2}


def test_other_tokenizers_encode_whole_texts() -> None:
    import public_tokenizers
    from tokenizers import Tokenizer

    for name, by_word in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        encoder, plain = packing.Encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
        assert encoder.by_word == by_word
        texts = ["Some  words, and MORE.", "a\tb\n\nc", None, "x.y " * 50]
        want = [[*plain.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.batch(texts)] == want


def test_packing_examples(spark) -> None:
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(1, 1500)), int(rng.integers(1, 5)), int(rng.integers(0, 600))) for i in range(800)] + [(900, 9000, 1, 1), (901, None, None, None)]
    df = spark.createDataFrame(rows, "id long, t int, s int, l int").coalesce(1)
    limits = packing.Limits(tokens=4096, segments=8, loss=1500)
    sums, sizes = defaultdict(lambda: np.zeros(3)), {r[0]: np.array([x or 0 for x in r[1:]]) for r in rows}
    for r in packing.pack_examples(df, "id", "t", "s", "l", limits).collect():
        sums[r["sequence_id"]] += sizes[r["key"]]
    over = [v for v in sums.values() if (v > [4096, 8, 1500]).any()]
    assert len(over) == 1 and over[0][0] == 9000
    least = max(np.ceil(sum(s[k] for i, s in sizes.items() if i != 900) / x) for k, x in enumerate((4096, 8, 1500)))
    assert len(sums) <= 1.15 * least + 2


# ---- 4 caps


def test_caps(spark) -> None:
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 64))
    rows: list[tuple] = []
    for c in centres:
        c = c / np.linalg.norm(c)
        for _ in range(12):
            rows.append((len(rows), (c + rng.standard_normal(64) * rng.uniform(0.005, 0.06)).astype(np.float32).tolist(), 1))
    rows += [(len(rows) + k, rows[0][1], 2) for k in range(1500)]
    n = len(rows)
    bad = [(n, None), (n + 1, []), (n + 2, [0.0] * 64), (n + 3, [float("nan")] + [1.0] * 63), (n + 4, [float("inf")] + [1.0] * 63), (n + 5, [None] + [1.0] * 63), (n + 6, [1.0] * 3), (n + 7, [2.0] * 3), (None, rows[1][1])]
    df = spark.createDataFrame([*rows, *[(i, v, 0) for i, v in bad]], "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(0))
    got = {r["vec_id"]: r for r in caps.report(df).collect()}
    x = np.array([r[1] for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    want = near.sum(axis=1)
    have = np.array([got[i]["n_links"] for i in range(n)])
    assert (have <= want).all() and have.sum() >= 0.999 * want.sum()
    comp = roots([(a, b) for a, b in zip(*np.nonzero(near)) if a < b], range(n))
    assert np.mean([got[i]["component_id"] == comp[i] for i in range(n)]) >= 0.99
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(n, n + 6))
    assert got[n + 6]["n_links"] == 1 and got[n + 7]["component_id"] == n + 6 and got[None]["n_links"] == 0
    assert caps.report(df.limit(0)).count() == 0


def test_caps_find_links_that_are_no_copies(spark) -> None:
    rng = np.random.default_rng(14)
    n, dims = 20_000, 64
    x = rng.standard_normal((n, dims))
    x /= np.linalg.norm(x, axis=1)[:, None]
    # every second vector lies at a cosine between 0.95 and 0.96 of the one before
    other = rng.standard_normal((n // 2, dims))
    other -= (other * x[::2]).sum(axis=1)[:, None] * x[::2]
    cosine = rng.uniform(0.95005, 0.96, n // 2)[:, None]
    x[1::2] = cosine * x[::2] + np.sqrt(1 - cosine**2) * other / np.linalg.norm(other, axis=1)[:, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    found = np.array([r["n_links"] for r in caps.report(df).orderBy("vec_id").collect()])
    x = np.array([v / math.sqrt(v @ v) for v in x])
    want = np.zeros(n, int)
    for at in range(0, n, 2000):
        want[at : at + 2000] = (x[at : at + 2000] @ x.T >= 0.95).sum(axis=1) - 1
    assert want.sum() >= n and (found <= want).all()
    assert found.sum() >= 0.99 * want.sum()


def test_components(spark) -> None:
    rng = np.random.default_rng(2)
    links = [(i, i + 1) for i in range(40)] + [(int(a), int(b)) for a, b in rng.integers(100, 300, (150, 2))] + [(500, 500), (7, 3), (7, 3)]
    df = spark.createDataFrame([*links, (None, 1), (1, None)], "a long, b long")
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert {r["node"]: r["component"] for r in components(df).collect()} == roots([x for x in links if x[0] != x[1]], nodes)
    assert components(df.limit(0)).count() == 0


# ---- 5 quality


def test_quality_edges(spark) -> None:
    df = docs(spark, [*ODD, (10, "a b c d e " * 2 + "f", "en", "s"), (11, " ".join(f"w{i}x" for i in range(30)), "en", "s")]).withColumn("quality", F.lit(1)).withColumn("n_words", F.lit(2))
    got = {r["doc_id"]: r for r in quality.report(df).collect()}
    assert got[10]["n_repeat_words"] == 10 and got[10]["base_failed"] and got[1]["n_words"] == 0 and not got[1]["kept"]
    assert got[5]["n_repeat_words"] == 40000 and got[11]["kept"]
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and [r["doc_id"] for r in kept.collect()] == [11]
    assert quality.report(df.limit(0)).count() == 0
    assert "Python" not in quality.report(df)._jdf.queryExecution().toString()


def test_clean_documents_are_kept(spark, sf, real) -> None:
    good = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1")
    lost = quality.report(real).join(good, "doc_id").where("NOT kept AND NOT base_failed")
    assert lost.count() == 0


# ---- 6 toxicity


def test_toxicity(spark) -> None:
    rng = np.random.default_rng(4)
    calm, rude = [f"{a}{b}" for a in ("ner", "tol", "was", "ing", "ard") for b in ("ost", "ine", "ure", "and", "el", "om")], [f"zork{e}" for e in ("a", "ix", "ul", "en", "ot", "is")]
    rows, marks = [], {}
    for i in range(900):
        words = [str(w) for w in rng.choice(calm, 40)]
        marks[i] = int(rng.random() < 0.2)
        for _ in range(2 * marks[i]):
            words.insert(int(rng.integers(0, 40)), str(rng.choice(rude)))
        rows.append((i, " ".join(words), "en", "s"))
    labels = spark.createDataFrame([(i, 1, m) for i, m in marks.items() if i % 2] + [(1, 1, 0), (5000, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.report(docs(spark, [*rows, (5001, None, "en", "s"), (5002, "", "en", "s")]).withColumn("score", F.lit(1)), labels).collect()}
    held = [i for i in range(900) if got[i]["held_out"]]
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == got[i]["held_out"] for i in range(900))
    assert np.mean([got[i]["predicted"] == marks[i] for i in held]) > 0.97
    assert got[5001]["score"] == got[5002]["score"] < 0.5 and all(0 <= r["score"] <= 1 for r in got.values())
    plain = toxicity.report(docs(spark, [(1, "you are a pathetic idiot", "en", "s"), (2, "a fine day", "en", "s")]), labels.limit(0)).collect()
    assert {r["doc_id"]: r["predicted"] for r in plain} == {1: 1, 2: 0}
    assert toxicity.report(docs(spark, rows).limit(0), labels).count() == 0


def test_toxicity_of_every_language(spark) -> None:
    # three of five toxic documents hold English insults; the other languages have words of their own, and few marks
    sf = "/root/testdata/sf0.1"
    real, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.report(real, labels).where("held_out").join(toxicity.marks_of(labels), "doc_id").join(real.select("doc_id", "lang"), "doc_id").collect()
    caught = lambda *langs: np.mean([r["predicted"] for r in rows if r["toxic"] and r["lang"] in langs])
    assert caught("en", "de", "fr", "es") >= 0.9 and caught("es") >= 0.9
    assert np.mean([r["predicted"] == 0 for r in rows if not r["toxic"]]) > 0.99


def test_toxicity_reads_texts_once_for_votes_and_scores(spark) -> None:
    rows = [(i, f"calm word{i} {'idiot zork' if i % 7 == 0 else ''}", "en", "s") for i in range(200)] + [(200, None, "en", "s")]
    made, labels = docs(spark, rows), spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(150)], "doc_id long, toxic int")
    got = toxicity.report(made, labels)
    # what is found in texts is stored, and scores are read off that
    assert "text" not in got._jdf.queryExecution().optimizedPlan().toString()
    plain = toxicity.scored(made.select("doc_id", "text"), toxicity.learned(made, labels))
    want = {r["doc_id"]: r["score"] for r in plain.collect()}
    assert all(math.isclose(r["score"], want[r["doc_id"]], rel_tol=1e-9) for r in got.collect()) and len(want) == 201


def test_label_model_estimates_accuracies_and_correlations(spark) -> None:
    rng = np.random.default_rng(21)
    n, m = 6000, toxicity.N_VOTERS
    y = rng.random(n) < 0.15
    v = np.zeros((n, m))
    hit, false = [0.7, 0.5, 0.6, 0.4], [0.02, 0.05, 0.01, 0.03]
    for i in range(4):
        v[:, i] = rng.random(n) < np.where(y, hit[i], false[i])
    # three voters repeat one that is no better than chance
    v[:, 4] = rng.random(n) < 0.3
    for i in (5, 6, 7):
        v[:, i] = np.where(rng.random(n) < 0.97, v[:, 4], rng.random(n) < 0.3)
    marks = np.where(rng.random(n) < 0.5, np.where(rng.random(n) < 0.06, ~y, y), -1).astype(int)
    votes = (v.astype(np.int64) << np.arange(m)).sum(axis=1)
    rows = [(int(a), int(b), c) for (a, b), c in Counter(zip(votes.tolist(), marks.tolist())).items()]
    model = toxicity.label_model(spark.createDataFrame(rows, "votes long, mark int, n long"))
    # the same rounds over all rows at once, one row a document
    plain = None
    for _ in range(toxicity.ROUNDS):
        plain = toxicity.LabelModel(toxicity.moments(v, marks, np.ones(n), plain))
    q = model.posterior(v, marks)
    assert np.abs(q - plain.posterior(v, marks)).max() < 0.02
    # accuracies of voters and of the mark, and the tree that joins the repeating ones
    fires = [(q[:, None] * v)[:, :4].sum(axis=0) / q.sum(), ((1 - q)[:, None] * v)[:, :4].sum(axis=0) / (1 - q).sum()]
    assert np.abs(fires[0] - hit).max() < 0.08 and np.abs(fires[1] - false).max() < 0.04
    assert 0.88 < model.mark[1] < 0.99 and 0.01 < model.mark[0] < 0.1
    pairs = {frozenset((i, int(model.parent[i]))) for i in range(m)}
    assert sum(p <= {4, 5, 6, 7} for p in pairs) == 3
    known = marks >= 0
    assert ((q > 0.5) == y)[known].mean() > (marks == y)[known].mean() + 0.02
    # a posterior is the ratio of the two classes' probabilities, multiplied out
    for row in (0, 17, 4321):
        chance = []
        for c in (0, 1):
            p = [model.rate[c][int(v[row, max(model.parent[i], 0)]) if model.parent[i] >= 0 else 0][i] for i in range(m)]
            of_mark = 1.0 if marks[row] < 0 else model.mark[c] if marks[row] == 1 else 1 - model.mark[c]
            chance.append(math.prod(x if f else 1 - x for x, f in zip(p, v[row])) * of_mark)
        odds = math.exp(model.prior) * chance[1] / chance[0]
        assert math.isclose(q[row], odds / (1 + odds), rel_tol=1e-6, abs_tol=1e-9)


def test_toxicity_edges(spark) -> None:
    long = "calm words " * 400_000
    rows = [(1, long, "en", "s"), (2, long + "you pathetic idiot", "en", "s"), (3, "you pathetic idiot", "en", "s"), (3, "you pathetic idiot", "en", "s"), (4, "you pathetic idiot", "en", "s"), (None, "x", None, None)]
    df = docs(spark, rows).withColumn("toxic", F.lit("mine")).withColumn("votes", F.lit(0))
    got = toxicity.report(df, spark.createDataFrame([(3, 1), (1, 0)], "doc_id long, toxic int")).collect()
    assert len(got) == 6 and len({r["score"] for r in got if r["doc_id"] in (3, 4)}) == 1
    assert {r["predicted"] for r in got if r["doc_id"] in (2, 3, 4)} == {1} and [r["predicted"] for r in got if r["doc_id"] == 1] == [0]


# ---- 7 language model


class PlainModel:
    """Interpolated modified Kneser-Ney of any order, word by word."""

    def __init__(self, texts: list[list], order: int):
        self.order, levels = order, [Counter() for _ in range(order + 1)]
        self.words = Counter(w for t in texts for w in t)
        for t in texts:
            run = [0, *t]
            for i in range(1, len(run)):
                levels[order][tuple(run[max(0, i - order + 1) : i + 1])] += 1
        # a gram from the start keeps its count on every level it fits in, any other counts the words before it
        for k in range(order, 1, -1):
            for g, c in list(levels[k].items()):
                if len(g) == k:
                    levels[k - 1][g[1:]] += 1
                else:
                    levels[k - 1][g] += c
            levels[k] = Counter({g: c for g, c in levels[k].items() if len(g) == k})
        self.levels, self.after, self.d = levels, [defaultdict(list) for _ in levels], [None] * (order + 1)
        for k in range(1, order + 1):
            for g, c in levels[k].items():
                self.after[k][g[:-1]].append(c)
            n = [sum(c == j for c in levels[k].values()) for j in (1, 2, 3, 4)]
            y = n[0] / (n[0] + 2 * n[1])
            raw = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
            self.d[k] = d = [0, *[min(max(x, 0.05), j - 0.05) for j, x in zip((1, 2, 3), raw)]]
            self.after[k] = {context: (sum(own), sum(d[min(c, 3)] for c in own)) for context, own in self.after[k].items()}

    def p(self, context: tuple, word, k: int | None = None) -> float:  # noqa: ANN001
        k = self.order if k is None else k
        if k == 0:
            return 1 / (len(self.words) + 1)
        own = context[-(k - 1) :] if k > 1 else ()
        found = self.after[k].get(own) if len(own) == k - 1 else None
        below = self.p(context, word, k - 1)
        if not found:
            return below
        c = self.levels[k].get((*own, word), 0)
        return (c - self.d[k][min(c, 3)] + found[1] * below) / found[0]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model(spark, real, texts, order) -> None:
    odd = {1001: None, 1002: "", 1003: "never-seen-word ÉÉ", 1004: "The THE the", 1005: "a long text \n" * 20_000}
    df = real.unionByName(docs(spark, [(i, t, "en", "s") for i, t in odd.items()])).withColumn("score", F.lit(0))
    words = {i: [w.decode() for w in (t or "").encode().lower().split()] + [None] for i, t in (texts | odd).items()}
    plain = PlainModel([words[i] for i in words if zlib.crc32(str(i).encode()) % 7 != 2], order)
    one, total, types = plain.words, sum(plain.words.values()), len(plain.words)
    slim = df.select("doc_id", "text")
    model = ngram.train(slim.where(ngram.residue("doc_id", 7) != 2).select("text"), order=order)
    rows = ngram.report(df).collect() if order == ngram.ORDER else ngram.scored(slim, model).collect()
    assert len(rows) == len(words)
    for r in rows:
        w = words[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(one[x] > 0 for x in w), total)
        assert math.isclose(r["base_score"], sum(math.log10((one[x] + 1) / (total + types + 1)) for x in w), rel_tol=1e-9)
        run = (0, *w)
        want = sum(math.log10(plain.p(run[max(0, i - order + 1) : i], run[i])) for i in range(1, len(run)))
        assert abs(r["score"] - want) < 1e-6 * len(w)
    assert abs(sum(plain.p((0, "the"), b) for b in one) + plain.p((0, "the"), "never") - 1) < 1e-9


def test_language_model_edges(spark) -> None:
    rows = [(i, t, "en", "s") for i, t in enumerate(["same words here", "same words here", None, "", "a b a b a b a b"])]
    got = {r["doc_id"]: r for r in ngram.report(docs(spark, rows)).collect()}
    assert got[0]["score"] == got[1]["score"] and got[2]["score"] == got[3]["score"] <= 0 and got[2]["n_tokens"] == 1
    none = ngram.scored(docs(spark, rows).select("doc_id", "text"), ngram.train(docs(spark, rows).limit(0).select("text"))).collect()
    assert {r["score"] for r in none} == {0.0} and {r["n_known"] for r in none} == {0}
    assert ngram.report(docs(spark, rows).limit(0)).count() == 0


def test_language_model_files_hold_counts_of_any_size(tmp_path) -> None:
    table = ngram.Table(str(tmp_path), "t", ("count",), 2)
    keys, counts = np.array([3, 1 << 40, 5 << 40], np.uint64), np.array([1, 1 << 34, 70_000])
    table.write(0, keys, [counts])
    (found,) = table.get(np.array([5 << 40, 4, 1 << 40, 3], np.uint64))
    assert found.tolist() == [70_000, 0, 1 << 34, 1]
    # told apart by other keys, whose upper half lies in the second shard
    assert table.get(np.array([3], np.uint64), np.array([1 << 63], np.uint64))[0].tolist() == [0]
    columns = [np.array([0, 1, 2**64 - 1], np.uint64), np.array([5, 6, 7], np.uint64)]
    assert (ngram.unpack([ngram.pack(columns), ngram.pack([c[:0] for c in columns])], 2) == np.stack(columns)).all()


# ---- 8 mixing


def test_mixing(spark, real) -> None:
    df = docs(spark, ODD).unionByName(real.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")))).withColumn("size", F.lit("x")).withColumn("target", F.lit(1))
    first, again = mixing.report(df).collect(), mixing.report(df.repartition(7)).collect()
    assert sorted(map(repr, first)) == sorted(map(repr, again))
    by: dict = defaultdict(list)
    for r in first:
        by[r["source"]].append(r)
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    total = sum(r["size"] for r in first)
    assert abs(sum(x[0]["target"] for x in by.values()) - 1.5 * total) < 1e-6 * total
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    targets, capped = {}, set()
    while True:
        rest = 1.5 * total - sum(2 * by[s][0]["source_size"] for s in capped)
        share = sum(weights[s] for s in order if s not in capped)
        targets = {s: 2.0 * by[s][0]["source_size"] if s in capped else rest * weights[s] / share for s in order}
        over = {s for s in order if s not in capped and targets[s] > 2 * by[s][0]["source_size"]}
        if not over:
            break
        capped |= over
    for s, rows in by.items():
        assert math.isclose(rows[0]["target"], targets[s], rel_tol=1e-9, abs_tol=1e-9)
        assert abs(sum(r["taken"] for r in rows) - targets[s]) <= max(r["size"] for r in rows)
    out = mixing.mixed(df)
    assert out.columns == df.columns and out.count() == sum(r["copies"] for r in first)
    assert mixing.report(df.limit(0)).count() == 0 and mixing.mixed(df.limit(0)).count() == 0


# ---- 9 simhash


def plain_mark(t: str | None, size: int) -> int:
    w = [x.decode() for x in (t or "").encode().lower().split()]
    grams = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) > size else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_groups_take_candidates_from_fingerprints(spark, monkeypatch) -> None:
    base = " ".join(f"w{i}" for i in range(400))
    texts = [base, base + " end", " ".join(f"v{i}" for i in range(400))]
    got = {tuple(r) for r in simhash._marked_pairs(spark.createDataFrame(list(enumerate(texts)), "node long, text string"), 5, 3).collect()}
    assert got == {(0, 1)}
    tried = []
    real = simhash._marked_pairs
    monkeypatch.setattr(simhash, "_marked_pairs", lambda *a: tried.append(a) or real(*a))
    rows = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert tried and rows == {0: 0, 1: 0, 2: 2}


def test_simhash(spark, real, texts) -> None:
    got = {r["doc_id"]: r for r in simhash.report(real.unionByName(docs(spark, [(1001, None, "", ""), (1002, " ", "", "")])).withColumn("fingerprint", F.lit(1))).collect()}
    marks = {i: plain_mark(t, 3) for i, t in (texts | {1001: None, 1002: " "}).items()}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{m:016x}" for i, m in marks.items()}
    ids = sorted(marks)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if bin(marks[a] ^ marks[b]).count("1") <= 3]
    assert {i: r["component_id"] for i, r in got.items()} == roots(links, ids)
    assert simhash.report(real.limit(0)).count() == 0


@pytest.mark.parametrize("small", [4096, 8])
def test_covering_loses_no_link(spark, small) -> None:
    rng = np.random.default_rng(6)
    marks = {int(x) for x in rng.integers(0, 2**64, 200, dtype=np.uint64)}
    for m in list(marks)[:40]:
        for _ in range(12):
            marks.add(m ^ int(sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 5)), replace=False))))
    marks = sorted(marks)
    signed = [simhash._signed(m) for m in marks]
    df = spark.createDataFrame([(m,) for m in signed], "mark long")
    links = [(a, b) for k, a in enumerate(marks) for b in marks[k + 1 :] if bin(a ^ b).count("1") <= 3]
    found = [(r["a"] & (2**64 - 1), r["b"] & (2**64 - 1)) for r in simhash.links(df, 3, small).collect()]
    assert all(bin(a ^ b).count("1") <= 3 for a, b in found)
    assert roots(found, marks) == roots(links, marks)
    from itertools import combinations

    for radius in (2, 3):
        tables = simhash.masks(list(range(64)), radius)
        assert all(any(not m & sum(1 << b for b in bits) for m in tables) for bits in combinations(range(0, 64, 3), radius))


def test_near_copies_stage(spark) -> None:
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 7))
    base = [[word() for _ in range(200)] for _ in range(30)]
    rows, i = [], 0
    for b in base:
        rows.append((i, " ".join(b), "en", "s"))
        near = list(b)
        near[int(rng.integers(0, 200))] = word()
        rows += [(i + 1, " ".join(near), "en", "s"), (i + 2, " ".join(b).upper(), "en", "s")]
        i += 3
    far = [(1000 + k, " ".join([word() for _ in range(150)] + b[:50]), "en", "s") for k, b in enumerate(base)]
    df = docs(spark, [*rows, *far, (None, "x", "en", "s"), (1, rows[1][1], "en", "s")]).withColumn("component", F.lit(1))
    kept = sorted(r["doc_id"] for r in simhash.keep_first(df).where("doc_id IS NOT NULL").collect())
    assert kept == [*range(0, 90, 3), *range(1000, 1030)]
    assert simhash.keep_first(df).where("doc_id IS NULL").count() == 1 and simhash.keep_first(df).columns == df.columns
    assert simhash.keep_first(df.limit(0)).count() == 0


def similar(a: str, b: str) -> float:
    p, q = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(p & q) / len(p | q)


def test_near_copies_with_changed_passages(spark) -> None:
    rng = np.random.default_rng(9)
    words = lambda n: ["".join(rng.choice(list("abcdefghijklmnop"), 7)) for _ in range(n)]
    texts = {}
    for k in range(60):
        base = words(int(rng.integers(60, 400)))
        n, share = len(base), float(rng.uniform(0.04, 0.24))
        more = int(share * n)
        spread = list(base)
        for at in rng.choice(n, max(1, int(share * n / 10)), replace=False):
            spread[int(at)] = words(1)[0]
        copy = [base + words(more), words(more) + base, base[: n - more], spread][k % 4]
        texts[2 * k], texts[2 * k + 1] = " ".join(base), " ".join(copy)
    links = [(a, a + 1) for a in range(0, 120, 2) if similar(texts[a], texts[a + 1]) >= 0.8]
    assert 40 <= len(links) < 60
    got = simhash.near_groups(docs(spark, [(i, t, "en", "s") for i, t in texts.items()])).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == roots(links, texts)


@pytest.mark.parametrize("most", [16, 2])
def test_near_copies_beside_unlike_texts(spark, most, monkeypatch) -> None:
    monkeypatch.setattr(simhash, "ALL_PAIRS", most)
    rng = np.random.default_rng(10)
    b = ["".join(rng.choice(list("abcdefghijklmnop"), 7)) for _ in range(120)]
    c = [*b[:60], "changed", *b[61:]]
    # texts of the same words in another order, and a template with unlike fillings beside two like ones
    rows = {0: " ".join(sorted(b)), 1: " ".join(b), 2: " ".join(c)}
    fill = lambda: ["".join(rng.choice(list("qrstuvwxyz"), 7)) for _ in range(60)]
    rows |= {10 + k: " ".join(b[:100] + fill()) for k in range(6)}
    rows[20] = rows[15] + " tail"
    links = [(x, y) for x in rows for y in rows if x < y and similar(rows[x], rows[y]) >= 0.8]
    assert links == [(1, 2), (15, 20)]
    got = simhash.near_groups(docs(spark, [(i, t, "en", "s") for i, t in rows.items()])).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == roots(links, rows)


def test_large_buckets_are_tried_whole(spark, monkeypatch) -> None:
    monkeypatch.setattr(simhash, "ALL_PAIRS", 2)
    monkeypatch.setattr(simhash, "SPLIT", 7)
    # one key that thirty sets share, in parts of seven, whose places forbid nothing
    rows = [(5, i % 4, i, 100, 100) for i in range(30)] + [(6, -1, 40, 100, 100), (6, -1, 41, 100, 50), (7, -1, 50, 10, 10), (7, -1, 51, 100, 100)]
    found = simhash._buckets(spark.createDataFrame(rows, "key long, part int, node long, n int, rest int"), 0.8).cache()
    first = {(r["a"], r["b"]) for r in found.where("a IS NOT NULL").collect()}
    assert first == {(i % 4, i) for i in range(4, 30)}
    large = found.where("a IS NULL").select("key", "nodes", "sizes", "rests")
    assert {(r["key"], n) for r in large.collect() for n in r["nodes"]} == {(5, i) for i in range(30)}
    sure = spark.createDataFrame([(i, i % 4) for i in range(28)], "node long, component long")
    parts = {i: i % 4 if i < 28 else i for i in range(30)}
    want = {(i, j) for i in range(30) for j in range(i + 1, 30) if parts[i] != parts[j]}
    same = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(104))) for i in range(30)], "node long, text string")
    assert {tuple(r) for r in simhash._apart(large, sure, same, 5, 0.8).collect()} == want
    # unlike texts are ruled out by their parities
    other = same.withColumn("text", F.concat(F.col("text"), F.repeat(F.concat(F.lit(" v"), "node"), 3))).withColumn("text", F.when(F.col("node") == 28, F.reverse("text")).otherwise(F.col("text")))
    assert {tuple(r) for r in simhash._apart(large, sure, other, 5, 0.8).collect()} == {p for p in want if 28 not in p}


@pytest.mark.parametrize(("sketch", "split", "all_pairs"), [(1 << 22, 20_000, 16), (256, 50, 16), (256, 10, 16), (64, 4, 2), (16, 2, 16)])
def test_no_link_is_lost_however_keys_are_dealt(spark, monkeypatch, sketch, split, all_pairs) -> None:
    monkeypatch.setattr(simhash, "SKETCH", sketch)
    monkeypatch.setattr(simhash, "SPLIT", split)
    monkeypatch.setattr(simhash, "ALL_PAIRS", all_pairs)
    monkeypatch.setattr(simhash, "SAMPLE", 2)
    rng = np.random.default_rng(21)
    texts = []
    for _ in range(150):
        base = [f"w{x}" for x in rng.integers(0, 900, 80)]
        more = list(base)
        more[int(rng.integers(0, 80))] = "new"
        texts += [" ".join(base), " ".join(more)]
    # passages that many texts share make keys of every number of members, lone ones of a part among them
    for size in (3, 17, 60, 120):
        shared = " ".join(f"s{size}x{x}" for x in range(60))
        texts += [f"{shared} u{size}v{i} u{size}w{i}" for i in range(size)]
    df = docs(spark, [(i, t, "en", "x") for i, t in enumerate(texts)])
    sets = [set(simhash.shingles(t, 5)) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(links) > 5000
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(df).collect()}
    assert got == roots(links, range(len(texts)))


def test_any_dealing_of_keys_keeps_every_pair(spark, monkeypatch) -> None:
    """Parts of every size, members alone in part 0 among them, however wrong the sample's guess was."""
    rng = np.random.default_rng(22)
    texts = spark.createDataFrame([(i, " ".join(f"w{x}" for x in range(104)) + f" e{i}") for i in range(40)], "node long, text string")
    monkeypatch.setattr(simhash, "ALL_PAIRS", 4)
    for parts in (1, 2, 3, 50):
        dealt = [(9, int(rng.integers(0, parts)), i, 101, 101) for i in range(40)] + [(8, -1, i, 101, 101) for i in range(40)]
        for key in (8, 9):
            found = simhash._buckets(spark.createDataFrame([r for r in dealt if r[0] == key], "key long, part int, node long, n int, rest int"), 0.8).cache()
            large = found.where("a IS NULL").select("key", "nodes", "sizes", "rests")
            none = spark.createDataFrame([], "node long, component long")
            tried = {tuple(r) for r in simhash._apart(large, none, texts, 5, 0.8).collect()} | {(r["a"], r["b"]) for r in found.where("a IS NOT NULL").collect()}
            assert tried == {(i, j) for i in range(40) for j in range(i + 1, 40)}


def test_parities_bound_the_difference(spark) -> None:
    rng = np.random.default_rng(15)
    texts = {}
    for i in range(0, 60, 2):
        base = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(1, 400)))]
        more = list(base)
        for at in rng.integers(0, len(base), len(base) // 12):
            more[at] = "new"
        texts[i], texts[i + 1] = " ".join(base), " ".join(more)
    sets = {i: set(simhash.shingles(t, 5)) for i, t in texts.items()}
    got = {r["node"]: int.from_bytes(r["parity"], "big") for r in simhash._parities(spark.createDataFrame(list(texts.items()), "node long, text string"), 5).collect()}
    assert all((got[a] ^ got[b]).bit_count() <= len(sets[a] ^ sets[b]) for a in texts for b in texts)


def test_ids_that_several_texts_share(spark) -> None:
    a, b = " ".join(f"left{i}" for i in range(40)), " ".join(f"right{i}" for i in range(40))
    rows = [(1, a, "en", "x"), (1, b, "en", "y"), (1, b, "en", "y"), (2, a + " more", "en", "z"), (None, b, "en", "z"), (None, None, "en", "z"), (None, "", "en", "z"), (3, "é " * 300_000, "fr", "z")]
    df = docs(spark, rows).withColumn("near_digest", F.lit(1))
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    assert got == sorted([(1, a), (1, b), (0, ""), (3, "é " * 300_000)])


# ---- 10 language


def test_language(spark, real) -> None:
    df = real.unionByName(docs(spark, [(1001, None, "en", "s"), (1002, "123 ...", "fr", "s"), (1003, "", None, "s")])).withColumn("score", F.lit(0))
    got = {r["doc_id"]: r for r in langid.report(df).collect()}
    truth = {r["doc_id"]: r["lang"] for r in real.select("doc_id", "lang").collect()}
    held = [i for i in truth if got[i]["held_out"]]
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) == got[i]["held_out"] for i in truth)
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in held]) > 0.97
    assert [got[i]["lang_pred"] for i in (1001, 1002, 1003)] == ["und"] * 3 and all(0 <= r["score"] <= 1 for r in got.values())
    none = langid.report(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in none.collect()} == {"und"} and langid.report(df.limit(0)).count() == 0


def test_language_of_symbols_beyond_the_first_plane(spark, real) -> None:
    grams = langid.Grams()
    assert len(grams.of("\U0001f600 \U0001f600")) == len(grams.of("\U0001d7d8 12. \U0001f680")) == 0
    assert len(grams.of("\U00010400\U00020000")) > 0 and (grams.of("ab \U0001f600 cd") == grams.of("ab 1 cd")).all()
    df = real.unionByName(docs(spark, [(1001, "\U0001f600 \U0001f600 3.", "en", "s")]))
    got = langid.report(df).where("doc_id = 1001").first()
    assert got["lang_pred"] == "und" and got["score"] == 0


def test_language_edges(spark, real, monkeypatch) -> None:
    long = "the house and the garden of " * 200_000
    df = real.unionByName(docs(spark, [(1001, long, None, "s"), (1001, long, None, "s"), (None, "\U00010400\U00010401", None, None), (1003, "\U0001d7d8\U0001f600", "fr", "s")]))
    got = [r for r in langid.report(df.withColumn("lang_pred", F.lit(1))).collect() if r["doc_id"] in (None, 1001, 1003)]
    assert len(got) == 4 and len({(r["lang_pred"], r["score"]) for r in got if r["doc_id"] == 1001}) == 1
    assert [r["lang_pred"] == "und" for r in sorted(got, key=lambda r: r["doc_id"] or 0)] == [False, False, False, True]
    # of too many languages the most frequent are learned
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 2)
    learned = real.where((langid.residue("doc_id", 4) != 2) & F.col("lang").isNotNull()).groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(2)
    assert {r["lang_pred"] for r in langid.report(real).collect()} - {"und"} <= {r["lang"] for r in learned.collect()}


def test_language_scores_against_a_plain_version(spark, real, texts) -> None:
    slim = real.where("lang IS NOT NULL").select("doc_id", "text", "lang")
    names, table, bias = model = langid.train(slim)
    assert (table == 0).mean() > 0.5
    for r in langid.predicted(slim.select("doc_id", "text"), model).limit(40).collect():
        text = "".join(c if c.isalpha() else " " for c in (texts[r["doc_id"]] or "").lower())
        text = " " + " ".join(text.split()) + " "
        s, n = np.zeros(len(names)), 0
        for k in langid.ORDERS:
            for i in range(len(text) - k + 1):
                h = k
                for c in text[i : i + k]:
                    h = (h ^ ord(c)) * 2654435761 % 2**32
                    h ^= h >> 15
                s += table[h % langid.DIMS]
                n += 1
        e = np.exp(s / n + bias - (s / n + bias).max())
        assert r["lang_pred"] == names[int(e.argmax())] and math.isclose(r["score"], e.max() / e.sum(), rel_tol=1e-6)


# ---- pipeline


def test_pipeline(spark, sf) -> None:
    import corpus_pipeline

    docs_, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    columns = docs_.columns
    for name, stage in corpus_pipeline.STAGES:
        docs_ = stage(spark, docs_, sf).cache()
        seen.append((name, docs_.count()))
        assert name == "pack" or docs_.columns == columns
    assert seen[0][1] >= seen[1][1] == seen[2][1] > 0
    # where documents are cut follows the partitions; what is packed of each does not
    packed = lambda df: sorted(map(tuple, df.groupBy("doc_id").agg(F.sum("length"), F.count_if(F.col("start") == 0), F.max("doc_tokens")).collect()))
    assert packed(corpus_pipeline.run(spark, sf)) == packed(docs_)
