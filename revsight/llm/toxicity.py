"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posterior labels.

1. Mining.  Words and word beginnings of four to six letters, and two or three words that share one, are hashed; over all
   marked learning documents each hash is counted with and without the mark, and what the likelihood-ratio test finds for
   the mark becomes a feature (at most ``FEATURES``, a table whose size does not depend on the input).
2. Voters.  The mined features are a lexicon in ``VOTERS`` levels, by how much likelier the mark makes them at least: the
   voter of a level fires on a document whose strongest feature is of that level or a higher one, so the silence of one
   voter says nothing against kinds of toxicity that others tell.  Every word of a fixed lexicon and every text pattern is
   a voter of its own, and a mark is one more, which is silent on unmarked documents.
3. Label model.  Two latent classes; within a class a voter's firing depends on one other voter, its parent in the tree of
   strongest class-conditional mutual information (Chow and Liu, 1968), and a mark is right at a rate of its own.  All
   rates, with them the voters' accuracies and correlations, are estimated by expectation maximisation over all learning
   documents: these are counted by votes and mark once, and every round sums a fixed number of moments over that table.
   The rate of the mark has a prior of ``MARK_RIGHT``, as heavy as the marks themselves, so the classes keep their meaning.
4. Classifier.  Logistic regression over the features is trained on the posterior labels of a sample, marked documents
   like others, by proximal gradient steps with an elastic net, and scores every whole text by its set of features.

The sample of step 4 holds at most about ``MARKED`` marked and ``UNMARKED`` unmarked documents, chosen by a hash of the id;
all other statistics cover all learning documents.  Only sums, features and the sample's rows of feature numbers reach the
driver.

Defined results: null and empty texts have no feature and get the score of the bias; several marks of one document count
as the largest; with no marks at all the lexicon alone votes; equal rows get equal scores whatever their ids; texts are
read whole, at any length; other columns are ignored whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialise, residue

BUCKETS = 1 << 20
BEGINNINGS = (4, 5, 6)
LEVELS = 3
MARKED, UNMARKED = 16_000, 8_000
FEATURES, VOTERS, LEAST_G, STRONGEST = 4096, 40, 11.0, 7.0
MARK_RIGHT, ROUNDS = 0.97, 20
CACHE = 300_000
_MODULUS = 1 << 31
_STRIP = ".,;:!?\"'()[]{}<>|*#$%&-_"

# Common insults that vote whatever the marks.
LEXICON = "idiot idiots moron morons loser losers stupid scum trash worthless pathetic disgusting clown dumb filthy vermin imbecile cretin scumbag".split()

# Text patterns, each tried on texts that have one of its words.
PATTERNS = (
    (LEXICON, re.compile(r"\b(you|they|those|these) (are|re) (all )?(a |an |such )?(%s)" % "|".join(LEXICON), re.I)),
    (["hate", "kill", "despise"], re.compile(r"\b(hate|kill|despise) (you|them|him|her|all)\b", re.I)),
    (["shut", "go", "get"], re.compile(r"\b(shut up|go away|get lost)\b", re.I)),
)


def level(h: int, n: int) -> int:
    """The hash that says: n + 1 distinct words of the text have the feature ``h``."""
    return (h + n * 246_511) % BUCKETS


class Words(dict):
    """Hashes of a word: itself and its beginnings; frequent words are cached."""

    def __missing__(self, given: str) -> tuple[int, ...]:
        word = given.strip(_STRIP)
        raw = word.encode("utf-8", "surrogatepass")
        out = {zlib.crc32(b"=" + raw) % BUCKETS, *(zlib.crc32(b"^" + word[:n].encode("utf-8", "surrogatepass")) % BUCKETS for n in BEGINNINGS if len(word) >= n)}
        found = self.keep(tuple(out)) if word else ()
        if len(self) < CACHE:
            self[given] = found
        return found

    def keep(self, found: tuple[int, ...]) -> tuple[int, ...]:
        return found

    def of(self, text: str | None) -> set[int]:
        """Features of a text: hashes of its distinct words, and how many words share one, up to ``LEVELS``."""
        if not text:
            return set()
        # most words have no feature that counts; their lookups stay in C
        told = {w.strip(_STRIP) for w in filter(self.__getitem__, set(text.lower().split()))}
        n = Counter(h for word in told for h in self[word])
        return {level(h, k) for h, c in n.items() for k in range(min(c, LEVELS))}


class Known(Words):
    """Only the features of a given table, as their numbers in it."""

    def __init__(self, table: list[int]):
        super().__init__()
        self.table = {h: i for i, h in enumerate(table)}
        self.bases = {(h - k * 246_511) % BUCKETS for h in table for k in range(LEVELS)}

    def keep(self, found: tuple[int, ...]) -> tuple[int, ...]:
        return tuple(h for h in found if h in self.bases)

    def of(self, text: str | None) -> set[int]:
        return {self.table[h] for h in super().of(text) if h in self.table}


def sampled(learning: DataFrame, marks: DataFrame, marked: int = MARKED, unmarked: int = UNMARKED) -> DataFrame:
    """About so many rows of the learning documents with and without a mark, with ``toxic`` or null."""
    ids = learning.select("doc_id").join(marks, "doc_id", "left").agg(F.count("toxic").alias("m"), F.count("*").alias("n")).first()
    rate = lambda most, n: int(min(1.0, most / max(1, n)) * _MODULUS)
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(_MODULUS))
    most = F.when(F.col("toxic").isNull(), rate(unmarked, ids["n"] - ids["m"])).otherwise(rate(marked, ids["m"]))
    # ids outside both rates are dropped before the join
    near = learning.where(draw < max(rate(unmarked, ids["n"] - ids["m"]), rate(marked, ids["m"])))
    return near.join(marks, "doc_id", "left").where(draw < most)


def marks_of(labels: DataFrame) -> DataFrame:
    """One row (doc_id, toxic 0 or 1) for each marked document."""
    return labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))


def levels(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """The level, from 1 to ``VOTERS``, of features on ``a`` of ``n1`` documents with the mark and ``b`` of ``n0`` without: a lower bound of their log ratio."""
    least = np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1)) - 1.645 * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    return np.clip(least / STRONGEST * VOTERS, 0, VOTERS - 1).astype(int) + 1


def mined(marked: DataFrame, most: int = FEATURES) -> tuple[list[int], list[int]]:
    """Hashes that the mark makes likelier, those of largest ratio first, and their levels, over all rows (text, toxic)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sums, rows = Words(), np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for text, mark in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[mark][np.fromiter(words.of(text), np.int64)] += 1
                rows[mark] += 1
        at = np.flatnonzero(sums.any(axis=0))
        # the last row counts documents
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(sums[1][at], rows[1])), pa.array(np.append(sums[0][at], rows[0]))], names=["h", "a", "b"])

    found = marked.select("text", "toxic").mapInArrow(run, "h long, a long, b long").groupBy("h").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    counts = materialise(found.where("h < 0 OR a > 1"), "toxicity-features")
    sizes = counts.where("h < 0").first()
    if sizes is None or not sizes["a"] or not sizes["b"]:
        return [], []
    n1, n0 = sizes["a"], sizes["b"]
    part = lambda k, n, other, m: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) * (n + m) / (n * (F.col(k) + F.col(other))))).otherwise(F.lit(0.0))
    rest = lambda k, n, other, m: F.when(F.col(k) < n, (n - F.col(k)) * F.log((n - F.col(k)) * (n + m) / (n * (n + m - F.col(k) - F.col(other))))).otherwise(F.lit(0.0))
    g = 2 * (part("a", n1, "b", n0) + part("b", n0, "a", n1) + rest("a", n1, "b", n0) + rest("b", n0, "a", n1))
    strong = counts.where((F.col("h") >= 0) & (F.col("a") * n0 > F.col("b") * n1)).withColumn("g", g).where(F.col("g") >= LEAST_G)
    out = strong.orderBy(F.col("g").desc(), "h").limit(most).select("h", "a", "b").collect()
    discard(counts)
    a, b = (np.array([r[c] for r in out], float) for c in ("a", "b"))
    return [r["h"] for r in out], levels(a, b, n1, n0).tolist()


def table_of(words: list[str]) -> list[int]:
    return [zlib.crc32(f"={w}".encode()) % BUCKETS for w in words]


N_VOTERS = VOTERS + len(LEXICON) + len(PATTERNS)


def votes_of(text: str | None, active: set[int], lexicon: list[int], level_of: list[int], triggers: list[set[int]]) -> int:
    """Bits of the voters that fire: levels of features, the lexicon's words and the patterns, whose words are given as features."""
    out = (1 << max((level_of[i] for i in active if i < len(level_of)), default=0)) - 1
    out |= sum(1 << VOTERS + i for i, at in enumerate(lexicon) if at in active)
    out |= sum(1 << VOTERS + len(LEXICON) + i for i, (at, (_, pattern)) in enumerate(zip(triggers, PATTERNS)) if text and not at.isdisjoint(active) and pattern.search(text))
    return out


def bits(votes: np.ndarray) -> np.ndarray:
    return (votes[:, None] >> np.arange(N_VOTERS) & 1).astype(float)


class LabelModel:
    """Latent class, voters in a tree within each class, and the mark."""

    def __init__(self, sums: np.ndarray):
        """``sums``: see :func:`moments`."""
        m = N_VOTERS
        both, (n, marked) = sums[: 2 * m * m].reshape(2, m, m), np.split(sums[2 * m * m :].reshape(2, 3), [1], axis=1)
        n, hits = n[:, 0], np.diagonal(both, axis1=1, axis2=2)
        self.prior = float(np.log((n[1] + 1) / (n[0] + 1)))
        # voters are taken to be right more often than not: pseudo-counts lean that way
        single = (hits + np.array([[0.05], [1.0]])) / (n[:, None] + 2.0)
        self.parent = self._tree(both, n)
        at, rows = np.maximum(self.parent, 0), np.arange(m)
        root = self.parent < 0
        joint, above = np.where(root, 0.0, both[:, rows, at]), np.where(root, 0.0, hits[:, at])
        #: Rate of firing by class, by whether the parent fires.
        self.rate = np.stack([(hits - joint + 2 * single) / (n[:, None] - above + 2), (joint + 2 * single) / (above + 2)], axis=1).clip(1e-9, 1 - 1e-9)
        held = marked.sum()
        right = np.array([1 - MARK_RIGHT, MARK_RIGHT])
        #: Chance of the mark 1 by class.
        self.mark = (marked[:, 1] + held / 2 * right + 1e-9) / (marked.sum(axis=1) + held / 2 + 2e-9) if held else right

    @staticmethod
    def _tree(both: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Parents in the spanning tree of largest mutual information within the classes; -1 for its root."""
        total, m = np.zeros(both.shape[1:]), both.shape[1]
        for s, k in zip(both, n):
            if k <= 0:
                continue
            p = np.diag(s) / k
            for x in (0, 1):
                for y in (0, 1):
                    q = {(1, 1): s, (1, 0): np.diag(s)[:, None] - s, (0, 1): np.diag(s)[None] - s, (0, 0): k - np.diag(s)[:, None] - np.diag(s)[None] + s}[x, y] / k
                    alone = np.outer(p if x else 1 - p, p if y else 1 - p)
                    total += k * np.where((q > 1e-12) & (alone > 1e-300), q * np.log(np.maximum(q, 1e-300) / np.maximum(alone, 1e-300)), 0.0)
        parent, best, open_ = np.full(m, -1), total[0].copy(), np.ones(m, bool)
        source, open_[0] = np.zeros(m, int), False
        while open_.any():
            i = int(np.where(open_, best, -np.inf).argmax())
            parent[i], open_[i] = source[i], False
            nearer = open_ & (total[i] > best)
            best[nearer], source[nearer] = total[i][nearer], i
        return parent

    def posterior(self, v: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Chance of class 1 of each row of ``v`` (rows x voters, 0 or 1); ``marks``: 0, 1 or -1 for none."""
        above = np.where(self.parent < 0, 0.0, v[:, np.maximum(self.parent, 0)])
        on, off = np.log(self.rate[1] / self.rate[0]), np.log((1 - self.rate[1]) / (1 - self.rate[0]))
        fired = v * on[0] + (1 - v) * off[0]
        s = self.prior + (fired + above * (v * on[1] + (1 - v) * off[1] - fired)).sum(axis=1)
        told = np.where(marks == 1, np.log(self.mark[1] / self.mark[0]), np.log((1 - self.mark[1]) / (1 - self.mark[0])))
        return 1 / (1 + np.exp(-np.clip(s + np.where(marks < 0, 0.0, told), -40, 40)))


def guessed(v: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Where the estimation starts: marks as they are mostly right, else whether the lexicon or a pattern fires."""
    return np.where(marks >= 0, np.where(marks > 0, MARK_RIGHT, 1 - MARK_RIGHT), np.where(v[:, VOTERS:].any(axis=1), 0.9, 0.02))


def moments(v: np.ndarray, marks: np.ndarray, n: np.ndarray, model: LabelModel | None) -> np.ndarray:
    """Sums over rows that stand for ``n`` documents each, by class: products of voters, documents, those marked 0 and 1."""
    q = guessed(v, marks) if model is None else model.posterior(v, marks)
    both, rest = [], []
    for w in ((1 - q) * n, q * n):
        both.append(((v * w[:, None]).T @ v).ravel())
        rest.append([w.sum(), w[marks == 0].sum(), w[marks == 1].sum()])
    return np.concatenate([*both, *map(np.array, rest)])


def label_model(counted: DataFrame, rounds: int = ROUNDS) -> LabelModel:
    """The model of all rows (votes long, mark int, n long) by expectation maximisation."""
    model, size = None, 2 * N_VOTERS * N_VOTERS + 6
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], model: LabelModel | None = model) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                votes, marks, n = (c.to_numpy() for c in batch.columns)
                total += moments(bits(votes), marks, n, model)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["at", "x"])

        sums = np.zeros(size)
        for r in counted.mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
            sums[r["at"]] = r["x"]
        last, model = model, LabelModel(sums)
        if last is not None and (last.parent == model.parent).all() and abs(last.rate - model.rate).max() < 1e-4:
            break
    return model


def classifier(rows: list[np.ndarray], q: np.ndarray, dims: int, l1: float = 2e-5, l2: float = 1e-5, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of logistic regression on soft labels, by accelerated proximal gradient steps."""
    if not rows:
        return np.zeros(dims), -2.0
    n = len(rows)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    at = np.concatenate(rows).astype(np.int64) if len(owner) else np.zeros(0, np.int64)
    w, bias = np.zeros(dims), float(np.log((q.sum() + 1) / (n - q.sum() + 1)))
    # the inverse frequency of a feature scales its step
    count = np.bincount(at, minlength=dims)[:dims]
    scale = 1 / (count / n + 1.0 / n)
    last, t = w.copy(), 1.0
    # so scaled, the loss bends by at most a quarter of the features that rows with the same feature have on average
    beside = np.bincount(at, np.bincount(owner, minlength=n)[owner], minlength=dims)[:dims] / np.maximum(count, 1)
    step = 4.0 / (1 + beside.max(initial=0))
    for _ in range(rounds):
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = w + (t - 1) / t2 * (w - last)
        s = np.bincount(owner, y[at], minlength=len(rows))[: len(rows)] + bias
        g = 1 / (1 + np.exp(-np.clip(s, -30, 30))) - q
        grad = np.bincount(at, g[owner], minlength=dims)[:dims] / n + l2 * y
        last, t = w, t2
        w = y - step * scale * grad
        w = np.sign(w) * np.maximum(np.abs(w) - step * scale * l1, 0)
        bias -= float(g.mean())
    return w, bias


class Sought:
    """What texts are searched for: the mined features, the lexicon and the words of the patterns, by their numbers."""

    def __init__(self, mined_table: list[int], level_of: list[int]):
        lex, asked = table_of(LEXICON), [table_of(words) for words, _ in PATTERNS]
        #: The classifier's features; words of patterns alone stand behind them.
        self.table = list(dict.fromkeys([*mined_table, *lex]))
        self.all = list(dict.fromkeys([*self.table, *(x for own in asked for x in own)]))
        self.level_of, self.width = level_of, len(self.table)
        self.lexicon, self.triggers = [self.all.index(h) for h in lex], [{self.all.index(h) for h in own} for own in asked]

    def found(self, docs: DataFrame) -> DataFrame:
        """``docs`` without ``text`` but with the features (at, in order) and votes of each row."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = Known(self.all)
            for batch in batches:
                at, votes = [], []
                for text in batch.column("text").to_pylist():
                    active = words.of(text)
                    at.append(sorted(x for x in active if x < self.width))
                    votes.append(votes_of(text, active, self.lexicon, self.level_of, self.triggers) if active else 0)
                kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n != "text"]
                yield pa.RecordBatch.from_arrays([*[c for _, c in kept], pa.array(at, pa.list_(pa.int32())), pa.array(votes, pa.int64())], names=[*[n for n, _ in kept], "at", "votes"])

        ddl = ", ".join([*[f"`{c}` {t}" for c, t in docs.dtypes if c != "text"], "at array<int>, votes long"])
        return docs.mapInArrow(run, ddl)


def _fitted(found: DataFrame, marks: DataFrame, sought: Sought, any_mined: bool) -> tuple[list[int], np.ndarray, float]:
    """The model of what was ``found`` (doc_id, at, votes) in all learning documents."""
    told = F.coalesce(F.col("toxic"), F.lit(-1)).alias("mark")
    counted = materialise(found.select("doc_id", "votes").join(marks, "doc_id", "left").groupBy("votes", told).agg(F.count("*").alias("n")), "toxicity-votes")
    model = label_model(counted)
    discard(counted)
    rows = sampled(found, marks).select("at", "votes", told).collect()
    rows = sorted(rows, key=lambda r: (r["at"], r["votes"], r["mark"]))
    q = model.posterior(bits(np.array([r["votes"] for r in rows], np.int64)), np.array([r["mark"] for r in rows], np.int64))
    w, bias = classifier([np.array(r["at"], dtype=np.int64) for r in rows], q, sought.width)
    if not any_mined:
        w = np.where(np.isin(np.arange(sought.width), sought.lexicon), np.maximum(w, 6.0), w)
        bias = min(bias, -2.0)
    return sought.table, w, bias


def _mined_of(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame, Sought, bool]:
    """(texts, marks, what to search for, whether the marks told a feature)."""
    docs = docs.withColumn("text", F.col("text").cast("string"))
    marks = materialise(marks_of(labels), "toxicity-marks")
    # always the same join: marks may be many, and texts move once
    table, level_of = mined(docs.where(residue("doc_id", 5) != 0).join(marks.hint("merge"), "doc_id"))
    return docs, marks, Sought(table, level_of), bool(table)


def learned(docs: DataFrame, labels: DataFrame) -> tuple[list[int], np.ndarray, float]:
    """(feature hashes, weights, bias) from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    docs, marks, sought, any_mined = _mined_of(docs.select("doc_id", "text"), labels)
    found = materialise(sought.found(docs.where(residue("doc_id", 5) != 0)), "toxicity-found")
    model = _fitted(found, marks, sought, any_mined)
    discard(found)
    discard(marks)
    return model


def _scores(sums: np.ndarray, bias: float) -> list[pa.Array]:
    p = 1 / (1 + np.exp(-np.clip(sums + bias, -60, 60)))
    return [pa.array(p), pa.array((p >= 0.5).astype(np.int32))]


def scored_found(found: DataFrame, model: tuple[list[int], np.ndarray, float]) -> DataFrame:
    """As :func:`scored`, from rows of :meth:`Sought.found`: no text is read."""
    _, w, bias = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("at")
            owner = np.repeat(np.arange(len(at)), at.value_lengths().to_numpy(zero_copy_only=False))
            # weights of a row are summed in the order of features
            sums = np.bincount(owner, w[at.flatten().to_numpy(zero_copy_only=False)], minlength=len(at)) if len(owner) else np.zeros(len(at))
            kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n not in ("at", "votes")]
            yield pa.RecordBatch.from_arrays([*[c for _, c in kept], *_scores(sums, bias)], names=[*[n for n, _ in kept], "score", "predicted"])

    ddl = ", ".join([*[f"`{c}` {t}" for c, t in found.dtypes if c not in ("at", "votes")], "score double, predicted int"])
    return found.mapInArrow(run, ddl)


def scored(df: DataFrame, model: tuple[list[int], np.ndarray, float], text: str = "text") -> DataFrame:
    """``df`` without ``text`` but with ``score`` and ``predicted``."""
    table, w, bias = model
    used = [h for h, x in zip(table, w) if x != 0]
    weight = [float(x) for x in w if x != 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Known(used)
        for batch in batches:
            s = np.array([sum(weight[i] for i in sorted(words.of(t))) for t in batch.column(text).to_pylist()], dtype=float)
            kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n != text]
            yield pa.RecordBatch.from_arrays([*[c for _, c in kept], *_scores(s, bias)], names=[*[n for n, _ in kept], "score", "predicted"])

    ddl = ", ".join([*[f"`{c}` {t}" for c, t in df.dtypes if c != text], "score double, predicted int"])
    return df.mapInArrow(run, ddl)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    slim = docs.select("doc_id", (residue("doc_id", 5) == 0).alias("held_out"), "text")
    slim, marks, sought, any_mined = _mined_of(slim, labels.select("doc_id", "toxic"))
    # texts are searched once, for the label model and the scores alike
    found = materialise(sought.found(slim), "toxicity-found")
    model = _fitted(found.where("NOT held_out").select("doc_id", "at", "votes"), marks, sought, any_mined)
    discard(marks)
    return scored_found(found, model)
