"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Letters are lower-cased, everything else becomes one space, and n-grams of two and three code points are hashed into
``DIMS`` columns; a text's term frequencies are shares of its n-grams.  Document frequencies are counted over all
learning documents.  The regression is trained with follow-the-regularised-leader (McMahan et al., 2013) under an
elastic-net penalty on a sample of at most about ``PER_LANGUAGE`` documents a language, chosen by a hash of their id; a
fifth of that sample fits the temperature that calibrates scores (Guo et al., 2017).  Every document is then scored over
its whole text by one table of weights, of DIMS x languages numbers whatever the input.

Defined results: null texts and texts without a letter, which any alphabet's letters of any plane are, are ``und`` with
score 0; a table without learned languages gives ``und`` throughout; equal rows get equal results, ties go to the first
language in code-point order; texts are read whole, at any length; other columns are ignored whatever their names; an empty
table gives an empty result.  Of more than ``MOST_LANGUAGES`` different values of ``lang`` the most frequent are learned, ties
in code-point order, so that the model keeps its size; documents are predicted among those whatever their own value is.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise, residue

DIMS = 1 << 16
ORDERS = (2, 3)
PER_LANGUAGE = 1024
MOST_LANGUAGES = 1000
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.3, 1.0, 0.02, 0.01
UNKNOWN = "und"
_MODULUS = 1 << 31
_SLICE = 1 << 18


class Grams:
    """Hashed character n-grams of a text."""

    def __init__(self) -> None:
        self.letter = np.array([chr(i).isalpha() for i in range(sys.maxunicode + 1)], dtype=bool)

    def of(self, text: str | None) -> np.ndarray:
        """Column of every n-gram of the text, repeats included; empty without a letter."""
        if not text:
            return np.zeros(0, np.int64)
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        letters = self.letter[codes]
        if not letters.any():
            return np.zeros(0, np.int64)
        codes = np.where(letters, codes, 32).astype(np.uint32)
        keep = np.ones(len(codes), bool)
        keep[1:] = letters[1:] | letters[:-1]
        codes = np.concatenate([[32], codes[keep], [32]]).astype(np.uint32)
        out = []
        for n in ORDERS:
            h = np.full(max(0, len(codes) - n + 1), n, np.uint32)
            for i in range(n):
                h = (h ^ codes[i : i + len(h)]) * np.uint32(2654435761)
                h ^= h >> np.uint32(15)
            out.append(h % np.uint32(DIMS))
        return np.concatenate(out).astype(np.int64)


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Document frequency of every column over all rows of ``docs`` (text), and how many rows have a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, total, n = Grams(), np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if len(found := grams.of(text)):
                    seen = np.zeros(DIMS, bool)
                    seen[found] = True
                    total += seen
                    n += 1
        if n:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], names=["at", "n"])

    rows = docs.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(DIMS + 1, np.int64)
    for r in rows:
        out[r["at"]] = r["n"]
    return out[:-1], int(out[-1])


def sampled(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], DataFrame]:
    """The languages of ``docs`` (doc_id, text, lang), in order, and about ``per_language`` rows of each, by a hash of the id."""
    frequent = docs.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(MOST_LANGUAGES)
    counts = {r["lang"]: r["n"] for r in frequent.collect()}
    names = sorted(counts)
    if not names:
        return [], docs
    place = F.create_map(*[x for name in names for x in (F.lit(name), F.lit(int(min(1.0, per_language / counts[name]) * _MODULUS)))])
    draw = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(_MODULUS))
    return names, docs.where(draw < F.try_element_at(place, F.col("lang"))).withColumn("fit", F.pmod(F.xxhash64(F.lit("split"), "doc_id"), F.lit(5)) > 0)


class Ftrl:
    """Multinomial logistic regression by FTRL-proximal with an elastic net; the bias column bears no penalty."""

    def __init__(self, dims: int, classes: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros((dims + 1, classes)), np.zeros((dims + 1, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def step(self, at: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        """One example: columns ``at`` with values ``x``; ``y``: the target share of each class."""
        at, x = np.append(at, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(at)
        p = softmax((x @ w)[None])[0]
        g = x[:, None] * (p - y)
        root = np.sqrt(self.n[at])
        self.n[at] += g * g
        self.z[at] += g - (np.sqrt(self.n[at]) - root) / self.alpha * w


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The divisor of scores with the least log loss, by golden-section search over its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        return -np.log(softmax(scores / np.exp(t))[np.arange(len(y)), y] + 1e-300).mean()

    a, b, r = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, epochs: int = EPOCHS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, table of DIMS x languages, bias), calibrated, from ``docs``: doc_id, text, lang (not null)."""
    df, n = frequencies(docs)
    idf = np.log((1 + n) / (1 + df)) + 1
    names, sample = sampled(docs, per_language)
    if not names or not n:
        return [], np.zeros((DIMS, 0), np.float32), np.zeros(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            found = [np.unique(grams.of(t), return_counts=True) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), batch.column("fit"), pa.array([a.astype(np.uint16).tobytes() for a, _ in found], pa.binary()), pa.array([c.astype(np.uint32).tobytes() for _, c in found], pa.binary())],
                names=["doc_id", "lang", "fit", "at", "n"],
            )

    made = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "fit").mapInArrow(run, "doc_id long, lang string, fit boolean, at binary, n binary")
    rows = materialise(made, "langid-sample").where(F.length("at") > 0).orderBy(F.xxhash64(F.lit("order"), "doc_id"), "lang", "at").toLocalIterator()
    fit, held = [], []
    for r in rows:
        at, c = np.frombuffer(r["at"], np.uint16).astype(np.int64), np.frombuffer(r["n"], np.uint32).astype(np.float64)
        x = (c / c.sum() * idf[at]).astype(np.float32)
        (fit if r["fit"] else held).append((at.astype(np.uint16), x / np.sqrt((x * x).sum()), names.index(r["lang"]), 1.0 / np.sqrt((x * x).sum())))
    fit, held = (fit or held), (held if fit else [])
    scale = float(np.median([s for *_, s in fit])) if fit else 1.0
    model, eye = Ftrl(DIMS, len(names)), np.eye(len(names))
    for _ in range(epochs):
        for at, x, y, s in fit:
            model.step(at.astype(np.int64), x * (scale / s), eye[y])
    w = model.weights()
    table, bias = (w[:-1] * idf[:, None] * scale).astype(np.float32), w[-1]
    scores = np.array([(x * (scale / s)) @ w[at.astype(np.int64)] + bias for at, x, _, s in held]).reshape(-1, len(names))
    t = temperature(scores, np.array([y for _, _, y, _ in held], dtype=int))
    return names, table / np.float32(t), bias / t


def predicted(df: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text: str = "text") -> DataFrame:
    """``df`` (text last) with ``lang_pred`` and ``score`` for each row."""
    names, table, bias = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            said, sure = [], []
            for value in batch.column(text).to_pylist():
                at = grams.of(value)
                if not len(at) or not names:
                    said.append(UNKNOWN)
                    sure.append(0.0)
                    continue
                s = sum((table[at[i : i + _SLICE]].sum(axis=0, dtype=np.float64) for i in range(0, len(at), _SLICE)), np.zeros(len(names)))
                p = softmax((s / len(at) + bias)[None])[0]
                said.append(names[int(p.argmax())])
                sure.append(float(p.max()))
            kept = [c for c, n in zip(batch.columns, batch.schema.names) if n != text]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(said, pa.string()), pa.array(sure, pa.float64())], names=[*[n for n in batch.schema.names if n != text], "lang_pred", "score"])

    ddl = ", ".join([*[f"`{c}` {t}" for c, t in df.dtypes if c != text], "lang_pred string", "score double"])
    return df.mapInArrow(run, ddl)


def report(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score; learned from the documents that are not held out."""
    slim = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    held = residue("doc_id", 4) == 2
    model = train(slim.where(~held & F.col("lang").isNotNull()))
    return predicted(slim.select("doc_id", held.alias("held_out"), "text"), model)
