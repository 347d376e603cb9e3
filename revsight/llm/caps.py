"""Embedding near-duplicates by spherical-cap filters.

A filter is a direction; a vector belongs to every filter whose direction it exceeds a threshold with, and vectors that
share a filter are compared.  Directions are random product codes (Becker, Ducas, Gama and Laarhoven, 2016): the turned
space is cut into ``BLOCKS`` parts with some unit code words each, and a direction is any choice of one word per part.
Lists of all exceeding directions are decoded without trying them: sums over two halves are pruned by the best of the
other half.  The number of directions is a multiple of the number of vectors, so a filter
seldom holds vectors that are not alike, and filters with one member are dropped before vectors are moved; the threshold follows from
the wanted mean list length, and a vector with a shorter list than ``LEAST`` takes its best ``LEAST`` directions.

Equal vectors are grouped first.  Filters with more than ``SPLIT`` members are compared in pairs of blocks, each a group of
its own, so no task gathers a hot filter.  A pair that shares several filters is counted at the smallest only, which makes
counts of links additive, and a block yields a spanning forest of its links: output is linear in memberships, never in
pairs.

Defined results: rows whose vector is null, empty, zero or holds null or non-finite numbers, or whose id is null, link with
nothing; vectors of different lengths don't link; equal rows link with each other, and rows that share an id share a
component; labels and other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise
from .components import components

COSINE = 0.95
BLOCKS, TURNS, MEAN, LEAST = 4, 2, 24, 12
FILTERS_PER_VECTOR = 256
SPLIT = 1024
SEED = 20160


class Code:
    """Random product codes for vectors of one length."""

    def __init__(self, dims: int, words: int):
        self.dims, self.words = dims, words
        rng = np.random.default_rng([SEED, dims])
        self.blocks = min(BLOCKS, max(1, dims // 4))
        self.turns = [np.linalg.qr(rng.standard_normal((dims, dims)))[0] for _ in range(TURNS)]
        cuts = np.array_split(np.arange(dims), self.blocks)
        self.parts = [[(c, self._unit(rng.standard_normal((words, len(c))))) for c in cuts] for _ in range(TURNS)]
        # the threshold that a random direction passes with the wanted chance, from the law of one coordinate on the sphere
        share = min(0.5, MEAN / float(words) ** self.blocks)
        grid = np.linspace(-1, 1, 20001)
        density = np.maximum(1 - grid**2, 0) ** ((dims - 3) / 2) if dims > 3 else np.ones_like(grid)
        tail = np.cumsum(density[::-1])[::-1] / density.sum()
        self.least_sum = float(grid[np.argmax(tail <= share)]) * math.sqrt(self.blocks)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def lists(self, x: np.ndarray) -> list[np.ndarray]:
        """Sorted filter numbers of each unit vector (rows of ``x``)."""
        out: list[list[np.ndarray]] = [[] for _ in range(len(x))]
        half = (self.blocks + 1) // 2
        rows = max(1, 4_000_000 // self.words**half)
        for turn, (rotation, parts) in enumerate(zip(self.turns, self.parts)):
            for at in range(0, len(x), rows):
                y = x[at : at + rows] @ rotation
                dots = [y[:, c] @ code.T for c, code in parts]
                a, b = self._sums(dots[:half], len(y)), self._sums(dots[half:], len(y))
                top_a, top_b = a.max(axis=1), b.max(axis=1)
                for i in range(len(y)):
                    out[at + i].append(self._decode(a[i], b[i], top_a[i], top_b[i]) + turn * self.words**self.blocks)
        return [np.sort(np.concatenate(parts)) for parts in out]

    def _sums(self, dots: list[np.ndarray], n: int) -> np.ndarray:
        out = dots[0] if dots else np.zeros((n, 1))
        for d in dots[1:]:
            out = (out[:, :, None] + d[:, None, :]).reshape(len(d), -1)
        return out

    def _decode(self, a: np.ndarray, b: np.ndarray, top_a: float, top_b: float) -> np.ndarray:
        p, q = np.flatnonzero(a >= self.least_sum - top_b), np.flatnonzero(b >= self.least_sum - top_a)
        i, j = np.nonzero(a[p][:, None] + b[q] >= self.least_sum)
        if len(i) < LEAST:
            p = np.argpartition(-a, min(LEAST, len(a)) - 1)[:LEAST]
            q = np.argpartition(-b, min(LEAST, len(b)) - 1)[:LEAST]
            s = (a[p][:, None] + b[q]).ravel()
            best = np.argsort(-s, kind="stable")[:LEAST]
            i, j = best // len(q), best % len(q)
        return p[i].astype(np.int64) * len(b) + q[j]


def _coded(reps: DataFrame, words: int) -> DataFrame:
    kind = dict(reps.dtypes)["vec"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, Code] = {}
        for batch in batches:
            flat, sizes = batch.column("vec").flatten().to_numpy(zero_copy_only=False), np.array([len(v) for v in batch.column("vec")])
            ends = np.cumsum(sizes)
            lists: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sizes)
            for dims in np.unique(sizes):
                code = codes.setdefault(int(dims), Code(int(dims), words))
                own = np.flatnonzero(sizes == dims)
                x = np.stack([flat[e - dims : e] for e in ends[own]]).astype(np.float64)
                x /= np.abs(x).max(axis=1, keepdims=True)
                for i, got in zip(own, code.lists(x / np.linalg.norm(x, axis=1, keepdims=True))):
                    lists[i] = got + (int(dims) << 44)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int64()))], names=[*batch.schema.names, "filters"])

    return reps.mapInArrow(run, f"rep long, n long, vec {kind}, filters array<long>")


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    links, rest = [], near.any(axis=1)
    while rest.any():
        queue = [int(rest.argmax())]
        rest[queue[0]] = False
        while queue:
            x = queue.pop()
            found = np.flatnonzero(near[x] & rest)
            rest[found] = False
            links += [(x, int(y)) for y in found]
            queue += found.tolist()
    return links


def _shared_before(f: int, lists: list[np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For pairs (p, q) of members of filter f: whether they also share a smaller filter."""
    if len(p) <= 64:
        sets = {i: set(lists[i][: np.searchsorted(lists[i], f)].tolist()) for i in {*p.tolist(), *q.tolist()}}
        return np.array([not sets[a].isdisjoint(sets[b]) for a, b in zip(p.tolist(), q.tolist())], dtype=bool)
    own = [x[: np.searchsorted(x, f)] for x in lists]
    values, at, many = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(own)), [len(x) for x in own])
    keep = many[at] > 1
    number = np.cumsum(many > 1) - 1
    row, at, width = row[keep], number[at[keep]], int((many > 1).sum())
    out = np.zeros((len(own), len(own)), bool)
    for lo in range(0, width, 2048):
        here = (at >= lo) & (at < lo + 2048)
        m = np.zeros((len(own), min(2048, width - lo)), np.float32)
        m[row[here], at[here] - lo] = 1
        out |= m @ m.T > 0
    return out[p, q]


#: Groups of at most so many members are screened together before any is looked at on its own.
_FEW, _PAIRS = 16, 50_000


def _near(x: np.ndarray, p: np.ndarray, q: np.ndarray, cosine: float) -> np.ndarray:
    """Which pairs of rows of ``x`` reach the cosine; what is close to it is decided by one sum, the same in every group."""
    c = np.einsum("ij,ij->i", x[p], x[q])
    near = c >= cosine
    close = np.flatnonzero(np.abs(c - cosine) < 1e-9)
    near[close] = (x[p[close]] * x[q[close]]).sum(axis=1) >= cosine
    return near


def _promising(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray, cosine: float) -> np.ndarray:
    """Which groups of rows may hold a near pair: those of many members, and those of few in which one is near."""
    out = sizes > _FEW
    for size in range(2, _FEW + 1):
        own = np.flatnonzero(sizes == size)
        i, j = np.triu_indices(size, 1)
        for at in range(0, len(own), max(1, _PAIRS // len(i))):
            some = own[at : at + max(1, _PAIRS // len(i))]
            near = _near(x, (starts[some, None] + i).ravel(), (starts[some, None] + j).ravel(), cosine)
            out[some] = near.reshape(len(some), -1).any(axis=1)
    return out


def _compared(members: DataFrame, cosine: float) -> DataFrame:
    """Rows (a, b, w): with b null, w more links of a; else a link of the spanning forest."""

    def one(f: int, i: int, j: int, rep: np.ndarray, n: np.ndarray, block: np.ndarray, x: np.ndarray, lists: list[np.ndarray]) -> Iterator[tuple]:
        cosines = x @ x.T
        near = cosines >= cosine
        # a product's last digits depend on its shape
        p, q = np.nonzero(np.triu(np.abs(cosines - cosine) < 1e-9, 1))
        near[p, q] = near[q, p] = (x[p] * x[q]).sum(axis=1) >= cosine
        np.fill_diagonal(near, False)
        if i != j:
            near &= block[:, None] != block
        p, q = np.nonzero(np.triu(near))
        if not len(p):
            return
        first = ~_shared_before(f, lists, p, q)
        w = np.zeros(len(n), np.int64)
        np.add.at(w, p[first], n[q[first]])
        np.add.at(w, q[first], n[p[first]])
        yield from ((int(rep[k]), None, int(w[k])) for k in np.flatnonzero(w))
        yield from ((int(rep[a]), int(rep[b]), 0) for a, b in _forest(near))

    def keys_of(batch: pa.RecordBatch) -> np.ndarray:
        return np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("f", "i", "j")])

    def work(batch: pa.RecordBatch) -> Iterator[tuple]:
        """Whole groups: rows of one filter and pair of blocks lie together."""
        keys = keys_of(batch)
        starts = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
        sizes = np.diff(np.append(starts, batch.num_rows))
        rep, n, block = (batch.column(c).to_numpy() for c in ("rep", "n", "block"))
        vec, lists = batch.column("vec"), batch.column("filters")
        flat, offsets = vec.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.append(0, vec.value_lengths().to_numpy()))
        told, ends = lists.flatten().to_numpy(), np.cumsum(np.append(0, lists.value_lengths().to_numpy()))
        dims = np.diff(offsets)
        # a filter holds vectors of one length
        for d in np.unique(dims[starts]):
            groups = np.flatnonzero((dims[starts] == d) & (sizes > 1))
            if not len(groups):
                continue
            rows = np.concatenate([np.arange(starts[g], starts[g] + sizes[g]) for g in groups])
            x = flat[offsets[rows, None] + np.arange(d)].astype(np.float64)
            x /= np.abs(x).max(axis=1, keepdims=True)
            x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
            at = np.cumsum(sizes[groups]) - sizes[groups]
            for k in np.flatnonzero(_promising(x, at, sizes[groups], cosine)):
                own = rows[at[k] : at[k] + sizes[groups[k]]]
                f, i, j = keys[:, own[0]].tolist()
                yield from one(f, i, j, rep[own], n[own], block[own], x[at[k] : at[k] + len(own)], [told[ends[r] : ends[r + 1]] for r in own])

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*out)) or [(), (), ()])], names=["a", "b", "w"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            keys = keys_of(whole)
            same = (keys == keys[:, -1:]).all(axis=0)
            # the last group may go on in the next batch
            cut = whole.num_rows - int(same.sum())
            if cut:
                yield made(list(work(whole.slice(0, cut))))
            held = whole.slice(cut)
        if held is not None:
            yield made(list(work(held)))

    return members.mapInArrow(run, "a long, b long, w long")


def linked(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of ``df``."""
    e = F.col(embedding).cast("array<double>")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    usable = F.coalesce(fine, F.lit(False)) & F.col(vec_id).isNotNull()
    rows = materialise(df.select(F.col(vec_id).alias("vec_id"), F.when(usable, F.xxhash64(e)).alias("h"), F.when(usable, F.hash(e)).alias("g")), "vectors")
    # vectors keep the type they came in, which the exact cosine is taken from
    kept = F.col(embedding) if dict(df.dtypes)[embedding] in ("array<float>", "array<double>") else e
    good = df.where(usable).select(F.col(vec_id).cast("long").alias("id"), kept.alias("vec"), e.alias("key"))
    reps = good.groupBy(F.xxhash64("key").alias("h"), F.hash("key").alias("g")).agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("vec").alias("vec"))
    reps = materialise(reps, "reps")
    words = max(2, math.ceil((FILTERS_PER_VECTOR * max(1, reps.count())) ** (1 / BLOCKS)))
    coded = materialise(_coded(reps.select("rep", "n", "vec"), words), "coded")
    owned = coded.select("rep", F.explode("filters").alias("f"))
    sizes = owned.groupBy("f").agg(F.count("*").alias("size")).where("size > 1")
    # only filters that some other vector shares matter, and only vectors in one move
    shared = materialise(owned.join(sizes, "f"), "shared")
    lists = shared.groupBy("rep").agg(F.sort_array(F.collect_list("f")).alias("filters"))
    dealt = shared.withColumn("blocks", F.ceil(F.col("size") / SPLIT).cast("int")).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("rep", "f", "block", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"))
    members = dealt.join(coded.select("rep", "n", "vec").join(lists, "rep"), "rep").select("f", "i", "j", "rep", "n", "block", "vec", "filters")
    compared = materialise(_compared(members.repartition("f", "i", "j").sortWithinPartitions("f", "i", "j"), cosine), "compared")
    counts = compared.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("w").alias("w"))
    comp = components(compared.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "rep")
    named = reps.select("h", "g", "rep", "n").join(counts, "rep", "left").join(comp, "rep", "left")
    named = materialise(named.select("h", "g", (F.coalesce("w", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "named")
    out = rows.join(named, ["h", "g"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", F.col("vec_id").cast("long")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def report(df: DataFrame) -> DataFrame:
    return linked(df)
