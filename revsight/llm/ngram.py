"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, stored as sorted hash arrays, memory-mapped to score.

Words first: tasks count the XXH64 of a block's words, shards (ranges of the hash) sum them up and write sorted arrays.
Words are numbered by them, those of like frequency together, frequent ones first.  Grams next: tasks turn texts into word
numbers by these arrays, count the n-grams of a block and send each once, with its words, to the shard of its context's
64-bit hash.  A shard writes its grams' sorted hashes and counts and the sums of each context, and hands on each gram
without its first word, counted once (the distinct words before it).  Lower levels repeat this.  A context seen once is not
stored: that it was seen at all shows in the grams of the level below.  Counts are of any size: arrays take as many bytes
as their largest number needs.

Files lie in ``folder``, which driver and workers must share and be able to map (a mounted file system; by default the
session's checkpoint folder).  They are written beside their place and renamed, and hold the same bytes whenever a task runs
again.  Only counts of counts and the number of words of each shard reach the driver; the number of shards follows the
bytes of text.  A shard of a table is one file, and a worker maps a bounded number of them.

With c the count of a gram, for the highest order and for grams from a text's start as they occur, else the number of
distinct words before it, T the sum of c over a context, N1, N2, N3+ the context's grams with such counts and D1, D2, D3+
the discounts of Chen and Goodman (1999): p(w | context) = max(0, c - D) / T + (D1 N1 + D2 N2 + D3 N3+) / T * p(w | context
without its first word), down to 1 / (V + 1), which also is what an unknown word keeps.  A context that never occurred is
left out.  Contexts run from a text's start mark to its last word; the end mark is a token.

Defined results: null and empty texts are the end mark alone; equal rows get equal scores; with no training text every
token gets probability 1; an empty table gives an empty result; other columns of the scored table are kept.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import discard, materialise, partitions, residue, scratch_root, tidy, words_of

ORDER = 3
END = np.uint64(0xC2B2AE3D27D4EB4F)
#: Numbers that stand for no word, for a text's start, for the first word, and for a word that was never seen.
NONE, START, FIRST, UNSEEN = (np.uint64(x) for x in (0, 1, 2, 2**64 - 1))
BLOCK, CACHE, SHARD_BYTES = 1_000_000, 200_000, 128 << 20
_CLASSES = 64
_TOP = np.uint64(32)


class Words(dict):
    """Places of words in the order in which they come, the end mark first; forgotten when they get too many."""

    def __init__(self) -> None:
        super().__init__()
        self.clear()

    def clear(self) -> None:
        super().clear()
        #: Hashes of the words, and what a caller found for those it has looked up.
        self.hashes: list[int] = [int(END)]
        self.found: list[np.ndarray] = []

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return at

    def of(self, text: str | None) -> np.ndarray:
        """Places of a text's tokens with the end mark."""
        words = words_of(text)
        out = np.zeros(len(words) + 1, np.int64)
        out[:-1] = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return out

    def look_up(self, find: Callable[[np.ndarray], list[np.ndarray]]) -> list[np.ndarray]:
        """What ``find`` gives for the hash of each word; only new ones are sought."""
        new = np.array(self.hashes[len(self.found[0]) if self.found else 0 :], np.uint64)
        if len(new):
            got = find(new)
            self.found = [np.concatenate(x) for x in zip(self.found, got)] if self.found else got
        return self.found


def key_of(columns: list[np.ndarray] | np.ndarray) -> np.ndarray:
    """64-bit hash of each row of word numbers."""
    h = np.full(len(columns[0]), len(columns), np.uint64)
    for c in columns:
        h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return h


def grams_of(numbers: np.ndarray, sizes: np.ndarray, order: int) -> list[np.ndarray]:
    """For every token of texts laid end to end: the ``order - 1`` words before it in its text, then itself."""
    at = np.arange(len(numbers)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = [numbers]
    for k in range(1, order):
        before = np.full(len(numbers), NONE, np.uint64)
        before[k:] = numbers[:-k] if k < len(numbers) else numbers[:0]
        out.insert(0, np.where(at >= k, before, np.where(at == k - 1, START, NONE)))
    return out


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of numbers, bytes of like weight together, compressed."""
    import zstandard

    raw = np.stack([np.asarray(c).astype("<u8") for c in columns])
    return len(raw[0]).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1)).tobytes())


def unpack(blobs: list[bytes], columns: int) -> np.ndarray:
    """The columns of all blobs, one after another."""
    import zstandard

    sizes = [int.from_bytes(b[:8], "little") for b in blobs]
    out, at = np.empty((columns, sum(sizes)), "<u8"), 0
    for blob, n in zip(blobs, sizes):
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(memoryview(blob)[8:]), np.uint8).reshape(columns, 8, n)
        out[:, at : at + n] = np.ascontiguousarray(raw.transpose(0, 2, 1)).view("<u8")[..., 0]
        at += n
    return out


def merged(keys: np.ndarray, sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Sorted distinct keys, where each first stands, and the sums of each column over equal keys."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], order[first], [np.add.reduceat(c[order], first) if len(first) else c for c in sums]


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of keys."""
    return (((keys >> _TOP) * np.uint64(shards)) >> _TOP).astype(np.int64)


def split(place: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The slice of each value of a sorted array."""
    cuts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1], [True]])) if len(place) else np.zeros(1, int)
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(place[a]), slice(a, b)


def save(folder: str, name: str, array: np.ndarray) -> None:
    path = f"{folder}/{name}"
    part = f"{path}.{uuid.uuid4().hex}"
    array.tofile(part)
    os.replace(part, path)


#: Shards of a table that a worker maps at a time; a process may hold some 65,000 maps in all.
MAPS = 512


class Table:
    """Sorted keys and columns of whole numbers, one file for each shard, of which ``maps`` are mapped at a time."""

    def __init__(self, folder: str, name: str, columns: tuple[str, ...], shards: int, maps: int = MAPS):
        self.folder, self.name, self.columns, self.shards, self.maps = folder, name, columns, shards, maps
        self.parts: dict[int, tuple[np.ndarray, list[np.ndarray]]] = {}

    def write(self, shard: int, keys: np.ndarray, columns: list[np.ndarray]) -> None:
        """Number of keys and bytes of each column's numbers, then the keys and the columns, each from a multiple of eight on."""
        narrow = [c.astype(np.min_scalar_type(int(c.max())) if len(c) else "<u1") for c in columns]
        head = np.array([len(keys), *[c.itemsize for c in narrow]], "<u8")
        padded = lambda c: np.frombuffer(c.tobytes() + bytes(-c.nbytes % 8), np.uint8)
        save(self.folder, f"{self.name}-{shard}", np.concatenate([padded(c) for c in (head, keys.astype("<u8"), *narrow)]))

    def _mapped(self, shard: int) -> tuple[np.ndarray, list[np.ndarray]]:
        path = f"{self.folder}/{self.name}-{shard}"
        if not os.path.exists(path):
            return np.zeros(0, "<u8"), [np.zeros(0, "<u8") for _ in self.columns]
        raw = np.memmap(path, np.uint8, "r")
        at = 8 * (1 + len(self.columns))
        n, *widths = raw[:at].view("<u8").tolist()
        out = []
        for width in (8, *widths):
            out.append(raw[at : at + n * width].view(f"<u{width}"))
            at += n * width + -n * width % 8
        return out[0], out[1:]

    def part(self, shard: int) -> tuple[np.ndarray, list[np.ndarray]]:
        held = self.parts.get(shard)
        if held is None:
            # look-ups come by shard, so what was mapped first is asked for again last
            while len(self.parts) >= self.maps:
                del self.parts[next(iter(self.parts))]
            held = self.parts[shard] = self._mapped(shard)
        return held

    def get(self, sought: np.ndarray, by: np.ndarray | None = None) -> list[np.ndarray]:
        """Columns of each key, 0 where it is not there; ``by``: the keys that shards are told from, if not the same."""
        order = np.argsort(sought)
        place = shard_of(sought if by is None else by, self.shards).astype(np.min_scalar_type(self.shards))[order]
        if by is not None:
            again = np.argsort(place, kind="stable")
            order, place = order[again], place[again]
        out = [np.zeros(len(sought), np.int64) for _ in self.columns]
        for s, own in split(place):
            keys, values = self.part(s)
            if len(keys):
                rows = order[own]
                mine = sought[rows]
                at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
                same = keys[at] == mine
                rows, at = rows[same], at[same]
                for column, value in zip(out, values):
                    column[rows] = value[at]
        return out


def _tables(model: dict) -> tuple[Table, list[Table], list[Table]]:
    """Words, grams by length, contexts by the length of their grams."""
    at = model["folder"], model["shards"]
    own = lambda name, *columns: Table(at[0], name, columns, at[1])
    lengths = range(1, model["order"] + 1)
    return own("word", "count", "place"), [own(f"gram{k}", "count") for k in lengths], [own(f"context{k}", "total", "one", "two", "more") for k in lengths]


def _base(model: dict) -> np.ndarray:
    """The number of each class's first word in each shard."""
    return np.memmap(f"{model['folder']}/base", "<i8", "r", shape=(_CLASSES, model["shards"]))


def _folder(spark: SparkSession, given: str | None) -> str:
    root = given or scratch_root(spark)
    if "://" in root and not root.startswith("file://"):
        raise ValueError("the model's folder must be on a file system that workers can map; pass folder=")
    return f"{root.removeprefix('file://').removeprefix('file:')}/ngram-{uuid.uuid4().hex}"


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of items with count 1 to 4; absolute defaults where a count is missing."""
    n1, n2, n3, n4 = n
    if n1 == 0 or n2 == 0:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw))  # type: ignore[return-value]


def _class(counts: np.ndarray) -> np.ndarray:
    """Frequency classes, the most frequent words first."""
    return _CLASSES - np.frexp(counts.astype(float))[1]


def _numbered(words: Table, base: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's number and count; ``base``: the number of each class's first word in each shard."""
    count, place = words.get(hashes)
    known = count > 0
    number = base[_class(np.maximum(count, 1)), shard_of(hashes, words.shards)] + place
    return np.where(known, number.astype(np.uint64) + FIRST, UNSEEN), count


def _blocks(batches: Iterator[pa.RecordBatch], words: Words) -> Iterator[list[np.ndarray]]:
    """Tokens of texts, in the first column, as places in ``words``, about ``BLOCK`` tokens at a time."""
    parts, held = [], 0
    for batch in batches:
        for text in batch.column(0):
            parts.append(words.of(text.as_py()))
            held += len(parts[-1])
            if held >= BLOCK:
                yield parts
                parts, held = [], 0
                if len(words) > CACHE:
                    words.clear()
    if parts:
        yield parts


_BLOBS = "kind string, length int, shard int, blob binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["kind", "length", "shard", "blob"])


def _sent(kind: str, length: int, by: np.ndarray, columns: list[np.ndarray], shards: int) -> list[tuple]:
    """A blob of rows for each shard; rows of like first columns lie together, which makes blobs small."""
    place = shard_of(by, shards)
    order = np.lexsort((columns[0], place))
    return [(kind, length, s, pack([c[order[own]] for c in columns])) for s, own in split(place[order])]


def _grams_sent(length: int, columns: list[np.ndarray], counts: np.ndarray, shards: int) -> list[tuple]:
    """Grams go to the shard of their context, single words to their own."""
    return _sent("gram", length, key_of(columns[:-1] if length > 1 else columns), [*columns, counts], shards)


def train(docs: DataFrame, folder: str | None = None, shards: int | None = None, order: int = ORDER) -> dict:
    """Count ``docs`` (one column, text) and store the model of that order, 2 at least; returns what :func:`scored` needs."""
    spark = docs.sparkSession
    text = docs.columns[0]
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text).cast("string"))), F.lit(0))).first()[0]
    model = {"folder": _folder(spark, folder), "shards": shards or max(partitions(spark), size // SHARD_BYTES + 1), "order": order}
    os.makedirs(model["folder"], exist_ok=True)
    shards = model["shards"]

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sums = Words(), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            keys = np.array(words.hashes, np.uint64)
            return _batch(_sent("word", 0, keys, [keys, sums], shards))

        for parts in _blocks(batches, words):
            counts = np.bincount(np.concatenate(parts), minlength=len(words.hashes))
            counts[: len(sums)] += sums
            sums = counts
            if len(words) > CACHE:
                yield out()
                sums = np.zeros(0, np.int64)
                words.clear()
        if len(sums):
            yield out()

    def keep_words(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys, counts = unpack(list(rows.blob), 2)
        keys, _, (counts,) = merged(keys, [counts.astype(np.int64)])
        own = _class(counts)
        order = np.argsort(own, kind="stable")
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys)) - np.searchsorted(own[order], own[order])
        _tables(model)[0].write(int(key[0]), keys, [counts, place])
        return pd.DataFrame({"shard": [int(key[0])], "words": [np.bincount(own, minlength=_CLASSES)], "tokens": [int(counts.sum())]})

    with tidy(spark):
        found = docs.mapInArrow(count_words, _BLOBS).groupBy("shard").applyInPandas(keep_words, "shard int, words array<long>, tokens long").collect()
    held = np.zeros((_CLASSES, shards), np.int64)
    for r in found:
        held[:, r["shard"]] = r["words"]
    # numbers of each class's first word by shard: a table that grows with shards, so workers map it too
    save(model["folder"], "base", (np.cumsum(held) - held.ravel()).reshape(held.shape))
    model |= {"tokens": sum(r["tokens"] for r in found), "types": int(held.sum()), "discounts": [(0.5, 0.5, 0.5)] * order, "total": 0, "aside": 0.0}
    if not model["tokens"]:
        return model

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, words, base = _tables(model)[0], Words(), _base(model)
        for parts in _blocks(batches, words):
            (numbers,) = words.look_up(lambda hashes: [_numbered(table, base, hashes)[0]])
            grams = grams_of(numbers[np.concatenate(parts)], np.array([len(p) for p in parts]), order)
            _, first, (counts,) = merged(key_of(grams), [np.ones(len(grams[0]), np.int64)])
            yield _batch(_grams_sent(order, [g[first] for g in grams], counts, shards))

    def keep_grams(length: int):  # noqa: ANN202
        def keep(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            got = unpack(list(rows.blob), length + 1)
            keys, first, (counts,) = merged(key_of(got[:length]), [got[length].astype(np.int64)])
            words = got[:length, first]
            del got
            whole = words[0] != NONE
            c, shard = counts[whole], int(key[0])
            _, grams, contexts = _tables(model)
            grams[length - 1].write(shard, keys[whole], [c])
            facts = [c.sum(), *[(c == k).sum() for k in (1, 2, 3, 4)], (c > 2).sum()]
            out = [("fact", length, -1, pack([np.array([x]) for x in facts]))]
            if length > 1:
                at, _, sums = merged(key_of(words[:-1, whole]), [c, *[x.astype(np.int64) for x in (c == 1, c == 2, c > 2)]])
                often = sums[0] > 1
                contexts[length - 1].write(shard, at[often], [x[often] for x in sums])
                # grams from a text's start keep their count, others count once for the word before
                _, first, (sums,) = merged(key_of(words[1:]), [np.where(whole, 1, counts)])
                out += _grams_sent(length - 1, [*words[1:, first]], sums, shards)
            return pd.DataFrame(out, columns=["kind", "length", "shard", "blob"])

        return keep

    grams = docs.mapInArrow(count_grams, _BLOBS)
    for length in range(order, 0, -1):
        step = materialise(grams.groupBy("shard").applyInPandas(keep_grams(length), _BLOBS), "ngram")
        if length < order:
            discard(last)
        last, grams = step, step.where("kind = 'gram'")
        facts = sum(unpack([bytes(r["blob"])], 6)[:, 0].astype(np.int64) for r in step.where("kind = 'fact'").select("blob").toLocalIterator())
        model["discounts"][length - 1] = _discounts(facts[1:5].tolist())
    discard(last)
    # what the lowest level sets aside, spread evenly over the V + 1 words
    d = model["discounts"][0]
    model["total"] = int(facts[0])
    model["aside"] = float(d[0] * facts[1] + d[1] * facts[2] + d[2] * facts[5]) / model["total"] / (model["types"] + 1)
    return model


def _less(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    """Counts after their discount."""
    return counts - np.array([0.0, *d])[np.minimum(counts, 3)]


def scored(df: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``df`` without ``text`` but with n_tokens, n_known, train_tokens, base_score and score."""
    seen, types, order = model["tokens"], model["types"], model["order"]
    kept = [c for c in df.columns if c != text]
    slim = df.select(F.col(text).cast("string"), *kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        table, grams, contexts = _tables(model)
        firsts = _base(model)
        at_start = [c[0] for c in contexts[1].get(key_of([np.array([START])]))] if seen else []

        def find(hashes: np.ndarray) -> list[np.ndarray]:
            numbers, count = _numbered(table, firsts, hashes)
            if not seen:
                return [numbers, count]
            key = key_of([numbers])
            return [numbers, count, grams[0].get(key)[0], *contexts[1].get(key)]

        def block(parts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
            sizes, at = np.array([len(p) for p in parts]), np.concatenate(parts)
            starts = np.cumsum(sizes) - sizes
            add = lambda x: np.add.reduceat(x, starts)
            numbers, count, *found = words.look_up(find)
            known, base = add((count > 0).astype(np.int64)[at]), add(np.log10((count + 1) / (seen + types + 1))[at])
            if not seen:
                return sizes, known, np.zeros(len(sizes)), np.zeros(len(sizes))
            columns = grams_of(numbers[at], sizes, order)
            p = (_less(found[0], model["discounts"][0]) / model["total"] + model["aside"])[at]
            before = np.roll(at, 1)
            first = np.zeros(len(at), bool)
            first[starts] = True
            # a gram's context was seen if the gram of the level below that ends one word before was
            seen_before = first | (count > 0)[before]
            for k in range(2, order + 1):
                d, own = model["discounts"][k - 1], columns[order - k :]
                context = key_of(own[:-1])
                sums = [np.where(first, x, c[before]) for x, c in zip(at_start, found[1:])] if k == 2 else contexts[k - 1].get(context)
                hits = grams[k - 1].get(key_of(own), context)[0]
                once = (sums[0] == 0) & seen_before
                total = sums[0] + once
                aside = d[0] * (sums[1] + once) + d[1] * sums[2] + d[2] * sums[3]
                p = np.where((total > 0) & (own[0] != NONE), (_less(hits, d) + aside * p) / np.maximum(total, 1), p)
                seen_before = ~first & np.roll(hits > 0, 1)
            return sizes, known, base, add(np.log10(p))

        for batch in batches:
            sums = [block(parts) for parts in _blocks(iter([batch]), words)]
            if not sums:
                continue
            n, known, base, value = (np.concatenate(x) for x in zip(*sums))
            made = [n.astype(np.int64), known.astype(np.int64), np.full(len(n), seen, np.int64), base.astype(float), value.astype(float)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *map(pa.array, made)], names=[*kept, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    ddl = ", ".join([*[f"`{c}` {t}" for c, t in slim.dtypes[1:]], "n_tokens long, n_known long, train_tokens long, base_score double, score double"])
    return slim.mapInArrow(run, ddl)


def report(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document, scored by the model of the documents that are not held out."""
    slim = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    held = residue("doc_id", 7) == 2
    model = train(slim.where(~held).select("text"))
    return scored(slim.select("doc_id", held.alias("held_out"), "text"), model)
