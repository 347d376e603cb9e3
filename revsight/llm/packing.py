"""Vector bin packing of examples into training sequences under limits on tokens, segments and loss-bearing tokens.

The dot-product heuristic (Panigrahy et al., "Heuristics for Vector Bin Packing", 2011): an open sequence takes, from a
pool of waiting examples, the one whose sizes have the largest weighted dot product with what the sequence has left in each
dimension, until none fits.  The pool is bounded, so a task holds a few hundred examples at a time, and packing needs no
shuffle: each Spark partition packs its own rows and only its last sequence can stay part empty.

Documents may be cut.  One longer than a sequence waits in the pool in pieces as long as the limits allow.  When nothing
fits and more than ``tolerance`` tokens could still be placed, the longest waiting piece is cut to fill them.  What is left
when a partition ends is cut to sequences whose lengths are powers of two, which need no padding.

A token bears loss if another of its piece stands before it: the first of a piece is predicted from nothing.  The limit on
those tokens is below that on tokens, so a sequence of few long pieces ends at it, and one of many short pieces at the
limit on segments.

Defined results: null and empty texts are one token, the end mark; rows that repeat are packed like any other; other
columns are ignored whatever their names; an empty table gives an empty result.  Sequence ids are unique over the table:
partition number, then a counter.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import lean

MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS = 4096, 48, 4080
POOL, TOLERANCE, END_ID = 512, 8, 2
CACHE = 250_000


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold; ``tolerance``: tokens of padding for which no document is cut."""

    tokens: int = MAX_TOKENS
    segments: int = MAX_SEGMENTS
    loss: int = MAX_LOSS
    tolerance: int = TOLERANCE

    def array(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss], dtype=np.float64)


class Pool:
    """Waiting examples with their sizes in each dimension; ``place`` fills one sequence."""

    def __init__(self, limits: Limits, cut: Callable[[object, int], tuple[object, object, tuple[int, int, int], tuple[int, int, int]]] | None = None):
        self.limits, self.cut = limits, cut
        self.keys: list[object] = []
        self.sizes = np.zeros((2 * POOL, 3))
        self.n = 0

    def add(self, key: object, size: tuple[int, int, int]) -> None:
        if self.n == len(self.sizes):
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        self.sizes[self.n] = size
        self.keys.append(key)
        self.n += 1

    def _take(self, i: int) -> tuple[object, np.ndarray]:
        key, size = self.keys[i], self.sizes[i].copy()
        self.n -= 1
        self.keys[i] = self.keys[self.n]
        self.sizes[i] = self.sizes[self.n]
        self.keys.pop()
        return key, size

    def most(self) -> int:
        """Tokens of the largest examples that one sequence may hold by their number."""
        sizes = self.sizes[: self.n, 0]
        return int(sizes.sum() if self.n <= self.limits.segments else np.partition(sizes, -self.limits.segments)[-self.limits.segments :].sum())

    def place(self, tokens: int | None = None) -> list[object]:
        """The examples of one sequence, taken out of the pool; ``tokens``: a shorter sequence than the limit."""
        full = self.limits.array()
        left = full.copy()
        if tokens is not None:
            left[0] = tokens
        out: list[object] = []
        while self.n:
            sizes = self.sizes[: self.n]
            fits = (sizes <= left).all(axis=1)
            if fits.any():
                score = np.where(fits, sizes @ (left / (full * full)), -1.0)
                key, size = self._take(int(score.argmax()))
            elif self.cut is not None and left[1] >= 1 and (room := int(min(left[0], left[2] + 1))) > (self.limits.tolerance if tokens is None else 0):
                i = int(sizes[:, 0].argmax())
                if sizes[i, 0] <= room:  # the limit on loss keeps out what tokens would let in
                    break
                key, size = self._take(i)
                key, rest, size, after = self.cut(key, room)
                self.add(rest, after)
            else:
                break
            out.append(key)
            left = left - np.asarray(size, dtype=np.float64)
        return out


class Encoder(dict):
    """Token ids of a text as little-endian unsigned 32-bit bytes.

    A tokenizer that drops white space, ignores the case of A-Z and never joins what white space separates, nor a letter and
    a full stop or comma after it, has its ids looked up word by word: frequent words from a bounded cache, the others
    encoded together once a block.  Texts that hold the opening of a special token are encoded whole.  Whether a tokenizer
    is of that kind is read from its file and tried on ``_TRIALS``; any other encodes every text whole.
    """

    BETWEEN, SPECIAL = "<|startoftext|>", b"<|"
    _TAILS = (b".", b",")
    _TRIALS = ("Some words, AND a few more.", "it's 3.14 x.y (a) \u00e9\u00df\u0130 na\u00efve", "a\tb\n\nc  d\x0b\x0ce", "\u4e2d\u6587 word \U0001f600!!", "#tag @me http://x.org/a?b=1", "don't can't we'll I'M", "...,,, ,. 10,000.50")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.token_to_id(self.BETWEEN)
        names = self.tokenizer.get_vocab()
        self.last = np.zeros(max(names.values()) + 1, bool)
        self.last[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.tails = {t: self.plain(t.decode()) for t in self._TAILS}
        self.by_word = self.mark is not None and '"end_of_word_suffix":"</w>"' in self.tokenizer.to_str() and '"type":"Lowercase"' in self.tokenizer.to_str()
        if self.by_word:
            self.by_word = [*self.batch(list(self._TRIALS))] == [self.plain(t) + self._END for t in self._TRIALS]
            self.clear()

    _END = np.array([END_ID], dtype="<u4").tobytes()

    def plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _encode(self, words: list[bytes]) -> Iterator[bytes]:
        """Ids of each word.  Words of letters alone are one piece each, which its last token shows; others get a mark between."""
        plain = [w.decode("utf-8", "surrogatepass") for w in words]
        letters = all(map(str.isalpha, plain))
        between = " " if letters else self.BETWEEN
        ids = np.array(self.tokenizer.encode_batch_fast([between.join(plain)], add_special_tokens=False)[0].ids, dtype=np.int64)
        ends = np.flatnonzero(self.last[ids]) + 1 if letters else np.append(np.flatnonzero(ids == self.mark), len(ids))
        if len(ends) != len(words):  # a letter whose lower case is no letter
            yield from map(self.plain, plain)
            return
        raw, at = ids.astype("<u4").tobytes(), 0
        for end in (4 * ends).tolist():
            yield raw[at:end]
            at = end if letters else end + 4

    def _learn(self, new: list[bytes]) -> dict[bytes, bytes]:
        out, letters, others, tailed = {}, {}, {}, []
        for w in new:
            tail = w[-1:] in self.tails and w[-2:-1].isalnum()
            stem = w[:-1] if tail else w
            if tail:
                tailed.append(w)
            if stem in self:
                out[stem] = self[stem]
            else:
                (letters if stem.isalpha() or stem.decode("utf-8", "surrogatepass").isalpha() else others)[stem] = None
        for group in (letters, others):
            if group:
                out.update(zip(group, self._encode(list(group))))
        for w in tailed:
            out[w] = out[w[:-1]] + self.tails[w[-1:]]
        return out

    def batch(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text in turn, with the end mark; words the cache has no room for are kept for one block only."""
        end, at = self._END, 0
        if not self.by_word:
            yield from (self.plain(t or "") + end for t in texts)
            return
        while at < len(texts):
            block, chars, new = [], 0, {}
            while at < len(texts) and (not block or chars < 2_000_000):
                raw = (texts[at] or "").encode("utf-8", "surrogatepass")
                chars += len(raw)
                if self.SPECIAL in raw:
                    block.append(([self.plain(texts[at])], ()))
                else:
                    words = raw.lower().split()
                    ids = list(map(self.get, words))
                    gaps = [(i, words[i]) for i, x in enumerate(ids) if x is None] if None in ids else ()
                    new.update((w, None) for _, w in gaps)
                    block.append((ids, gaps))
                at += 1
            found = self._learn(list(new)) if new else {}
            for ids, gaps in block:
                for i, w in gaps:
                    ids[i] = found[w]
                ids.append(end)
                yield b"".join(ids)
            self.update(islice(found.items(), max(0, CACHE - len(self))))


@dataclass
class Piece:
    doc_id: int | None
    total: int
    start: int
    data: bytes

    def size(self) -> tuple[int, int, int]:
        n = len(self.data) // 4
        return n, 1, max(0, n - 1)


def _cut(piece: Piece, room: int) -> tuple[Piece, Piece, tuple[int, int, int], tuple[int, int, int]]:
    a = Piece(piece.doc_id, piece.total, piece.start, piece.data[: 4 * room])
    b = Piece(piece.doc_id, piece.total, piece.start + room, piece.data[4 * room :])
    return a, b, a.size(), b.size()


def sequences(documents: Iterator[tuple[int | None, bytes]], limits: Limits) -> Iterator[list[Piece]]:
    """Packed sequences of (doc_id, ids as bytes), each a list of pieces in order."""
    pool, whole, held = Pool(limits, _cut), 4 * min(limits.tokens, limits.loss + 1), 0
    for doc_id, ids in documents:
        total, at = len(ids) // 4, 0
        while at < len(ids):
            piece = Piece(doc_id, total, at // 4, ids[at : at + whole])
            pool.add(piece, piece.size())
            at += len(piece.data)
            held += len(piece.data) // 4
        while pool.n > POOL and held > limits.tokens:
            packed = pool.place()
            held -= sum(len(p.data) // 4 for p in packed)
            yield packed
    while pool.n:
        most = pool.most()
        packed = pool.place(None if most >= limits.tokens else 1 << (most.bit_length() - 1))
        held -= sum(len(p.data) // 4 for p in packed)
        yield packed


_FIELDS = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
_ROWS, _TEXTS = 20_000, 1_000


def pack_documents(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", limits: Limits = Limits(), with_ids: bool = False) -> DataFrame:
    """One row per piece of a document: where it lies in the document and in its sequence, and the checksum of its ids.

    ``tokenizer``: a tokenizers file that every worker can open.  ``with_ids`` adds the ids themselves (array of ints).
    """
    slim = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        base = TaskContext.get().partitionId() << 40

        def documents() -> Iterator[tuple[int | None, bytes]]:
            for batch in batches:
                for at in range(0, batch.num_rows, _TEXTS):
                    part = batch.slice(at, _TEXTS)
                    yield from zip(part.column(0).to_pylist(), encoder.batch(part.column(1).to_pylist()))

        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * (7 + with_ids)
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(b, "<u4").astype(np.int32) for b in columns[7]], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", *[n for n, _ in _FIELDS], *["ids"] * with_ids])

        for number, packed in enumerate(sequences(documents(), limits)):
            offset = 0
            for p in packed:
                n = len(p.data) // 4
                rows.append((p.doc_id, p.start, n, zlib.crc32(p.data), p.total, base + number, offset, *[p.data] * with_ids))
                offset += n
            if len(rows) >= _ROWS:
                yield out()
                rows = []
        yield out()

    return slim.mapInArrow(lean(run), ddl)


def pack_examples(df: DataFrame, key: str, tokens: str, segments: str, loss: str, limits: Limits = Limits()) -> DataFrame:
    """Place whole instruction examples: rows (key, sequence_id, offset), for each row of ``df``.

    ``tokens``, ``segments`` and ``loss`` are columns of sizes; null counts as 0.  An example that exceeds a limit by
    itself is never cut or dropped: it gets a sequence of its own, which the caller sees by its size.
    """
    sizes = [F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(a) for c, a in ((tokens, "tokens"), (segments, "segments"), (loss, "loss"))]
    slim = df.select(F.col(key).alias("key"), *sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, number, base = Pool(limits), 0, TaskContext.get().partitionId() << 40

        def out(packed: list) -> pa.RecordBatch:
            nonlocal number
            lengths = [n for _, n in packed]
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if lengths else []
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in packed], kind), pa.array([base + number] * len(packed), pa.int64()), pa.array(starts, pa.int64())], names=["key", "sequence_id", "offset"])

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for k, t, s, n in zip(*(c.to_pylist() for c in batch.columns)):
                if t > limits.tokens or s > limits.segments or n > limits.loss:
                    yield out([(k, t)])
                else:
                    pool.add((k, t), (t, s, n))
                while pool.n > POOL:
                    yield out(pool.place())
        while pool.n:
            yield out(pool.place())

    return slim.mapInArrow(run, f"key {dict(slim.dtypes)['key']}, sequence_id long, offset long")


def report(df: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """All pieces of ``documents`` under the production limits."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return pack_documents(df, tokenizer)
