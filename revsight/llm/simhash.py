"""SimHash near-duplicates by covering locality-sensitive hashing.

A 64-bit fingerprint sums the bits of the XXH64 of every word shingle.  Fingerprints within ``radius`` bits are found with
2**(radius + 1) - 1 structured masks: bit i carries a code word c(i) of radius + 1 bits, other than zero, and mask v keeps
the bits with an odd number of ones in c(i) & v.  Any ``radius`` code words leave some v orthogonal to all of them, so two
fingerprints that differ in at most ``radius`` bits agree under that mask: no link is lost (Pagh, "CoveringLSH", 2016).

Equal fingerprints are grouped first, so copies cost nothing further.  A bucket of more than ``SMALL`` fingerprints is
covered again by masks over the bits its mask dropped, which bounds a bucket by 2**14 fingerprints whatever the input.  A
bucket yields a spanning tree of its links, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import discard, fresh, lean, materialise, words_of
from .components import components

BITS = 64
SMALL = 4096
#: Names of crowded buckets are broadcast up to so many (16 MB), else joined by a shuffle.
BROADCAST_ROWS = 1_000_000
_SLICE = 1 << 16
#: Shingles are counted in so many classes (16 MB) to order them by rarity; a row has the counts of so many (16 KB).
SKETCH, _PART = 1 << 22, 1 << 12
_KNOWN = 200_000
#: In buckets of more texts than this, pairs that other links already join are not tried.
ALL_PAIRS = 16
#: Members of a bucket that one task compares at a time.
SPLIT = 20_000
#: Keys that many texts share are looked for among one text in so many, and at most so many of them are dealt in parts.
#: This only spreads work: a key that it misses, or deals for nothing, has all its pairs tried all the same.
SAMPLE, HEAVY = 1_000, 1_000_000
#: Unsettled members of a large bucket that are tried with all before the others are.
HUBS = 8
#: Other components with whose likeliest member a member of a large bucket is tried at a time, and how often before all are.
LIKELY, ROUNDS = 8, 3
#: Classes of shingles whose parities rule out pairs of a large bucket.
PARITY = 1024


def shingles(text: str | None, size: int) -> list[bytes]:
    """Word shingles of a whole text, repeats included; fewer words than a shingle: the whole sequence is the one shingle."""
    words = words_of(text)
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    if size == 1:
        return words
    if size == 3:
        return [a + b" " + b + b" " + c for a, b, c in zip(words, words[1:], words[2:])]
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)))))


def fingerprint(text: str | None, shingle: int, distinct: bool = False) -> int:
    """The fingerprint of a whole text; no words: zero.  ``distinct``: each shingle counts once."""
    grams = shingles(text, shingle)
    if not grams:
        return 0
    if distinct:
        grams = list(set(grams))
    digest = xxhash.xxh64_intdigest
    total = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(grams), _SLICE):
        part = grams[at : at + _SLICE]
        hashes = np.fromiter((digest(g, 42) for g in part), dtype="<u8", count=len(part))
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * total > len(grams)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def with_fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint", shingle: int = 5, distinct: bool = False) -> DataFrame:
    """Every row of ``df`` with its fingerprint as a signed long in ``out``; a null text counts as one without words."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(t.as_py(), shingle, distinct) for t in batch.column(text)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.int64())], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def masks(bits: list[int], radius: int) -> list[int]:
    """Masks over the given bit positions such that any ``radius`` of the bits are all dropped by one of them at least."""
    codes = (1 << (radius + 1)) - 1
    return [sum(1 << b for i, b in enumerate(bits) if bin((i % codes + 1) & v).count("1") % 2) for v in range(1, codes + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _tree(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within one bucket: each member is compared once with those not yet reached."""
    rest, links = members, []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                found = rest[near]
                links += [(int(x), int(y)) for y in found]
                queue += list(found)
                rest = rest[~near]
    return links


def _links(buckets: DataFrame, radius: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            values, ends = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
            links = [x for a, b in zip(ends[:-1], ends[1:]) for x in _tree(values[a:b], radius)]
            both = np.array(links, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])

    return buckets.select("members").mapInArrow(run, "a long, b long")


def links(marks: DataFrame, radius: int = 3, small: int = SMALL) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of ``marks`` (one long column, ``mark``) that keep its components."""
    all_bits = list(range(BITS))
    first = masks(all_bits, radius)
    # one long names a bucket: a hash of table and masked bits, the table's number in its last byte
    name = lambda t, bits: F.xxhash64(t, bits).bitwiseAND(F.lit(-256)).bitwiseOR(t.cast("long"))
    keyed = marks.select("mark", F.explode(F.array(*[name(F.lit(i), F.col("mark").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(first)])).alias("bucket"))
    sizes = materialise(keyed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("mark").alias("a"), F.max("mark").alias("b")).where("n > 1"), "buckets")
    pairs = sizes.where((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b")
    many = sizes.where("n > 2").select("bucket", "n")
    if many.count() <= BROADCAST_ROWS:
        many = F.broadcast(many)
    shared = keyed.join(many, "bucket")
    cold = shared.where(F.col("n") <= small).groupBy("bucket").agg(F.collect_list("mark").alias("members"))
    second = [(i, j, _signed(m | x)) for i, m in enumerate(first) for j, x in enumerate(masks([b for b in all_bits if not m >> b & 1], radius))]
    # (2**(radius + 1) - 1)**2 rows whatever the input
    deeper = F.broadcast(marks.sparkSession.createDataFrame(second, "t int, t2 int, mask long"))
    again = shared.where(F.col("n") > small).withColumn("t", F.col("bucket").bitwiseAND(F.lit(255)).cast("int")).join(deeper, "t").select("t", "t2", F.col("mark").bitwiseAND(F.col("mask")).alias("key2"), "mark")
    hot = again.groupBy("t", "t2", "key2").agg(F.collect_list("mark").alias("members")).where(F.size("members") > 1)
    return pairs.unionByName(_links(cold.select("members").unionByName(hot.select("members")), radius))


def groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, radius: int = 3) -> DataFrame:
    """Rows (doc_id, fingerprint long, component_id), one for each row of ``df``.

    The component is the smallest doc_id reachable over links, itself included.  Rows that share a doc_id are one node for
    each of their fingerprints; rows whose doc_id is null link with nothing and get a null component.  Texts that are null,
    empty or only white space have the fingerprint zero and link like any other.  An empty table gives an empty result.
    """
    marked = materialise(with_fingerprints(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), shingle=shingle).select("doc_id", "fingerprint"), "marks")
    reps = materialise(marked.where("doc_id IS NOT NULL").groupBy("fingerprint").agg(F.min("doc_id").alias("rep")), "reps")
    found = materialise(links(reps.select(F.col("fingerprint").alias("mark")), radius), "links")
    # components over fingerprints, then the smallest document of each
    linked = components(found).select(F.col("node").alias("fingerprint"), F.col("component").alias("root"))
    rooted = reps.join(linked, "fingerprint", "left").select("fingerprint", "rep", F.coalesce("root", "fingerprint").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    labels = materialise(rooted.join(least, "root").select("fingerprint", "component_id"), "labels")
    out = marked.join(labels, "fingerprint", "left")
    return out.select("doc_id", "fingerprint", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def _resembling(pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Rows (a, b) of ``pairs`` (a, text_a, b, text_b) whose sets of shingles have that Jaccard similarity at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("text_a"), batch.column("text_b")):
                p, q = set(shingles(x.as_py(), shingle)), set(shingles(y.as_py(), shingle))
                keep.append(p == q or len(p & q) >= similarity * len(p | q))
            out = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([out.column("a"), out.column("b")], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def _hashed(text: str | None, size: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text, from hashes of its words; no words: the empty shingle alone."""
    words = words_of(text)
    if len(known) > _KNOWN:
        known.clear()
    digest = xxhash.xxh64_intdigest
    one = np.empty(max(1, len(words)), np.uint64)
    one[0] = 0
    for i, w in enumerate(words):
        h = known.get(w)
        if h is None:
            h = known[w] = digest(w, 42)
        one[i] = h
    n = max(1, len(one) - size + 1)
    out = np.full(n, min(len(words), size), np.uint64)
    for i in range(min(size, len(one))):
        out = (out ^ one[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def sketch(texts: DataFrame, size: int) -> np.ndarray:
    """How many texts have a shingle of each of ``SKETCH`` hash classes; its size does not depend on the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = {}, np.zeros(SKETCH, np.int32)
        for batch in batches:
            for text in batch.column(0):
                np.add.at(total, (_hashed(text.as_py(), size, known) % np.uint64(SKETCH)).astype(np.int64), 1)
        for at in range(0, SKETCH, _PART):
            if total[at : at + _PART].any():
                yield pa.RecordBatch.from_arrays([pa.array([at // _PART], pa.int32()), pa.array([total[at : at + _PART].tobytes()], pa.binary())], names=["part", "counts"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[part] = sums.get(part, np.int64(0)) + np.frombuffer(counts.as_py(), np.int32)
        for part, n in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.minimum(n, 2**31 - 1).astype(np.int32).tobytes()], pa.binary())], names=["part", "counts"])

    out = np.zeros(SKETCH, np.int32)
    for r in texts.select("text").mapInArrow(lean(run), "part int, counts binary").repartition("part").mapInArrow(added, "part int, counts binary").collect():
        out[r["part"] * _PART : (r["part"] + 1) * _PART] = np.frombuffer(r["counts"], np.int32)
    return out


def _needed(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """How many shingles sets of these sizes must share to be that similar."""
    return np.ceil(similarity / (1 + similarity) * (n + m) - 1e-9)


def _prefix(text: str | None, size: int, similarity: float, known: dict[bytes, int], counts: np.ndarray) -> tuple[np.ndarray, int]:
    """The rarest shingles of a text, one more than may differ, and how many it has."""
    h = _hashed(text, size, known)
    order = np.argsort(counts[(h % np.uint64(len(counts))).astype(np.int64)], kind="stable")
    return h[order[: len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1]], len(h)


def _heavy(texts: DataFrame, size: int, similarity: float, counts) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
    """Sorted keys that many of ``texts`` have in their prefixes, at most ``HEAVY``, and in how many parts to deal each."""
    if texts.count() <= SPLIT:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {}
        for batch in batches:
            keys = [_prefix(t.as_py(), size, similarity, known, counts.value)[0] for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64))], names=["key"])

    some = texts.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(run, "key long")
    many = some.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= max(2, SPLIT // (4 * SAMPLE)))
    found = many.orderBy(F.col("n").desc(), "key").limit(HEAVY).toPandas()
    key, n = found["key"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    order = np.argsort(key)
    return key[order], 1 + n[order] * SAMPLE // SPLIT


def _prefixes(texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """Rows (key, part, node, n, rest) of the rarest of the ``n`` shingles of each text (node, text), one more than may differ.

    In any fixed order of all shingles, two sets with a Jaccard similarity of t share one of the first n - ceil(t * n) + 1
    shingles of either; here rare ones come first, by the counts of :func:`sketch`, so keys are shared by few.  ``rest``
    counts the shingles from the key on, which bounds what two sets can share if the key is the first they share.  A key
    that very many texts have is dealt out in parts from 0 on; any other has part -1, and all its members in that.
    """
    counts = texts.sparkSession.sparkContext.broadcast(sketch(texts, size))
    heavy = texts.sparkSession.sparkContext.broadcast(_heavy(texts, size, similarity, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {}
        split, parts = heavy.value
        for batch in batches:
            keys, sizes, rests = [np.zeros(0, np.uint64)], [], [np.zeros(0, np.int32)]
            for text in batch.column("text"):
                first, n = _prefix(text.as_py(), size, similarity, known, counts.value)
                keys.append(first)
                sizes.append(n)
                rests.append(np.arange(n, n - len(first), -1, dtype=np.int32))
            many = np.array([len(k) for k in keys[1:]], np.int64)
            key, node = np.concatenate(keys), np.repeat(batch.column("node").to_numpy(), many)
            part = np.full(len(key), -1, np.int64)
            if len(split):
                at = np.minimum(np.searchsorted(split, key), len(split) - 1)
                dealt = np.flatnonzero(split[at] == key)
                part[dealt] = ((node[dealt].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts[at[dealt]]
            columns = [key.view(np.int64), part.astype(np.int32), node, np.repeat(np.array(sizes, np.int32), many), np.concatenate(rests)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "part", "node", "n", "rest"])

    return texts.select("node", "text").mapInArrow(lean(run), "key long, part int, node long, n int, rest int")


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of each run of rows that agree in the first ``keys`` columns, from batches sorted by these."""
    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        x = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns])
        cut = np.flatnonzero((x[:keys, 1:] != x[:keys, :-1]).any(axis=0)) + 1
        pieces = np.split(x, cut, axis=1)
        if held and (held[-1][:keys, -1] != pieces[0][:keys, 0]).any():
            yield list(np.concatenate(held, axis=1))
            held = []
        for piece in pieces[:-1]:
            yield list(np.concatenate([*held, piece], axis=1) if held else piece)
            held = []
        held.append(pieces[-1])
    if held:
        yield list(np.concatenate(held, axis=1))


def _fits(n: np.ndarray, rest: np.ndarray, n1: int, rest1: int, similarity: float) -> np.ndarray:
    """Which sets may be similar to one more set, if the key that they share is their first."""
    return np.minimum(rest, rest1) >= _needed(n, n1, similarity)


_PAIRS = "key long, a long, b long, nodes array<long>, sizes array<long>, rests array<long>"
_PAIRS_TYPE = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("nodes", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("rests", pa.list_(pa.int64()))])


def _buckets(prefixes: DataFrame, similarity: float) -> DataFrame:
    """Rows of texts that share a key: pairs (a, b) to try, or with a null ``a`` up to ``SPLIT`` members of a large bucket.

    Of at most ``ALL_PAIRS`` members every pair is listed that sizes and places allow, else the smallest node with each other.
    Buckets of more members are handed on whole, and so is every part of a key that is dealt out, of one member as of many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, seen, n_out = [], set(), 0

        def flush() -> pa.RecordBatch:
            nonlocal out, n_out
            table = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 6, _PAIRS_TYPE.types)], schema=_PAIRS_TYPE)
            out, n_out = [], 0
            return table

        for key, part, node, n, rest in _grouped(batches, 2):
            dealt = part[0] >= 0
            if len(node) < 2 and not dealt:
                continue
            order = np.argsort(node)
            node, n, rest = node[order], n[order], rest[order]
            for i in range(len(node) - 1 if len(node) <= ALL_PAIRS else 1):
                fit = _fits(n[i + 1 :], rest[i + 1 :], n[i], rest[i], similarity)
                for b in node[i + 1 :][fit].tolist():
                    pair = (int(node[i]), b)
                    # most keys of near copies are shared by the same texts
                    if pair not in seen:
                        seen.add(pair)
                        out.append((None, *pair, None, None, None))
                        n_out += 1
            if len(seen) > _KNOWN:
                seen.clear()
            for at in range(0, len(node) if dealt or len(node) > ALL_PAIRS else 0, SPLIT):
                out.append((int(key[0]), None, None, *(c[at : at + SPLIT] for c in (node, n, rest))))
                n_out += len(node[at : at + SPLIT])
                if n_out > _SLICE:
                    yield flush()
            if n_out > _SLICE:
                yield flush()
        yield flush()

    return prefixes.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(lean(run), _PAIRS)


def _parities(texts: DataFrame, size: int) -> DataFrame:
    """Rows (node, parity) of ``texts`` (node, text): for each of ``PARITY`` classes of shingles whether an odd number is in it.

    Parities of two sets differ in at most as many places as the sets differ in shingles (Sandes et al., "Bitmap filter",
    2017), so they rule pairs out and never a similar one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {}
        for batch in batches:
            odd = [np.packbits(np.bincount((_hashed(t.as_py(), size, known) >> np.uint64(40)).astype(np.int64) % PARITY, minlength=PARITY) % 2 == 1).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(odd, pa.binary())], names=["node", "parity"])

    return texts.select("node", "text").mapInArrow(run, "node long, parity binary")


def _apart(large: DataFrame, grouped: DataFrame, texts: DataFrame, size: int, similarity: float, hubs: int | None = None, likely: int | None = None) -> DataFrame:
    """Pairs (a, b) that large buckets (key, nodes, sizes, rests) still have to try, given groups (node, component) found so far.

    A member is settled if it is in the group of its bucket's smallest node.  Every other one is tried with each member of
    another component, unless places or parities of their shingles rule the pair out: members are dealt in blocks, the
    unsettled in chunks, and each block meets each chunk in a group of its own, so a group is of at most about two
    ``SPLIT`` rows and settled members never meet.  With ``hubs`` only about so many unsettled members of each bucket, the
    same in all buckets by their hash, are tried with the others: that joins most of what a later call without would find.
    With ``likely`` each is tried with so many other components, the likeliest by their parities, and with one member of each:
    what lies in one component afterwards has no pair left, so a call without lists no square of groups that belong together.
    """
    members = large.select("key", F.explode(F.arrays_zip("nodes", "sizes", "rests")).alias("x")).select("key", F.col("x.nodes").alias("node"), F.col("x.sizes").alias("n"), F.col("x.rests").alias("rest"))
    rooted = materialise(members.join(grouped, "node", "left").select("key", "node", "n", "rest", F.coalesce("component", "node").alias("root")), "members")
    main = rooted.groupBy("key").agg(F.min_by("root", "node").alias("main"), F.count("*").alias("all"))
    loose = rooted.join(main, "key").where("root != main")
    per_key = materialise(loose.groupBy("key").agg(F.first("main").alias("main"), F.ceil(F.first("all") / SPLIT).alias("blocks"), F.count("*").alias("open")), "open").withColumn("chunks", F.ceil(F.least("open", F.lit(hubs or (1 << 62))) / SPLIT))
    deal = lambda column: F.pmod(F.xxhash64("node"), F.col(column))
    each = lambda column: F.explode(F.sequence(F.lit(0).cast("long"), F.col(column) - 1))
    opened = rooted.join(per_key, "key")
    parities = _parities(texts.join(opened.select("node").distinct(), "node", "left_semi"), size)
    opened = materialise(opened.join(parities, "node"), "opened")
    fields = ["node", "n", "rest", "root", "parity"]
    own = opened.withColumn("block", deal("blocks")).select("key", "block", each("chunks").alias("chunk"), F.lit(0).cast("long").alias("loose"), *fields)
    loose = opened.where("root != main")
    if hubs:
        loose = loose.where(F.pmod(F.xxhash64(F.lit("hub"), "node"), F.lit(1 << 31)) * F.col("open") < F.lit(hubs << 31))
    free = loose.withColumn("chunk", deal("chunks")).select("key", each("blocks").alias("block"), "chunk", F.lit(1).cast("long").alias("loose"), *fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # parities in the order of the rows, as far as no group has used them

        def numbers() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held.extend(np.frombuffer(x.as_py(), "<u8") for x in batch.column("parity"))
                yield batch.select(batch.schema.names[:-1])

        seen: set[tuple[int, int]] = set()
        out: list[tuple[np.ndarray, np.ndarray]] = []
        n_out = 0

        def flush() -> Iterator[pa.RecordBatch]:
            """Pairs since the last call; near copies share many buckets."""
            nonlocal n_out
            new = {x for a, b in out for x in zip(a.tolist(), b.tolist())} - seen
            out.clear()
            n_out = 0
            if len(seen) > _KNOWN:
                seen.clear()
            seen.update(new)
            if new:
                a, b = zip(*sorted(new))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for _, _, _, is_loose, node, n, rest, root in _grouped(numbers(), 3):
            parity = np.stack(held[: len(node)])
            del held[: len(node)]
            here = np.flatnonzero(is_loose == 0)
            for i in np.flatnonzero(is_loose):
                fit = here[_fits(n[here], rest[here], n[i], rest[i], similarity) & (root[here] != root[i])]
                # how many more shingles might differ
                spare = n[fit] + n[i] - 2 * _needed(n[fit], n[i], similarity) - np.bitwise_count(parity[fit] ^ parity[i]).sum(axis=1, dtype=np.int64)
                fit, spare = fit[spare >= 0], spare[spare >= 0]
                if likely is not None:
                    fit = fit[_likeliest(root[fit], node[fit], spare, likely)]
                out.append((np.minimum(node[fit], node[i]), np.maximum(node[fit], node[i])))
                n_out += len(fit)
                if n_out > _SLICE:
                    yield from flush()
            yield from flush()

    dealt = own.unionByName(free).repartition("key", "block", "chunk").sortWithinPartitions("key", "block", "chunk")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _likeliest(root: np.ndarray, node: np.ndarray, spare: np.ndarray, most: int) -> np.ndarray:
    """Places of the member with the most to spare of each root, of ``most`` roots with the most; the smallest node of equals."""
    order = np.lexsort((node, -spare, root))
    first = order[np.append(True, root[order][1:] != root[order][:-1])] if len(order) else order
    return first[np.lexsort((node[first], -spare[first]))[:most]]


def _checked(candidates: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs of ``candidates`` (a, b) whose ``texts`` (node, text) are that similar; only texts of some pair are moved."""
    ids = candidates.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    needed = materialise(texts.join(ids, "node", "left_semi"), "needed")
    pairs = candidates.join(needed.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(needed.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    found = materialise(_resembling(pairs.select("a", "text_a", "b", "text_b"), shingle, similarity), "links")
    discard(needed)
    return found


def _marked_pairs(texts: DataFrame, shingle: int, radius: int) -> DataFrame:
    """Pairs (a < b) of nodes whose fingerprints, of distinct shingles, link: each node with the smallest of its own, and these."""
    marks = materialise(with_fingerprints(texts.select("node", "text"), out="mark", shingle=shingle, distinct=True).select("node", "mark"), "marks")
    reps = materialise(marks.groupBy("mark").agg(F.min("node").alias("rep")), "reps")
    same = marks.join(reps, "mark").where("node != rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    end = lambda name: reps.select(F.col("mark").alias(name), F.col("rep").alias(f"rep_{name}"))
    near = links(reps.select("mark"), radius).toDF("x", "y").join(end("x"), "x").join(end("y"), "y").select(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b"))
    return same.unionByName(near)


def similar_groups(texts: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 3) -> DataFrame:
    """Rows (node, component) of those of ``texts`` (node long, text), all different, that similar pairs join to others.

    Candidates are links of fingerprints first, as :func:`links` gives them; texts of one fingerprint are tried with its smallest
    node.  At this similarity fingerprints alone lose links, so candidates are also texts that share a shingle of their prefixes (Chaudhuri et al., 2006) and pass the bound of its place (Xiao et al.,
    "PPJoin", 2008), which loses no pair of that similarity but by a collision of 64-bit hashes; each candidate is then
    held against the exact similarity.  In a small bucket every pair is tried; in a larger one first its smallest node with
    each other, then some of the members that this leaves apart with all, then each of them with the likeliest of the other
    components, a few times, then every pair that is still apart.
    """
    found = materialise(_buckets(_prefixes(texts, shingle, similarity), similarity), "buckets")
    marked = _marked_pairs(texts, shingle, radius)
    candidates = materialise(found.where("a IS NOT NULL").select("a", "b").unionByName(marked).distinct(), "candidates")
    first = materialise(components(_checked(candidates, texts, shingle, similarity)), "groups")
    discard(candidates)
    large = found.where("a IS NULL").select("key", "nodes", "sizes", "rests")
    if large.isEmpty():
        return first
    # the last call leaves nothing out; those before it only leave it less to list
    calls = [(HUBS, LIKELY), *[(None, LIKELY)] * ROUNDS, (None, None)]
    while calls:
        hubs, likely = calls.pop(0)
        candidates = materialise(_apart(large, first, texts, shingle, similarity, hubs, likely), "candidates")
        more = _checked(candidates, texts, shingle, similarity)
        discard(candidates)
        if not more.isEmpty():
            first = _regrouped(first, more)
        elif hubs is None:
            calls = calls[-1:] if likely else []
    discard(found)
    return first


def _regrouped(groups: DataFrame, more: DataFrame) -> DataFrame:
    """Groups (node, component) after further links (a, b): these join whole components, so most need no edge of their own."""
    root = lambda end: groups.select(F.col("node").alias(end), F.col("component").alias(f"root_{end}"))
    rooted = more.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    joined = materialise(components(rooted.where("a != b").distinct()).withColumnRenamed("component", "last"), "joined")
    moved = groups.join(joined.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("last", "component").alias("component"))
    # nodes that only further links reach
    fresh_nodes = joined.join(groups, "node", "left_anti").select("node", F.col("last").alias("component"))
    return materialise(moved.unionByName(fresh_nodes), "groups")


def near_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Rows (doc_id, digest, component_id, kept) for every distinct pair of an id and a text.

    Texts whose sets of word shingles are that similar, or linked by such, share a component, named by its smallest id.
    ``digest`` is the text's MD5.  Equal texts are one node; an id with several texts stands for each of them.  A null text
    counts as the empty one.  ``kept`` marks one pair of each component: the smallest id, null ids last, then the smallest
    digest.  An empty table gives an empty result.
    """
    slim = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("digest", F.md5(F.col("text").cast("binary")))
    pairs = materialise(slim.select("doc_id", "digest").distinct(), "pairs")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    # a text's number is written once with the table, so every later read sees the same
    nodes = materialise(pairs.groupBy("digest").agg(F.min(place).alias("least")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    own = nodes.select("digest", "node", F.col("least.doc_id").alias("least_id"))
    # the id is part of the key, so the copies of a text don't meet in one task
    texts = slim.join(own.withColumnRenamed("digest", "own_digest"), (F.col("digest") == F.col("own_digest")) & F.col("doc_id").eqNullSafe(F.col("least_id"))).select("node", "text")
    texts = materialise(texts.dropDuplicates(["node"]), "texts")
    grouped = similar_groups(texts, shingle, similarity)
    labelled = nodes.join(grouped, "node", "left").select("digest", "least", F.coalesce("component", "node").alias("root"))
    first = labelled.groupBy("root").agg(F.min("least").alias("first"))
    labels = materialise(labelled.join(first, "root").select("digest", "first"), "labels")
    discard(texts)
    return pairs.join(labels, "digest").select("doc_id", "digest", F.col("first.doc_id").alias("component_id"), (place == F.col("first")).alias("kept"))


def keep_first(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of near copies: the one with the smallest id, null ids last, then with the smallest digest.

    Rows that repeat the kept id and text become one, any of them.  Rows that share an id but whose texts are not alike all
    stay.  Null texts count as empty and are copies of each other.  Other columns are left alone whatever their names.
    """
    a, b, c = (fresh(df, x) for x in ("near_digest", "near_id", "near_mark"))
    kept = near_groups(df, doc_id, text, shingle, similarity).where("kept").select(F.col("digest").alias(c), F.col("doc_id").alias(b))
    marked = df.withColumn(a, F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))
    same = (F.col(a) == F.col(c)) & F.col(doc_id).cast("long").eqNullSafe(F.col(b))
    return marked.join(kept, same, "left_semi").dropDuplicates([a]).select(*df.columns)


def report(df: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, the fingerprint as 16 hexadecimal digits, and component_id."""
    return groups(df, shingle=shingle, radius=radius).select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
