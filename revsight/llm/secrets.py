"""Secret scans: fixed patterns, and a battery of randomness tests under length-aware false-discovery control.

Two passes over the texts.  The first gathers the byte histogram of the corpus and every candidate token (a run of 20 or
more characters of ``[A-Za-z0-9+/_=-]``).  A token's inferred encoding is the smallest known alphabet that holds it; for
that, a chi-squared test of alphabet uniformity, a runs test and a lag-1 serial-correlation test give p-values of
randomness.  The token's e-value is a product: the mean over all encodings of the probability of the token as uniform
characters of that encoding, over its largest probability, in any encoding, as characters that occur as often as in the
corpus; times the Bonferroni combination of the three p-values, which is taken as nothing where they reject at ``LEVEL``.
Weights of encodings are fixed before a token is seen and the second factor is at most one, so for ordinary tokens of any
encoding, whose characters follow the corpus, the mean of an e-value is at most one.  Evidence grows with length, and the e-BH
rule (Wang and Ramdas, 2022) over all candidates of the corpus then bounds the share of false discoveries at ``fdr`` for
that null, however tokens depend on each other.  Only a histogram of e-values and 256 byte counts reach the driver.  The
second pass marks spans.

Defined results: null and empty texts have no spans; equal rows get equal spans; spans of patterns always stay, and a
random token is added only where no pattern span overlaps it.  Offsets are code points, ends exclusive.  Work is linear in
a text's length.  A column of ``df`` that has the name of the result is replaced by it; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import discard, fresh, lean, materialise

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX, LEAST_TOKEN = 8, 16, 32, 20
FDR, LEVEL = 0.01, 0.001
PLACEHOLDER = "[SECRET]"

_DIGITS, _LOWER, _UPPER = b"0123456789", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings, smallest first.
ENCODINGS = tuple(
    (name, np.frombuffer(alphabet, np.uint8))
    for name, alphabet in (
        ("digits", _DIGITS),
        ("hex", _DIGITS + _LOWER[:6]),
        ("HEX", _DIGITS + _UPPER[:6]),
        ("lower", _LOWER),
        ("upper", _UPPER),
        ("base32", _UPPER + b"234567"),
        ("lower36", _LOWER + _DIGITS),
        ("upper36", _UPPER + _DIGITS),
        ("letters", _UPPER + _LOWER),
        ("alnum", _UPPER + _LOWER + _DIGITS),
        ("base64", _UPPER + _LOWER + _DIGITS + b"+/"),
        ("base64url", _UPPER + _LOWER + _DIGITS + b"-_"),
        ("mixed", _UPPER + _LOWER + _DIGITS + b"+/-_"),
    )
)
_BIN, _BINS = 4, 4096
#: Characters of texts that a task looks at together.
CHARS = 4_000_000


def _table(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[np.frombuffer(chars, np.uint8)] = True
    return table


def _places(alphabet: np.ndarray) -> np.ndarray:
    place = np.full(256, -1, dtype=np.int64)
    place[alphabet] = np.arange(len(alphabet))
    return place


_PLACED = tuple((name, alphabet, _places(alphabet)) for name, alphabet in ENCODINGS)
_HEX = _table(_DIGITS + _LOWER[:6])
_TOKEN = _table(_UPPER + _LOWER + _DIGITS + b"+/_=-")


def runs(data: np.ndarray, starts: np.ndarray, table: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the maximal runs of ``table``'s bytes, of ``least`` bytes or more, that don't cross a start in ``starts``."""
    inside = table[data]
    cut = np.ones(len(data) + 1, dtype=bool)
    cut[1:-1] = inside[1:] != inside[:-1]
    cut[starts[starts < len(data)]] = True
    edges = np.flatnonzero(cut)
    begin, end = edges[:-1], edges[1:]
    keep = inside[begin] & (end - begin >= least) if len(begin) else np.zeros(0, bool)
    return begin[keep], end[keep]


def _leads(data: np.ndarray, first: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Code points between byte ``first`` and byte ``begin`` of UTF-8, for each pair; ``begin`` ascends."""
    if not len(begin):
        return begin
    places = np.unique(np.concatenate([[0], first, begin]))
    # bytes that are no continuation start a code point
    sums = np.add.reduceat(((data & 0xC0) != 0x80).astype(np.int64), np.minimum(places, len(data) - 1))
    before = np.concatenate([[0], np.cumsum(sums)])
    return before[np.searchsorted(places, begin)] - before[np.searchsorted(places, first)]


def sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts, in the first column, have about ``CHARS`` characters together, one text at least."""
    at, held = 0, 0
    for i, n in enumerate(pa.compute.binary_length(batch.column(0)).to_pylist()):
        held += n or 0
        if held > CHARS:
            yield batch.slice(at, i + 1 - at)
            at, held = i + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)


def found_in(texts: list[str | None]) -> tuple[list[list[tuple[int, int, int, int]]], list[list[tuple[int, int, bytes]]], np.ndarray]:
    """For each text its pattern spans (start, kind, end, start of the value) and candidate tokens (start, end, bytes); the byte histogram."""
    texts = [t or "" for t in texts]
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(b) for b in raw])]).astype(np.int64)
    spans: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    tokens: list[list[tuple[int, int, bytes]]] = [[] for _ in texts]
    for i, t in enumerate(texts):
        if "=" in t or ":" in t:
            spans[i] += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(t) if len(m[2]) >= LEAST_VALUE]
        if "AKIA" in t:
            spans[i] += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(t) if len(m[0]) >= LEAST_ACCESS]
    for table, least in ((_HEX, LEAST_HEX), (_TOKEN, LEAST_TOKEN)):
        begin, end = runs(data, starts, table, least)
        at = np.searchsorted(starts, begin, "right") - 1
        for i, a, b, lead in zip(at.tolist(), begin.tolist(), end.tolist(), _leads(data, starts[at], begin).tolist()):
            if table is _HEX:
                spans[i].append((lead, 2, lead + b - a, lead))
            else:
                tokens[i].append((lead, lead + b - a, raw[i][a - starts[i] : b - starts[i]]))
    return [sorted(s) for s in spans], tokens, np.bincount(data, minlength=256)


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(codes: np.ndarray, size: int) -> tuple[float, float, float]:
    """p-values of the three tests for codes 0 .. size - 1: uniformity (upper tail), runs about the middle, serial correlation."""
    n = len(codes)
    counts = np.bincount(codes, minlength=size)
    chi = float(((counts - n / size) ** 2).sum() * size / n)
    spread = math.sqrt(2 * (size - 1) * (n - 1) / n)
    # Wilson-Hilferty where cells are full enough, else the exact mean and variance
    k = size - 1
    z = ((chi / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k)) if n >= 5 * size else (chi - k) / spread
    uniform = 0.5 * math.erfc(z / math.sqrt(2))
    high = codes >= size / 2
    a, b = int(high.sum()), int(n - high.sum())
    if a == 0 or b == 0:
        run_p = 2.0 ** (1 - n)
    else:
        mean = 1 + 2 * a * b / n
        var = (mean - 1) * (mean - 2) / max(1, n - 1)
        run_p = _two_sided((1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(var)) if var > 0 else 1.0
    x = codes - codes.mean()
    power = float((x * x).sum())
    serial = _two_sided((float((x[1:] * x[:-1]).sum()) / power + 1 / n) * math.sqrt(n)) if power > 0 else 0.0
    return uniform, run_p, serial


def ordinary(counts: np.ndarray) -> np.ndarray:
    """log2 of each token byte's share among the corpus's token bytes, each counted once more than it occurs."""
    n = np.where(_TOKEN, counts + 1.0, 1.0)
    return np.log2(n / n[_TOKEN].sum())


def evidence(token: bytes, log_share: np.ndarray) -> float:
    """log2 of the token's e-value, minus infinity if no encoding stands the tests; log_share: see :func:`ordinary`."""
    token = token.strip(b"=")
    if len(token) < LEAST_TOKEN:
        return -math.inf
    raw = np.frombuffer(token, np.uint8)
    held = [(alphabet, place) for _, alphabet, place in _PLACED if place[raw].min() >= 0]
    if not held:
        return -math.inf
    alphabet, place = held[0]
    p = min(battery(place[raw], len(alphabet)))
    if p < LEVEL / 3:
        return -math.inf
    uniform = [-len(token) * math.log2(len(a)) for a, _ in held]
    mean = uniform[0] + math.log2(sum(2.0 ** (x - uniform[0]) for x in uniform) / len(ENCODINGS))
    # of all encodings that hold the token, the smallest makes it likeliest as ordinary text
    likeliest = float(log_share[raw].sum()) - len(token) * math.log2(float(np.exp2(log_share[alphabet]).sum()))
    return mean + math.log2(min(1.0, 3 * p)) - likeliest


def learn(df: DataFrame, text: str = "text", fdr: float = FDR) -> tuple[list[float], float]:
    """The corpus's byte statistics and the least log2 e-value that the e-BH rule accepts over all candidates of ``df``."""
    schema = T.StructType([T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("token", T.BinaryType())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, dtype=np.int64)
        for batch in batches:
            flat = []
            for part in sliced(batch):
                _, tokens, counts = found_in(part.column(0).to_pylist())
                total += counts
                flat += [b for own in tokens for _, _, b in own]
            yield pa.RecordBatch.from_arrays([pa.array([None] * len(flat), pa.list_(pa.int64())), pa.array(flat, pa.binary())], names=["counts", "token"])
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64())), pa.array([None], pa.binary())], names=["counts", "token"])

    seen = materialise(df.select(F.col(text).cast("string")).mapInArrow(gather, schema), "tokens")
    sums = seen.where("counts IS NOT NULL").select(F.posexplode("counts")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
    counts = np.zeros(256)
    for row in sums:
        counts[row["pos"]] = row["n"]
    share = ordinary(counts).tolist()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = np.array(share)
        for batch in batches:
            bins = [-1 if (e := evidence(t, logs)) <= 0 else min(_BINS, int(e * _BIN)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(bins, pa.int32())], names=["bin"])

    held = seen.where("token IS NOT NULL").select("token").mapInArrow(weigh, "bin int").groupBy("bin").agg(F.count("*").alias("n")).collect()
    discard(seen)
    tested, k, least = sum(r["n"] for r in held), 0, math.inf
    for row in sorted((r for r in held if r["bin"] >= 0), key=lambda r: -r["bin"]):
        k += row["n"]
        # each bin counts at its lower edge; the k-th largest e-value must reach tested / (fdr * k)
        if row["bin"] / _BIN >= math.log2(tested / (fdr * k)):
            least = row["bin"] / _BIN
    return share, least


def spans_in(texts: list[str | None], share: list[float], least: float) -> list[list[tuple[int, int, int, int]]]:
    """All spans (start, kind, end, start of the value) of each text, by start, then kind as listed in KINDS."""
    logs = np.array(share)
    patterns, tokens, _ = found_in(texts)
    out = []
    for own, candidates in zip(patterns, tokens):
        more = [(a, 3, b, a) for a, b, raw in candidates if not any(a < e and s < b for s, _, e, _ in own) and evidence(raw, logs) >= max(least, 1e-9)]
        out.append(sorted(own + more))
    return out


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("value", T.LongType())]))


def with_spans(df: DataFrame, text: str = "text", out: str = "spans", fdr: float = FDR) -> DataFrame:
    """Every row of ``df`` with its spans in ``out``: kind, start, end, and where the secret value itself starts."""
    share, least = learn(df, text, fdr)
    typed = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.int64())]))
    df = df.drop(out) if out != text else df
    rest = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                found = spans_in(part.column(0).to_pylist(), share, least)
                column = pa.array([[{"kind": KINDS[k], "start": a, "end": b, "value": v} for a, k, b, v in own] for own in found], typed)
                yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*part.schema.names, out])

    first = df.select(F.col(text).cast("string"), *rest)
    return first.mapInArrow(run, T.StructType([*first.schema.fields, T.StructField(out, _SPANS)])).select(*df.columns, out)


def redact(text: str, spans: list[dict]) -> str:
    """The text with the value of every span replaced; values that overlap become one placeholder."""
    parts, at = [], 0
    for start, end in sorted((s["value"], s["end"]) for s in spans):
        if end <= at:
            continue
        if start >= at:
            parts += [text[at:start], PLACEHOLDER]
        at = end
    return "".join([*parts, text[at:]])


def redacted(df: DataFrame, text: str = "text", n_chars: str | None = "n_chars", fdr: float = FDR) -> DataFrame:
    """``df`` with every secret value in ``text`` replaced by a placeholder and, if that column is there, its length mended."""
    hit = fresh(df, "hit")
    share, least = learn(df, text, fdr)
    first = df.select(F.col(text).cast("string"), *[c for c in df.columns if c != text])

    # spans are replaced where they are found: a second Python step would keep a second worker for each task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                texts = part.column(0).to_pylist()
                found = spans_in(texts, share, least)
                new = [redact(t, [{"value": v, "end": b} for _, _, b, v in own]) if own else t for t, own in zip(texts, found)]
                columns = [pa.array(new, part.schema.field(0).type), *part.columns[1:], pa.array([bool(own) for own in found], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, hit])

    new = first.mapInArrow(lean(run), T.StructType([*first.schema.fields, T.StructField(hit, T.BooleanType())]))
    if n_chars and n_chars in df.columns:
        new = new.withColumn(n_chars, F.when(F.col(hit), F.length(text).cast(df.schema[n_chars].dataType)).otherwise(F.col(n_chars)))
    return new.select(*df.columns)




def report(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts of pattern spans by kind, their digest, all spans as text, and the number of random tokens."""
    marked = with_spans(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    shown = lambda rows: F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return marked.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(shown(base), 256).alias("base_sha256"),
        shown(F.col("spans")).alias("spans"),
    )
