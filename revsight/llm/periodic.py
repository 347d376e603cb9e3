"""Periodic run detection on grammar-compressed texts.

A run is a stretch of consecutive words with smallest period q and at least max(``LEAST``, 2 q) words that no neighbouring
word extends.  Texts are worked on as word numbers, in blocks of texts, in four steps.

1. A word of a run lies in a window of ``GRAM`` words that recurs in its text, since words of a run match the words q away
   over at least ``GRAM`` places.  Only stretches that such windows cover go on; they hold every run whole.
2. Re-Pair (Larsson and Moffat, 2000): rounds replace pairs of symbols that repeat by nonterminals, the most frequent of
   the pairs that overlap first, until nothing repeats.  What is left of each stretch is halved into a balanced tree.
3. A run crosses the middle of exactly one derivation node that holds it whole: the lowest.  So runs across the middle of
   each nonterminal are computed once, at its first derivation: words that recur around the middle give the periods to try,
   and common extensions to both sides the ends.  A recurrence inside a run found already is a multiple of its period.
4. Those runs are moved to all derivation positions of their nonterminal.  A run that neighbouring words extend there is
   part of a longer one across the middle of a higher node, and is merged into that one.

Extensions compare prefix hashes modulo two primes (62 bits); windows, words and the ends of runs at each position are
compared exactly.  Texts are independent, so a lost executor costs its texts alone; a block is bounded by ``WORDS`` words or
one text, and candidates are tried ``_CHUNK`` at a time.

Defined results: a null text counts as the empty one and has no runs; equal rows get equal results, each on its own row; a
text's runs come by start, then period; an empty table gives an empty result; other columns are left alone whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import fresh

LEAST = 12
#: A run of q <= LEAST / 2 matches itself over LEAST - q words, any other over q: never over fewer.
GRAM = LEAST // 2
#: Words that one block of texts holds before it is worked on, and characters that are turned to words at a time.
WORDS, CHARS = 400_000, 4_000_000
_KNOWN = 400_000
_CHUNK = 1 << 18
_PRIMES = (2_147_483_647, 2_147_483_629)
_BASES = (1_103_515_245, 1_664_525_123)
_MIX = np.uint64(0x9E3779B97F4A7C15)

Runs = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


class Numbers(dict):
    """Word -> number, in the order of first sight."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def covered(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which words lie in a window of ``GRAM`` words that recurs in its text; texts begin at ``starts``, the last ends there."""
    n = len(words) - GRAM + 1
    out = np.zeros(len(words), bool)
    if n <= 1:
        return out
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    h = text[:n].astype(np.uint64) * _MIX
    x = words.astype(np.uint64)
    for k in range(GRAM):
        h = (h ^ (x[k : k + n] + np.uint64(1))) * _MIX
        h ^= h >> np.uint64(29)
    whole = np.flatnonzero(text[:n] == text[GRAM - 1 :])
    h = h[whole]
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(words) + 1, np.int32)
    at = whole[twice]
    step[at] += 1
    step[at + GRAM] -= 1
    return np.cumsum(step[:-1]) > 0


def stretches(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(first, end) of the covered stretches of at least ``LEAST`` words; none crosses texts."""
    inside = covered(words, starts)
    if not inside.any():
        return np.zeros((0, 2), np.int64)
    begins = np.zeros(len(words) + 1, bool)
    begins[starts] = True
    edge = np.ones(len(words), bool)
    edge[1:] = (inside[1:] != inside[:-1]) | begins[1:-1]
    first = np.flatnonzero(edge)
    end = np.append(first[1:], len(words))
    keep = inside[first] & (end - first >= LEAST)
    return np.stack([first[keep], end[keep]], axis=1)


class Grammar:
    """Re-Pair over a sequence of symbols, of which those from ``fence`` on stand between stretches and join no pair.

    ``left``, ``size``: first part and length of each nonterminal, numbered from ``base``.  ``symbols``, ``places``: every
    derivation of a nonterminal of ``LEAST`` words or more, and where its text begins.
    """

    def __init__(self, sequence: np.ndarray, fence: int) -> None:
        self.base = int(sequence.max()) + 1
        self.left: list[np.ndarray] = []
        self.size = np.ones(self.base, np.int64)
        self.symbols: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self._fence, self._rules = fence, {}
        symbols, places = self._paired(sequence.astype(np.int64), np.arange(len(sequence)))
        self._halved(symbols, places)

    def _is_fence(self, symbols: np.ndarray) -> np.ndarray:
        return (symbols >= self._fence) & (symbols < self.base)

    def _add(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """New nonterminals for pairs."""
        first = len(self.size)
        self.size = np.concatenate([self.size, self.size[left] + self.size[right]])
        self.left.append(left)
        return np.arange(first, first + len(left))

    def _derived(self, symbols: np.ndarray, places: np.ndarray) -> None:
        long = self.size[symbols] >= LEAST
        self.symbols.append(symbols[long])
        self.places.append(places[long])

    def _paired(self, symbols: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        while len(symbols) > 1:
            code = (symbols[:-1] << 31) | symbols[1:]
            bar = self._is_fence(symbols)
            at = np.flatnonzero(~(bar[:-1] | bar[1:]))
            pairs, which, count = np.unique(code[at], return_inverse=True, return_counts=True)
            order = np.empty(len(pairs), np.int64)
            order[np.lexsort((pairs, count))] = np.arange(len(pairs))
            order[count < 2] = -1
            rank = np.full(len(code), -1, np.int64)
            rank[at] = order[which]
            # a pair is replaced where it outranks the pairs that overlap it; in a row of one symbol, every second time
            first = np.flatnonzero(np.append(True, rank[1:] != rank[:-1]))
            end = np.append(first[1:], len(rank))
            near = np.concatenate([[-1], rank[first], [-1]])
            wins = (near[1:-1] > near[:-2]) & (near[1:-1] > near[2:])
            many = (end - first)[wins]
            offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            chosen = (np.repeat(first[wins], many) + offset)[offset % 2 == 0]
            if not len(chosen) or len(chosen) * 64 < len(symbols):
                break
            rules, which = np.unique(code[chosen], return_inverse=True)
            known = np.array([self._rules.get(r, -1) for r in rules.tolist()], np.int64)
            new = known < 0
            known[new] = self._add(rules[new] >> 31, rules[new] & 0x7FFFFFFF)
            self._rules.update(zip(rules[new].tolist(), known[new].tolist()))
            symbols, places = self._replaced(symbols, places, chosen, known[which])
        return symbols, places

    def _replaced(self, symbols: np.ndarray, places: np.ndarray, chosen: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        symbols[chosen] = by
        self._derived(by, places[chosen])
        keep = np.ones(len(symbols), bool)
        keep[chosen + 1] = False
        return symbols[keep], places[keep]

    def _halved(self, symbols: np.ndarray, places: np.ndarray) -> None:
        while True:
            bar = self._is_fence(symbols)
            fences = np.flatnonzero(bar)
            here = np.arange(len(symbols))
            offset = here - fences[np.cumsum(bar) - 1] - 1
            chosen = np.flatnonzero(~bar[:-1] & ~bar[1:] & (offset[:-1] % 2 == 0))
            if not len(chosen):
                return
            by = self._add(symbols[chosen], symbols[chosen + 1])
            symbols, places = self._replaced(symbols, places, chosen, by)


class Extensions:
    """Longest common extensions of a sequence with itself, for arrays of places, by prefix hashes and binary search."""

    def __init__(self, sequence: np.ndarray) -> None:
        self.n = len(sequence)
        self.tables = []
        for prime, base in zip(_PRIMES, _BASES):
            power = np.ones(1, np.int64)
            step = base % prime
            while len(power) <= self.n:
                power = np.concatenate([power, power * step % prime])
                step = step * step % prime
            sums = np.zeros(self.n + 1, np.int64)
            np.cumsum((sequence + 1) % prime * power[: self.n] % prime, out=sums[1:])
            self.tables.append((prime, power, sums % prime))

    def _equal(self, i: np.ndarray, j: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Whether the m symbols from i on equal those from j on, i < j."""
        out = np.ones(len(i), bool)
        for prime, power, sums in self.tables:
            out &= (sums[i + m] - sums[i]) % prime * power[j - i] % prime == (sums[j + m] - sums[j]) % prime
        return out

    def _longest(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        low, high = np.zeros(len(i), np.int64), np.maximum(most, 0)
        # double the reach first: most extensions are short
        step = np.ones(len(i), np.int64)
        live = np.flatnonzero(high > 0)
        while len(live):
            m = np.minimum(step[live], high[live])
            fits = self._equal(i[live] - m if back else i[live], j[live] - m if back else j[live], m)
            low[live[fits]] = m[fits]
            high[live[~fits]] = m[~fits] - 1
            step[live] *= 2
            live = live[fits & (m < high[live])]
        live = np.flatnonzero(low < high)
        while len(live):
            m = (low[live] + high[live] + 1) // 2
            fits = self._equal(i[live] - m if back else i[live], j[live] - m if back else j[live], m)
            low[live[fits]] = m[fits]
            high[live[~fits]] = m[~fits] - 1
            live = live[low[live] < high[live]]
        return low

    def forward(self, i: np.ndarray, j: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How many symbols from i and from j on agree, those from j before ``end``."""
        return self._longest(i, j, end - j, back=False)

    def backward(self, i: np.ndarray, j: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """How many symbols before i and before j agree, those before i not before ``begin``."""
        return self._longest(i, j, i - begin, back=True)


def _grams(sequence: np.ndarray) -> np.ndarray:
    """A number for each window of ``GRAM`` (six) symbols, equal only for equal windows."""
    name = lambda a, b: np.unique((a << 31) | b, return_inverse=True)[1].astype(np.int64)
    two = name(sequence[:-1], sequence[1:])
    four = name(two[:-2], two[2:])
    return name(four[:-2], two[4:])


def _crossing(sequence: np.ndarray, begin: np.ndarray, middle: np.ndarray, end: np.ndarray) -> Runs:
    """Runs (node, start, end, period) across the middle of each node, as far as they lie in it."""
    n = len(sequence)
    extend = Extensions(sequence)
    gram = _grams(sequence)
    order = np.argsort(gram, kind="stable")
    keys = gram[order] * n + order  # sorted: by window, then by place
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    found: list[Runs] = []

    def tried(node: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Extend windows at i < j, keep what is a run across the middle; the ends of all."""
        start = i - extend.backward(i, j, begin[node])
        stop = j + GRAM + extend.forward(i + GRAM, j + GRAM, end[node])
        period = j - i
        good = (stop - start >= np.maximum(LEAST, 2 * period)) & (start < middle[node]) & (stop > middle[node])
        found.append((node[good], start[good], stop[good], period[good]))
        return start, stop

    def expanded(node: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, earlier: bool) -> None:
        """Try each window with its recurrences from ``low`` to ``high`` in the sorted order."""
        many = np.maximum(high - low, 0)
        ends = np.cumsum(many)
        at = 0
        while at < len(many):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _CHUNK, side="right")))
            k = np.repeat(np.arange(at, stop), many[at:stop])
            within = np.arange(len(k)) - np.repeat(ends[at:stop] - many[at:stop] - (ends[at - 1] if at else 0), many[at:stop])
            # one window of very many recurrences is cut as well
            for a in range(0, len(k), _CHUNK):
                kk = k[a : a + _CHUNK]
                other = order[low[kk] + within[a : a + _CHUNK]]
                tried(node[kk], *((other, place[kk]) if earlier else (place[kk], other)))
            at = stop

    nodes = np.arange(len(begin))
    for a in range(0, len(nodes), _CHUNK):
        part = nodes[a : a + _CHUNK]
        for k in range(1, GRAM + 1):
            # a whole period to the right: the word before the middle lies in a window that recurs later
            place = middle[part] - k
            ok = (place >= begin[part]) & (place + GRAM <= end[part])
            node, place = part[ok], place[ok]
            after = np.minimum(rank[place] + 1, len(order) - 1)
            ok = (rank[place] + 1 < len(order)) & (gram[order[after]] == gram[place]) & (order[after] + GRAM <= end[node])
            node, place, after = node[ok], place[ok], after[ok]
            if len(node):
                _, stop = tried(node, place, order[after])
                name = gram[place] * n
                expanded(node, place, np.searchsorted(keys, name + stop - GRAM + 1), np.searchsorted(keys, name + end[node] - GRAM, side="right"), earlier=False)
        for k in range(GRAM):
            # a whole period to the left: the word after the middle lies in a window that occurs earlier
            place = middle[part] - k
            ok = (place >= begin[part]) & (place + GRAM <= end[part])
            node, place = part[ok], place[ok]
            before = np.maximum(rank[place] - 1, 0)
            ok = (rank[place] > 0) & (gram[order[before]] == gram[place]) & (order[before] >= begin[node])
            node, place, before = node[ok], place[ok], before[ok]
            if len(node):
                start, _ = tried(node, order[before], place)
                name = gram[place] * n
                expanded(node, place, np.searchsorted(keys, name + begin[node]), np.searchsorted(keys, name + start), earlier=True)
    return _least_periods(*[np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in range(4)])


def _least_periods(node: np.ndarray, start: np.ndarray, stop: np.ndarray, period: np.ndarray) -> Runs:
    """One row for each node and interval: a stretch of two periods has all its longer periods as multiples of the smallest."""
    order = np.lexsort((period, stop, start, node))
    node, start, stop, period = node[order], start[order], stop[order], period[order]
    first = np.ones(len(node), bool)
    first[1:] = (node[1:] != node[:-1]) | (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    return node[first], start[first], stop[first], period[first]


def runs_of(words: np.ndarray, starts: np.ndarray) -> Runs:
    """Runs (text, start, length, period) of texts of word numbers, by text, start, period; text k begins at ``starts[k]``."""
    parts = stretches(words, starts)
    if not len(parts):
        return (np.zeros(0, np.int64),) * 4
    _, numbers = np.unique(words, return_inverse=True)
    fence = int(numbers.max()) + 1
    size = parts[:, 1] - parts[:, 0]
    base = np.cumsum(size + 1) - size  # a fence stands before each stretch and after the last
    sequence = np.empty(int(size.sum()) + len(parts) + 1, np.int64)
    fences = np.append(base - 1, len(sequence) - 1)
    sequence[fences] = fence + np.arange(len(fences))
    offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    sequence[np.repeat(base, size) + offset] = numbers[np.repeat(parts[:, 0], size) + offset]

    grammar = Grammar(sequence, fence)
    symbols, places = np.concatenate(grammar.symbols), np.concatenate(grammar.places)
    order = np.lexsort((places, symbols))
    symbols, places = symbols[order], places[order]
    nodes, first, derived = np.unique(symbols, return_index=True, return_counts=True)
    left = np.concatenate(grammar.left)
    begin = places[first]
    middle, end = begin + grammar.size[left[nodes - grammar.base]], begin + grammar.size[nodes]
    node, start, stop, period = _crossing(sequence, begin, middle, end)

    many = derived[node]
    own = np.repeat(np.arange(len(node)), many)
    turn = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
    move = places[first[node[own]] + turn] - begin[node[own]]
    start, stop, period = start[own] + move, stop[own] + move, period[own]
    whole = (sequence[start - 1] != sequence[start - 1 + period]) & (sequence[stop] != sequence[stop - period])
    _, start, stop, period = _least_periods(np.zeros(int(whole.sum()), np.int64), start[whole], stop[whole], period[whole])
    part = np.searchsorted(base, start, side="right") - 1
    at = start - base[part] + parts[part, 0]
    text = np.searchsorted(starts, at, side="right") - 1
    out = (text, at - starts[text], stop - start, period)
    order = np.lexsort((out[3], out[1], out[0]))
    return tuple(c[order] for c in out)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))), T.StructField("collapsed", T.StringType())])


def _judged(texts: list[list[bytes]], numbers: Numbers) -> pa.StructArray:
    """n_words, runs and the words outside repeats, joined by a space, of each text (a list of words)."""
    if len(numbers) > _KNOWN:
        numbers.clear()
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    words = np.fromiter((numbers[w] for t in texts for w in t), np.int64, int(starts[-1]))
    text, start, length, period = runs_of(words, starts)
    ends = np.searchsorted(text, np.arange(len(texts) + 1))
    kept = []
    for k, own in enumerate(texts):
        a, b = ends[k], ends[k + 1]
        if a < b:
            step = np.zeros(len(own) + 1, np.int64)
            np.add.at(step, start[a:b] + period[a:b], 1)
            np.add.at(step, start[a:b] + length[a:b], -1)
            own = [own[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]
        kept.append(b" ".join(own).decode("utf-8", "surrogatepass"))
    runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (start, length, period)], fields=list(_RUN)))
    return pa.StructArray.from_arrays([pa.array(np.diff(starts)), runs, pa.array(kept, pa.string())], names=["n_words", "runs", "collapsed"])


def _blocks(column: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    """The words of the texts of a column in blocks of about ``WORDS`` words, each with the number of its first text."""
    at, held, n = 0, [], 0
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // CHARS)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(column)]):
        for text in column.slice(a, b - a).to_pylist():
            held.append(text.encode("utf-8", "surrogatepass").split() if text else [])
            n += len(held[-1])
            if n >= WORDS:
                yield at, held
                at, held, n = at + len(held), [], 0
    if held:
        yield at, held


def with_runs(df: DataFrame, text: str = "text", out: str = "repetition") -> DataFrame:
    """Every row of ``df`` with a struct ``out``: n_words, runs (start, length, period) and the collapsed text.

    The collapsed text is the words, joined by a space, that no run holds after its first period.
    """
    df = df.drop(out) if out != text else df
    own = fresh(df, "repeat_text")
    rest = list(df.columns)
    first = df.select(F.col(text).cast("string").alias(own), *rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers()
        for batch in batches:
            for at, texts in _blocks(batch.column(0)):
                part = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], _judged(texts, numbers)], names=[*rest, out])

    return first.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, _FOUND)]))


def planted(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` in which the texts of some ids end in repeats of their own words; which and how follows from the id's CRC."""
    h = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    new = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " ")
    return df.withColumn(text, F.when((h % 10 == 0) & (n > 0), new).otherwise(F.col(text)))


def report(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document, after planting: its runs counted, the longest, and digests of all runs and of what is kept."""
    slim = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = with_runs(planted(slim)).select("doc_id", "repetition.*")

    def longer(best: Column, x: Column) -> Column:
        return F.when(best.isNull() | (x["length"] > best["length"]), x).otherwise(best)  # in order of start, then period

    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate("runs", none, longer)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
