"""Lines of unified diffs as columns: where files and hunks begin, what each line is and its number, by vector over a batch.

A batch of texts is one array of bytes; only the header lines of files and hunks are looked at one by one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

# The header of a hunk, and the lines that tell about a file.
HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@(.*)"
HEADER_LINES = 10
KINDS = ("added", "removed", "context")
_ADDED, _REMOVED, _CONTEXT = 1, 2, 3
_GOOD, _GOOD_AT = re.compile(HUNK.encode()), re.compile(HUNK[1:].encode())
_BLANK = " \t\x0b\f\r"
#: So many blanks at the start of lines are passed by vector, more line by line.
_SHORT = 64
#: Bytes of text that are cut up at a time, or one text.
PART = 1 << 18


class Cut:
    """Line by line: ``row`` of its text, ``file`` (a place in ``file_at``, -1 for none), ``hunk`` (in ``hunk_at``, -1) and ``kind``."""

    def __init__(self, texts: pa.Array) -> None:
        texts = texts.cast(pa.large_string())
        _, ends, data = texts.buffers()
        off = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        self.raw = bytes(data[off[0] : off[-1]]) if data is not None else b""
        off, size = off - off[0], len(self.raw)
        self.data = np.frombuffer(self.raw + bytes(3), np.uint8)
        begins = np.zeros(size + 1, bool)
        begins[np.flatnonzero(self.data[:size] == 10) + 1] = True
        begins[off[:-1]] = True
        begins[size] = False
        self.start = np.flatnonzero(begins)
        after = np.append(self.start[1:], size) if len(self.start) else self.start
        self.end = after - (self.data[after - 1] == 10)
        self.row = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(self.start, off)))
        length = self.end - self.start
        byte = [np.where(length > k, self.data[self.start + k], 0) for k in range(3)]

        headers = [i for i in np.flatnonzero(byte[0] == ord("d")).tolist() if self._is_file(self.raw[self.start[i] : self.end[i]])]
        self.file_at = np.array(headers, np.int64)
        self.file, self.file_no = self._parts(self.file_at, self.row)
        self.hunk_at = np.flatnonzero((self.file >= 0) & (byte[0] == ord("@")) & (byte[1] == ord("@")))
        self.hunk, self.hunk_no = self._parts(self.hunk_at, self.file)
        heads = [_GOOD.match(self.raw[a:b]) for a, b in zip(self.start[self.hunk_at].tolist(), self.end[self.hunk_at].tolist())]
        self.good = np.array([m is not None for m in heads], bool)
        self.old = np.array([int(m[1]) if m else 0 for m in heads], np.int64)
        self.new = np.array([int(m[3]) if m else 0 for m in heads], np.int64)

        kind = np.zeros(len(self.start), np.int8)
        for sign, value in (("+", _ADDED), ("-", _REMOVED)):
            kind[(byte[0] == ord(sign)) & ~((byte[1] == ord(sign)) & (byte[2] == ord(sign)))] = value
        kind[byte[0] == ord(" ")] = _CONTEXT
        kind[(self.hunk < 0) | ~np.append(self.good, False)[self.hunk]] = 0
        self.kind, self.first = kind, byte[0]

    @staticmethod
    def _is_file(line: bytes) -> bool:
        return line.startswith(b"diff --git a/") and line.find(b" b/", 13) >= 0

    @staticmethod
    def _parts(at: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each line the last of the parts that begin at lines ``at`` before it in the same ``of``, else -1; and each part's number there."""
        begins = np.zeros(len(of), np.int64)
        begins[at] = 1
        part, own = np.cumsum(begins) - 1, of[at]
        part[(part < 0) | (of < 0) | (np.append(own, -2)[part] != of)] = -1
        return part, np.arange(len(at)) - np.searchsorted(own, own) + 1

    def strings(self, start: np.ndarray, end: np.ndarray) -> pa.Array:
        """The text from each start to its end, as strings; pieces are in order and don't overlap."""
        step = np.zeros(len(self.data) + 1, np.int8)
        step[start] += 1
        step[end] -= 1
        off = np.append(0, np.cumsum(end - start)).astype(np.int32)
        return pa.StringArray.from_buffers(len(start), pa.py_buffer(off), pa.py_buffer(self.data[np.cumsum(step, dtype=np.int8)[:-1] > 0]))

    def changed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Changed and context lines, each one's number as its kind counts, and its number in the file."""
        at = np.flatnonzero(self.kind)
        hunk, kind = self.hunk[at], self.kind[at]
        first = np.flatnonzero(np.append(True, hunk[1:] != hunk[:-1])[: len(hunk)])
        begin = np.repeat(first, np.diff(np.append(first, len(hunk))))

        def before(mine: np.ndarray) -> np.ndarray:
            n = np.cumsum(mine) - mine
            return n - n[begin]

        is_added, is_removed = kind == _ADDED, kind == _REMOVED
        start = np.where(is_added, self.new[hunk], self.old[hunk])
        added, removed = before(is_added), before(is_removed)
        # lines of the hunk before without removed ones, or without added ones
        place = np.arange(len(at)) - begin - np.where(is_added, removed, added)
        own = np.where(is_added, added, np.where(is_removed, removed, place - removed))
        return at, start + own, start + place

    def rank(self, lines: np.ndarray) -> np.ndarray:
        """How many lines of its own kind stand before each of ``lines``, all of one kind, in its hunk."""
        own = np.flatnonzero(self.kind == self.kind[lines[0]]) if len(lines) else lines
        return np.searchsorted(own, lines) - np.searchsorted(own, self.hunk_at[self.hunk[lines]])

    def per_file(self, lines: np.ndarray) -> pa.Array:
        return pa.array(np.bincount(self.file[lines], minlength=len(self.file_at)).astype(np.int64))


class Counted:
    """Files alone: where each begins (``at``), its ``row``, ``no``, ``additions`` and ``deletions``; lines are counted between headers, not told one by one."""

    def __init__(self, texts: pa.Array) -> None:
        texts = texts.cast(pa.large_string())
        _, ends, data = texts.buffers()
        off = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = b"".join([data[off[0] : off[-1]] if data is not None else b"", bytes(4)])
        off, size, data = off - off[0], len(raw) - 4, np.frombuffer(raw, np.uint8)
        begins = np.zeros(size + 1, bool)
        np.equal(data[:size], 10, out=begins[1:])
        begins[off[:-1]] = True
        begins[size] = False
        start = np.flatnonzero(begins)
        self.raw, self.start = raw, start
        after = np.append(start[1:], size) if len(start) else start
        self.end = after - (data[after - 1] == 10)
        bound = np.searchsorted(start, off)
        # the first four bytes of each line as one number; the last line of a text may have no line feed that ends it
        self.four = four = np.ndarray(max(0, len(data) - 3), "<u4", data, strides=(1,))[start]
        last = bound[1:][bound[1:] > bound[:-1]] - 1
        short = last[self.end[last] - start[last] < 4]
        four[short] &= (np.uint32(1) << (8 * (self.end[short] - start[short])).astype(np.uint32)) - np.uint32(1)

        span = lambda at: zip(at.tolist(), start[at].tolist(), self.end[at].tolist())
        self.at = np.array([i for i, a, b in span(np.flatnonzero(four == self._word(b"diff"))) if raw.startswith(b"diff --git a/", a, b) and raw.find(b" b/", a + 13, b) >= 0], np.int64)
        self.row = np.searchsorted(bound, self.at, side="right") - 1
        self.no = np.arange(len(self.at)) - np.searchsorted(self.row, self.row) + 1
        self.stop = np.minimum(np.append(self.at[1:], len(start))[: len(self.at)], bound[self.row + 1])
        hunk = np.flatnonzero((four & 0xFFFF) == self._word(b"@@"))
        of = np.searchsorted(self.at, hunk, side="right") - 1
        inside = (of >= 0) & (hunk < np.append(self.stop, 0)[of])
        hunk, of = hunk[inside], of[inside]
        stop = np.minimum(np.append(hunk[1:], len(start))[: len(hunk)], self.stop[of])
        good = np.array([_GOOD_AT.match(raw, a, b) is not None for _, a, b in span(hunk)], bool)

        def count(sign: bytes) -> np.ndarray:
            mine = ((four & 0xFF) == self._word(sign)) & ((four & 0xFFFFFF) != self._word(sign * 3))
            n = np.append(0, np.cumsum(mine))
            return np.bincount(of[good], (n[stop] - n[hunk])[good], minlength=len(self.at)).astype(np.int64)

        self.additions, self.deletions = count(b"+"), count(b"-")

    @staticmethod
    def _word(begin: bytes) -> np.uint32:
        return np.uint32(int.from_bytes(begin, "little"))

    def first(self) -> pa.Array:
        """The header line of each file."""
        at = self.start[self.at], self.end[self.at]
        off = np.append(0, np.cumsum(at[1] - at[0])).astype(np.int32)
        return pa.StringArray.from_buffers(len(self.at), pa.py_buffer(off), pa.py_buffer(b"".join([self.raw[a:b] for a, b in zip(*(x.tolist() for x in at))])))

    def modes(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether each file's first lines call it new (1), deleted (2) or neither (0), the last that does so; and whether one calls it binary."""
        n = np.minimum(self.stop - self.at, HEADER_LINES)
        told = np.repeat(self.at - np.append(0, np.cumsum(n))[:-1], n) + np.arange(n.sum())
        of, mode, binary = np.repeat(np.arange(len(n)), n), np.zeros(len(n), np.int64), np.zeros(len(n), bool)
        for begin, value in ((b"new file mode", 1), (b"deleted file mode", 2)):
            likely = np.flatnonzero(self.four[told] == self._word(begin[:4]))
            line = told[likely]
            true = np.array([self.raw.startswith(begin, a, b) for a, b in zip(self.start[line].tolist(), self.end[line].tolist())], bool)
            # places among the first lines, so that the last one counts
            np.maximum.at(mode, of[likely[true]], (line[true] - self.at[of[likely[true]]]) * 4 + value)
        found = self.raw.find(b"Binary files")
        while found >= 0:
            i = int(np.searchsorted(self.start, found, side="right")) - 1
            f = int(np.searchsorted(self.at, i, side="right")) - 1
            if f >= 0 and i < self.at[f] + n[f] and self.raw.find(b"Binary files", self.start[i], self.end[i]) >= 0 and self.raw.find(b"differ", self.start[i], self.end[i]) >= 0:
                binary[f] = True
            found = self.raw.find(b"Binary files", int(self.end[i]))
        return mode % 4, binary


def _mapped(diffs: DataFrame, schema: str, made: Callable[[Cut | Counted, pa.Array], list[pa.Array]], cut: type = Cut) -> DataFrame:
    """Rows that ``made`` gives for each part of the diffs (diff_id, diff_text), cut up by ``cut``."""
    kind = diffs.schema["diff_id"].dataType.simpleString()
    names = ["diff_id", *[f.name for f in StructType.fromDDL(schema)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART, side="right")))
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays(made(cut(part.column(1)), part.column(0)), names=names)
                at = to

    return diffs.select("diff_id", "diff_text").mapInArrow(run, f"diff_id {kind}, {schema}")


def _int(x: np.ndarray) -> pa.Array:
    return pa.array(x).cast(pa.int32())


def hunk_rows(diffs: DataFrame, text: bool = True) -> DataFrame:
    """One row (diff_id, file, hunk, header, no_newline, and its ``text`` if asked) for each hunk with a readable header."""

    def made(cut: Cut, ids: pa.Array) -> list[pa.Array]:
        at = cut.hunk_at[cut.good]
        marked = np.bincount(cut.hunk[(cut.first == ord("\\")) & (cut.hunk >= 0)], minlength=len(cut.hunk_at)) > 0
        out = [ids.take(pa.array(cut.row[at])), _int(cut.file_no[cut.file[at]]), _int(cut.hunk_no[cut.good]), cut.strings(cut.start[at], cut.end[at]), pa.array(marked[cut.good])]
        if not text:
            return out
        # a hunk ends where the next begins, or its file, or its text
        last = np.append(np.flatnonzero(np.diff(cut.hunk)), len(cut.hunk) - 1) if len(cut.hunk) else np.zeros(0, np.int64)
        last = last[cut.hunk[last] >= 0][cut.good]
        stop = np.minimum(cut.end[last] + 1, np.append(cut.start, len(cut.raw))[last + 1])
        return [*out, cut.strings(cut.start[at], stop)]

    return _mapped(diffs, "file int, hunk int, header string, no_newline boolean" + ", text string" * text, made)


def change_rows(diffs: DataFrame, holding: tuple[str, ...] = ()) -> DataFrame:
    """One row for each changed or context line, or of those for each that holds one of some texts."""

    def made(cut: Cut, ids: pa.Array) -> list[pa.Array]:
        at, number, true = cut.changed()
        content = cut.strings(cut.start[at] + 1, cut.end[at])
        if holding:
            keep = np.zeros(len(at), bool)
            for text in holding:
                keep |= pc.match_substring(content, text).to_numpy(zero_copy_only=False)
            at, number, true, content = at[keep], number[keep], true[keep], content.filter(pa.array(keep))
        kind = pa.array(KINDS).take(pa.array(cut.kind[at] - 1))
        hunk = cut.hunk[at]
        return [ids.take(pa.array(cut.row[at])), _int(cut.file_no[cut.file[at]]), _int(cut.hunk_no[hunk]), _int(at - cut.hunk_at[hunk]), kind, _int(number), _int(true), content]

    return _mapped(diffs, "file int, hunk int, at int, kind string, line_number int, true_line int, content string", made)


def line_sums(diffs: DataFrame) -> DataFrame:
    """One row (diff_id, file, kind, n, numbers, true_lines) for each kind of line in a file: how many, and the sums of their numbers."""

    def made(cut: Cut, ids: pa.Array) -> list[pa.Array]:
        at, number, true = cut.changed()
        kind, file = cut.kind[at], cut.file[at]
        files, sums = [], []
        for k in (_ADDED, _REMOVED, _CONTEXT):
            own = np.flatnonzero(kind == k)
            of = file[own]
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1])[: len(of)])
            files.append(of[first])
            sums.append([np.diff(np.append(first, len(of))), *(np.add.reduceat(x[own], first) if len(first) else x[:0] for x in (number, true))])
        n = [len(f) for f in files]
        of = np.concatenate(files)
        told = pa.array(KINDS).take(pa.array(np.repeat(np.arange(len(KINDS)), n)))
        return [ids.take(pa.array(cut.row[cut.file_at[of]])), _int(cut.file_no[of]), told, *(pa.array(np.concatenate(x)) for x in zip(*sums))]

    return _mapped(diffs, "file int, kind string, n long, numbers long, true_lines long", made)


_COUNTS = ("import_changes", "function_additions", "function_deletions", "comment_changes")


def file_rows(diffs: DataFrame, counted: bool = False) -> DataFrame:
    """One row for each file: its first ten lines, its added and removed lines, and if asked the kinds of lines among them."""

    def made(cut: Cut, ids: pa.Array) -> list[pa.Array]:
        at = cut.file_at
        n = np.minimum(np.bincount(cut.file[cut.file >= 0], minlength=len(at)), HEADER_LINES)
        off = np.append(0, np.cumsum(n)).astype(np.int32)
        told = np.repeat(at - off[:-1], n) + np.arange(off[-1])
        head = pa.ListArray.from_arrays(pa.array(off), cut.strings(cut.start[told], cut.end[told]))
        sums = [cut.per_file(np.flatnonzero(cut.kind == k)) for k in (_ADDED, _REMOVED)]
        more = _kinds(cut) if counted else []
        return [ids.take(pa.array(cut.row[at])), _int(cut.file_no), head, *sums, *more]

    more = "".join(f", {c} long" for c in _COUNTS) if counted else ""
    return _mapped(diffs, "file int, head array<string>, additions long, deletions long" + more, made)


def slim_rows(diffs: DataFrame) -> DataFrame:
    """One row for each file: its header, whether it is new (1), deleted (2) or neither (0), whether binary, and its added and removed lines."""

    def made(cut: Counted, ids: pa.Array) -> list[pa.Array]:
        mode, binary = cut.modes()
        return [ids.take(pa.array(cut.row)), _int(cut.no), cut.first(), _int(mode), pa.array(binary), pa.array(cut.additions), pa.array(cut.deletions)]

    return _mapped(diffs, "file int, first string, mode int, is_binary boolean, additions long, deletions long", made, Counted)


def top_rows(diffs: DataFrame, top: int) -> DataFrame:
    """One row for each diff: its files, added and removed lines, and the headers and changes of its ``top`` most changed files."""

    def made(cut: Counted, ids: pa.Array) -> list[pa.Array]:
        changes = cut.additions + cut.deletions
        order = np.lexsort((cut.no, -changes, cut.row))
        row = cut.row[order]
        kept = order[np.arange(len(row)) - np.searchsorted(row, row) < top]
        per_diff = lambda x=None: pa.array(np.bincount(cut.row, x, minlength=len(ids)).astype(np.int64))
        off = np.append(0, np.cumsum(np.bincount(cut.row[kept], minlength=len(ids)))).astype(np.int32)
        files = pa.StructArray.from_arrays([cut.first().take(pa.array(kept)), pa.array(changes[kept])], names=["first", "changes"])
        return [ids, per_diff(), per_diff(cut.additions), per_diff(cut.deletions), pa.ListArray.from_arrays(pa.array(off), files)]

    return _mapped(diffs, "total_files long, total_additions long, total_deletions long, top array<struct<first: string, changes: bigint>>", made, Counted)


def _texts(cut: Cut, at: np.ndarray) -> np.ndarray:
    """Where the text of each changed line begins, past its sign and the white space after it."""
    place, end, blank = cut.start[at] + 1, cut.end[at], np.isin(np.arange(256), list(_BLANK.encode()))
    open_ = np.arange(len(at))
    for _ in range(_SHORT):
        open_ = open_[(place[open_] < end[open_]) & blank[cut.data[place[open_]]]]
        if not len(open_):
            return place
        place[open_] += 1
    for i in open_.tolist():
        line = cut.raw[place[i] : end[i]]
        place[i] += len(line) - len(line.lstrip(_BLANK.encode()))
    return place


def _kinds(cut: Cut) -> list[pa.Array]:
    """Changed imports, functions and comments of each file; a removed definition that an added one of its number repeats counts as added."""
    at = np.flatnonzero((cut.kind == _ADDED) | (cut.kind == _REMOVED))
    place = _texts(cut, at)
    room = cut.end[at] - place
    data = np.concatenate([cut.data, np.zeros(8, np.uint8)])
    # the eight bytes from each place on as one number
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))[place]

    def begins(*words: str) -> np.ndarray:
        out = np.zeros(len(at), bool)
        for w in words:
            head = w.encode()[:8]
            same = ((eight & np.uint64((1 << 8 * len(head)) - 1)) == np.uint64(int.from_bytes(head, "little"))) & (room >= len(w))
            for k in range(8, len(w)):
                same[same] = data[place[same] + k] == ord(w[k])
            out |= same
        return out

    added = cut.kind[at] == _ADDED
    defines = begins("def ", "function ", "class ")
    new, gone = np.flatnonzero(defines & added), np.flatnonzero(defines & ~added)
    # a removed one's twin has the same text, so it is a definition as well; most have none of their number
    name = lambda i, start: cut.hunk[at[i]] * 1_000_003 + start[cut.hunk[at[i]]] + cut.rank(at[i])
    at_place = lambda i, start: [(int(cut.hunk[x]), int(start[cut.hunk[x]] + r), cut.raw[cut.start[x] + 1 : cut.end[x]]) for x, r in zip(at[i].tolist(), cut.rank(at[i]).tolist())]
    if len(new) and len(gone):
        new_name, gone_name = name(new, cut.new), name(gone, cut.old)
        new, gone = new[np.isin(new_name, gone_name)], gone[np.isin(gone_name, new_name)]
        came = set(at_place(new, cut.new))
        added[gone[np.array([x in came for x in at_place(gone, cut.old)], bool)]] = True
    comments = begins("#", "//", "/*", "*") & ~begins("#include")
    return [cut.per_file(at[x]) for x in (begins("import ", "from ", "#include", "require("), defines & added, defines & ~added, comments)]
