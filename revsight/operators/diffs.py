"""Unified diffs: files, hunks and lines by cutting texts at their headers, without a window or a shuffle.

Texts are cut by :mod:`.difflines`, a batch at a time; what the headers and lines say is asked of its rows by expressions.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import after_dot
from ..functions.scores import round2
from .difflines import HUNK, change_rows, file_rows, hunk_rows, line_sums, slim_rows, top_rows
from .rules import CHANGED_DEFINITIONS, CRITICAL_HOLD, CRITICAL_PATHS, DEFINITIONS_HOLD

# Fixed value: the header of a file.
HEADER = r"^diff --git a/(.*?) b/(.*)"


#: Java line ends and multi-line anchors that know \n only.
_SECTION, _HUNK_START = r"(?md)(?=^diff --git a/.*? b/)", r"(?md)(?=^@@)"
_GOOD_HUNK = "(?d)" + HUNK


def sections(diffs: DataFrame) -> DataFrame:
    """One row (diff_id, file, text) for each file of each diff: its part of the text, from its header on."""
    parts = F.filter(F.split("diff_text", _SECTION), lambda p: p.rlike("(?d)" + HEADER))
    return diffs.select("diff_id", F.posexplode(parts).alias("file", "text")).withColumn("file", F.col("file") + 1)


def pieces(diffs: DataFrame) -> DataFrame:
    """One row (diff_id, file, hunk, text) for the head of each file, hunk 0, and for all that starts with @@, from 1 on."""
    return sections(diffs).select("diff_id", "file", F.posexplode(F.split("text", _HUNK_START)).alias("hunk", "text"))


def _rows(text: Column) -> Column:
    """The lines of a piece; the line feed before the next piece ends the last."""
    whole = F.when(text.endswith("\n"), F.substr(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    return F.split(whole, "\n")


def _kind(line: Column) -> Column:
    marked = F.when(line.startswith("+") & ~line.startswith("+++"), "added").when(line.startswith("-") & ~line.startswith("---"), "removed")
    return marked.when(line.startswith(" "), "context").when(line.startswith("\\"), "no_newline").otherwise("other")


def lines(diffs: DataFrame) -> DataFrame:
    """Every line of every file part: diff_id, file, hunk, its place in the hunk, text and kind; lines before the first file are none."""
    rows = pieces(diffs).select("diff_id", "file", "hunk", F.posexplode(_rows(F.col("text"))).alias("at", "text"))
    first = F.when(F.col("text").rlike("(?d)" + HUNK), "hunk").otherwise("bad_hunk")
    return rows.withColumn("kind", F.when(F.col("hunk") == 0, "head").when(F.col("at") == 0, first).otherwise(_kind(F.col("text"))))


def hunks(diffs: DataFrame, text: bool = True) -> DataFrame:
    """Hunks with a readable header: old_start, old_count, new_start, new_count, context, whether the last line has no line feed, and its text if asked."""
    part = lambda i: F.regexp_extract("header", _GOOD_HUNK, i)
    count = lambda i: F.when(part(i) == "", 1).otherwise(part(i).try_cast("int"))
    return hunk_rows(diffs, text).select(
        "diff_id",
        "file",
        "hunk",
        part(1).cast("int").alias("old_start"),
        count(2).alias("old_count"),
        part(3).cast("int").alias("new_start"),
        count(4).alias("new_count"),
        F.trim(part(5)).alias("context"),
        "no_newline",
        *(["text"] if text else []),
    )


def changes(diffs: DataFrame, holding: tuple[str, ...] = ()) -> DataFrame:
    """Changed and context lines with their number: the hunk's start plus the lines of that kind before, and, in ``true_line``, the number in the file.

    With ``holding`` only lines that hold one of these texts are handed on; their numbers are the same.
    """
    return change_rows(diffs, holding)


def change_sums(diffs: DataFrame) -> DataFrame:
    """Per file and kind of line: how many :func:`changes` there are, and the sums of both their numbers; only sums leave a batch."""
    return line_sums(diffs).groupBy("diff_id", "file", "kind").agg(*[F.sum(c).alias(c) for c in ("n", "numbers", "true_lines")])


def files(diffs: DataFrame, counted: bool = False) -> DataFrame:
    """One row per file: paths, kind of change, mode, binary flag, hashes and counts; the first ten lines tell.

    Everything is read off a file's own part of the text, so nothing is shuffled.  ``counted``: kinds of changed lines as well.
    """
    last = lambda test, value: value(F.try_element_at(F.filter("head", test), F.lit(-1)))
    any_line = lambda test: F.exists("head", test)
    name = lambda x: F.trim(F.substring(x, 5, 1 << 30))
    is_old, is_new = (lambda x: x.startswith("---") & (name(x) != "/dev/null")), (lambda x: x.startswith("+++") & (name(x) != "/dev/null"))
    # only the first of a file's lines can be its header
    first = F.get("head", F.lit(0))
    mode = lambda x: x.startswith("new file mode") | x.startswith("deleted file mode")
    path = lambda i: F.when(first.rlike(HEADER), F.regexp_extract(first, HEADER, i))
    cut = file_rows(diffs, counted)
    out = cut.select(
        "diff_id",
        "file",
        path(2).alias("file_path"),
        # the leading characters a, b and / are taken off as a set
        F.coalesce(last(is_old, lambda x: F.ltrim(name(x), F.lit("a/"))), path(1)).alias("old_file"),
        F.coalesce(last(is_new, lambda x: F.ltrim(name(x), F.lit("b/"))), path(2)).alias("new_file"),
        F.coalesce(last(mode, lambda x: F.when(x.startswith("new file mode"), "added").when(x.isNotNull(), "removed")), F.lit("modified")).alias("change_type"),
        last(mode, lambda x: F.element_at(F.split(x, " "), -1)).alias("mode_change"),
        any_line(lambda x: x.contains("Binary files") & x.contains("differ")).alias("is_binary"),
        last(lambda x: x.startswith("index"), lambda x: F.regexp_extract(x, r"^index ([a-f0-9]+)\.\.([a-f0-9]+)", 2)).alias("new_hash"),
        *cut.columns[3:],
    )
    return out.withColumn("changes", F.col("additions") + F.col("deletions"))


def _path(first: Column) -> Column:
    return F.when(first.rlike(HEADER), F.regexp_extract(first, HEADER, 2))


def slim_files(diffs: DataFrame) -> DataFrame:
    """One row per file as :func:`files` gives it, with its path, kind of change, binary flag and counts alone; only header lines leave a batch."""
    kind = F.when(F.col("mode") == 1, "added").when(F.col("mode") == 2, "removed").otherwise("modified")
    return slim_rows(diffs).select("diff_id", "file", _path(F.col("first")).alias("file_path"), kind.alias("change_type"), "is_binary", "additions", "deletions", (F.col("additions") + F.col("deletions")).alias("changes"))


def _sums(diffs: DataFrame, per_file: DataFrame, *more: Column) -> DataFrame:
    """Per diff: files, additions, deletions, changes, zeros for a blank diff, and ``more`` of its files."""
    sums = per_file.groupBy("diff_id").agg(F.count("*").alias("total_files"), *[F.sum(c).cast("long").alias(f"total_{c}") for c in ("additions", "deletions", "changes")], *more)
    return diffs.select("diff_id").join(sums, "diff_id", "left").na.fill(0)


def totals(diffs: DataFrame, per_file: DataFrame) -> DataFrame:
    """Per diff: files, additions, deletions, changes and the complexity score from 0 to 10; zeros for a blank diff."""
    out = _sums(diffs, per_file)
    part = lambda c, n: F.least(F.col(c) / float(n), F.lit(1.0))
    return out.withColumn("complexity_score", round2((part("total_files", 10) + part("total_changes", 500)) * 5.0))


def by_type(per_file: DataFrame) -> DataFrame:
    return per_file.groupBy("diff_id", after_dot("file_path", "no_extension").alias("extension")).agg(F.count("*").alias("files"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))


def _placed(per_file: DataFrame) -> DataFrame:
    return per_file.withColumn("place", F.row_number().over(Window.partitionBy("diff_id").orderBy(F.col("changes").desc(), "file")))


def largest(per_file: DataFrame, limit: int = 5) -> DataFrame:
    return _placed(per_file).where(F.col("place") <= limit).select("diff_id", "place", "file_path", "changes", "additions", "deletions")


def risks(per_file: DataFrame) -> DataFrame:
    """Rows (type, severity, file, pattern) for risky files; the first critical pattern that fits is named."""
    lower = F.lower("file_path")
    first = F.coalesce(*[F.when(F.col("file_path").rlike(f"(?i)^{p}"), F.lit(p)) for p in CRITICAL_PATHS])
    # most paths hold no word of a pattern, which is told without one
    per_file = per_file.withColumn("pattern", F.when(reduce(or_, [lower.contains(x) for x in CRITICAL_HOLD]), first))
    pattern = F.col("pattern")
    row = lambda test, kind, severity, p=None: F.when(test, F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), (p if p is not None else F.lit(None).cast("string")).alias("pattern")))
    found = F.array(
        row(F.col("changes") > 100, "large_change", "medium"),
        row(F.col("is_binary"), "binary_change", "low"),
        row(pattern.isNotNull(), "critical_file", "high", pattern),
        row(F.col("change_type") == "added", "new_file", "low"),
        row(F.col("change_type") == "removed", "file_deletion", "medium"),
    )
    # nulls are left out behind the generator: a filter of the array would not be compiled
    return per_file.select("diff_id", "file_path", F.explode(found).alias("r")).where("r IS NOT NULL").select("diff_id", "file_path", "r.*")


def patterns(diffs: DataFrame) -> DataFrame:
    """Per diff: changes to tests and documentation by path, and changed imports, functions and comments by line.

    A removed definition that has the number and text of an added one in its hunk counts as an addition.
    """
    path = F.lower("file_path")
    docs = F.col("file_path").isNotNull() & (path.contains(".md") | path.contains(".rst") | path.contains(".txt") | path.contains("readme") | path.contains("doc"))

    kinds = ("import_changes", "function_additions", "function_deletions", "comment_changes")
    per_file = files(diffs, counted=True)
    total = lambda c, name: F.sum(c).cast("long").alias(name)
    by_path = [total(F.when(path.contains("test"), F.col("changes")).otherwise(0), "test_changes"), total(F.when(docs, F.col("changes")).otherwise(0), "documentation_changes")]
    return per_file.groupBy("diff_id").agg(*by_path, *[total(F.col(n), n) for n in kinds])


def changed_functions(diffs: DataFrame, language: str = "python") -> DataFrame:
    """Definitions among changed lines: name, line number and text."""
    text = F.trim(F.regexp_replace("content", r"^\s+|\s+$", ""))
    found = CHANGED_DEFINITIONS[{"typescript": "javascript"}.get(language, language)]
    pick = lambda p: F.when(text.rlike(p), F.regexp_extract(text, p if language != "java" else r"\s+(\w+)\s*\(", 1))
    named = changes(diffs, DEFINITIONS_HOLD[{"typescript": "javascript"}.get(language, language)]).where(F.col("kind").isin("added", "removed")).withColumn("name", F.coalesce(*[pick(p) for p in found]))
    return named.where("name IS NOT NULL").select("diff_id", "file", "kind", "name", "line_number", text.alias("definition"))


def summaries(diffs: DataFrame) -> DataFrame:
    """As :func:`summary`, one row per diff: counted and ranked where its text is cut, so nothing is shuffled."""
    line = lambda x: F.format_string("  - %s: %d changes", _path(x["first"]), x["changes"])
    said = F.concat(F.format_string(_SAID, "total_files", "total_additions", "total_deletions"), F.array_join(F.transform("top", line), "\n"))
    return top_rows(diffs, 3).select("diff_id", F.when(F.col("total_files") == 0, "No changes detected.").otherwise(said).alias("summary"))


_SAID = "Changed %d file(s)\n%d additions\n%d deletions\nMost changed files:\n"


def summary(diffs: DataFrame, per_file: DataFrame) -> DataFrame:
    """The text that sums up a diff: counts and the three most changed files."""
    # sums and places are taken in one pass over the files
    line = F.format_string("  - %s: %d changes", "file_path", "changes")
    top = F.concat_ws("\n", *[F.max(F.when(F.col("place") == k, line)) for k in (1, 2, 3)]).alias("top")
    said = F.concat(F.format_string(_SAID, "total_files", "total_additions", "total_deletions"), F.coalesce("top", F.lit("")))
    return _sums(diffs, _placed(per_file), top).select("diff_id", F.when(F.col("total_files") == 0, "No changes detected.").otherwise(said).alias("summary"))


def commit_message(diff_text):  # noqa: ANN001, ANN201
    """The first line that starts with Subject: or commit, without what stands before its first colon."""
    own = F.filter(F.split(diff_text, "\n"), lambda x: x.startswith("Subject:") | x.startswith("commit "))
    line = F.get(own, F.lit(0))
    return F.when(line.contains(":"), F.trim(F.regexp_replace(line, r"^[^:]*:", ""))).otherwise(line)
