"""Regular-expression scans of source text as Column expressions: no user function, one pass over each text.

Spark has no match offsets.  A mark is put before every match, and the line of a match is then the number of the line its
mark is on; all steps are linear in the text.  U+E000, the mark, is dropped from texts first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import is_code_file, is_config_file, is_dependency_file, is_test_file, language
from ..functions.scores import severity_rank
from .rules import CONFIG_FIX, CONFIG_SECRETS, CONFIG_TEXT, CUSTOM, FIXES, PACKAGE_FIX, PACKAGE_TEXT, PACKAGE_TITLE, SECURITY, STRUCTURE, TEST_CREDENTIALS, TEST_FIX, TEST_TEXT, TEST_TITLE, VULNERABLE

#: . stops at \n only and classes know all letters, as in the language the patterns are written for.
MULTILINE, PLAIN, CASED, CASED_MULTILINE = "(?imdU)", "(?idU)", "(?dU)", "(?mdU)"
MARK = "\ue000"
_MATCHES = "array<struct<line:int,text:string,name:string>>"
_FOUND = "array<struct<title:string,description:string,category:string,severity:string,rule_id:string,suggested_fix:string,confidence_score:double,line_start:int,line_end:int,code_snippet:string,seq:bigint>>"


def matches(content: Column, pattern: str, flags: str = MULTILINE, group: int = 0) -> Column:
    """All matches in order: array of (line, text, name); ``name`` is the given group.  Patterns may not match nothing."""
    p = flags + pattern
    plain = F.replace(content, F.lit(MARK), F.lit(""))
    marked = F.split(F.regexp_replace(plain, F.lit(p), F.lit(MARK + "$0")), "\n")
    lines = F.flatten(F.transform(marked, lambda text, i: F.array_repeat(i + 1, F.length(text) - F.length(F.replace(text, F.lit(MARK), F.lit(""))))))
    zipped = F.arrays_zip(lines.alias("line"), F.regexp_extract_all(plain, F.lit(p), F.lit(0)).alias("text"), F.regexp_extract_all(plain, F.lit(p), F.lit(group)).alias("name"))
    return F.when(plain.rlike(p), zipped.cast(_MATCHES)).otherwise(F.array().cast(_MATCHES))


def context(content: Column, line: Column, before: int = 1, after: int = 1) -> Column:
    """The line with its neighbours."""
    lines = F.split(content, "\n")
    first = F.greatest(line - before, F.lit(1))
    return F.array_join(F.slice(lines, first, line + after - first + 1), "\n")


def _issue(m: Column, order: int, at: Column, **fixed: object) -> Column:
    values = {"title": None, "description": None, "category": "security", "severity": None, "rule_id": None, "suggested_fix": None, "confidence_score": 0.8} | fixed
    fields = [F.lit(v).cast("double" if k == "confidence_score" else "string").alias(k) for k, v in values.items()]
    return F.struct(*fields, m["line"].alias("line_start"), m["line"].alias("line_end"), m["text"].alias("code_snippet"), (F.lit(order << 40).cast("long") + at).alias("seq"))


def _rows(content: Column, order: int, pattern: str, flags: str, **fixed: object) -> Column:
    return F.transform(matches(content, pattern, flags), lambda m, i: _issue(m, order, i, **fixed))


def _one(condition: Column, order: int, **fixed: object) -> Column:
    row = _issue(F.struct(F.lit(1).alias("line"), F.lit(None).cast("string").alias("text")), order, F.lit(0), **fixed)
    return F.when(condition, F.array(row)).otherwise(F.array().cast(_FOUND))


def _flat(df: DataFrame, found: Column, shown: bool = False) -> DataFrame:
    """A row for each found issue; ``shown``: its snippet is its line with the neighbours."""
    keys = [c for c in df.columns if c != "content"]
    if not shown:
        return df.select(*keys, F.explode(found).alias("_i")).select(*keys, "_i.*")
    rows = df.select(*keys, "content", F.explode(found).alias("_i")).select(*keys, "content", "_i.*")
    return rows.withColumn("code_snippet", context(F.col("content"), F.col("line_start"))).drop("content")


def pattern_issues(files: DataFrame) -> DataFrame:
    """One row for each match of a rule of the file's language; the snippet is the line with its neighbours."""
    content, lang = F.col("content"), language("path")
    found = None
    for name, rules in SECURITY.items():
        rows = F.concat(*[_rows(content, i, r.pattern, MULTILINE, title=r.title, description=r.description, severity=r.severity, rule_id=r.rule_id, suggested_fix=FIXES.get(r.rule_id)) for i, r in enumerate(rules)])
        found = F.when(lang == name, rows) if found is None else found.when(lang == name, rows)
    return _flat(files, found, shown=True)


def context_issues(files: DataFrame) -> DataFrame:
    """Secrets in configuration files, credentials in tests and packages with known faults, by the kind of file."""
    content = F.col("content")
    config = [_rows(content, 20 + i, p, PLAIN, title=t, description=CONFIG_TEXT, severity="high", rule_id="config_secrets", suggested_fix=CONFIG_FIX, confidence_score=0.9) for i, (p, t) in enumerate(CONFIG_SECRETS)]
    tests = _one(content.rlike(PLAIN + TEST_CREDENTIALS), 30, title=TEST_TITLE, description=TEST_TEXT, severity="medium", rule_id="test_credentials", suggested_fix=TEST_FIX, confidence_score=0.7)
    packages = [
        _one(content.rlike(rf"{CASED}{p}\s*[=><~!]+\s*({'|'.join(v.replace('.', chr(92) + '.') for v in versions)})"), 40 + i, title=PACKAGE_TITLE.format(p), description=PACKAGE_TEXT.format(p), severity="high", rule_id="vulnerable_dependency", suggested_fix=PACKAGE_FIX.format(p))
        for i, (p, versions) in enumerate(VULNERABLE.items())
    ]
    nothing = F.array().cast(_FOUND)
    kinds = ((is_config_file("path"), F.concat(*config)), (is_test_file("path"), tests), (is_dependency_file("path"), F.concat(*packages)))
    return _flat(files, F.concat(*[F.when(kind, rows).otherwise(nothing) for kind, rows in kinds]))


def custom_issues(files: DataFrame, names: list[str]) -> DataFrame:
    """Matches of custom rules; unknown names are ignored."""
    content = F.col("content")
    rows = [_rows(content, 60 + 10 * i + k, p, PLAIN, title=f"Rule Violation: {n}", description=f'Pattern "{p}" found in code', category="style", severity="low", rule_id=n, confidence_score=0.9) for i, n in enumerate(n for n in names if n in CUSTOM) for k, p in enumerate(CUSTOM[n])]
    if not rows:
        return _flat(files.limit(0), _rows(content, 60, "x", PLAIN))
    return _flat(files, F.concat(*rows))


def code_files(files: DataFrame) -> DataFrame:
    """Files worth analysing: not blank, at most a mebibyte of characters, a suffix of code."""
    return files.where(is_code_file("path", "content"))


def deduplicated(issues: DataFrame, file: str = "path", within: tuple[str, ...] = ()) -> DataFrame:
    """The first found of issues that agree in title, file, first line and category."""
    order = Window.partitionBy(*within, "title", file, "line_start", "category").orderBy("seq")
    return issues.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def priority() -> list[Column]:
    """Order of shown issues: severity, then confidence, then order of discovery."""
    return [severity_rank("severity").desc(), F.coalesce("confidence_score", F.lit(0.5)).desc(), F.col("seq").asc()]


def _definitions(found: Column, kind: str, order: int) -> Column:
    unnamed = F.lit("anonymous" if kind == "struct" else None).cast("string")

    def one(m: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.when(m["name"] == "", unnamed).otherwise(F.trim(m["name"])).alias("name"), m["line"].alias("line"), F.lit(order).alias("pattern"))

    return F.transform(found, one)


def structure(files: DataFrame) -> DataFrame:
    """Definitions and imports found by pattern in every language but Python: path, language, kind, name, line."""
    content = F.col("content")
    parts = []
    for name, patterns in STRUCTURE.items():
        rows = [_definitions(matches(content, p, CASED_MULTILINE, g), kind, o) for o, (kind, p, g) in enumerate(patterns)]
        own = files.where(language("path") == name)
        parts.append(own.select("path", F.lit(name).alias("language"), F.explode(F.concat(*rows)).alias("d")).select("path", "language", "d.*"))
    return reduce(DataFrame.unionByName, parts)


def line_counts(files: DataFrame) -> DataFrame:
    """Lines of each file: as a parser counts them (a final line feed ends the last line) and as a split gives them."""
    by_split = F.size(F.split("content", "\n"))
    parsed = F.size(F.split(F.regexp_replace("content", "\r\n", "\n"), "[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]")) - F.when(F.col("content").rlike("[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]$") | (F.col("content") == ""), 1).otherwise(0)
    return files.select("path", language("path").alias("language"), parsed.alias("lines_of_code"), by_split.alias("split_lines"))


def chunks(files: DataFrame, size: int = 20) -> DataFrame:
    """Blocks of ``size`` lines with the number of their first line."""
    lines = F.split("content", "\n")
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / size).cast("int")), lambda i: F.struct((i * size + 1).alias("line"), F.array_join(F.slice(lines, i * size + 1, size), "\n").alias("text")))
    return files.select("path", F.explode(cut).alias("c")).select("path", "c.*")
