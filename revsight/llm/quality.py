"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Words are maximal runs of characters other than space and U+0009 to U+000D.  Every measure is an exact integer and every
rule compares two integers, so a verdict never depends on rounding.

Defined results: a null text counts as the empty text and has no words, so it fails the base rules; equal rows get equal
results, each on its own row; an empty table gives an empty result; other columns are left alone whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import fresh

SYMBOLS = "#*$%&|<>"
WINDOW = 5

# Frequent short words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it for was on are as with by at be this from or an "
    "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch "
    "le la les de des et en un une du que qui dans pour par sur est pas au "
    "el los las y que se del por con para una su al es lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a text only if low * whole <= 100 * part <= high * whole; texts of fewer than ``least_words`` words pass."""

    name: str
    part: str
    whole: str
    low: int | None = None
    high: int | None = None
    least_words: int = 0

    def sql(self) -> str:
        sides = [f"100L * {self.part} >= {self.low}L * {self.whole}"] * (self.low is not None)
        sides += [f"100L * {self.part} <= {self.high}L * {self.whole}"] * (self.high is not None)
        test = " AND ".join(sides)
        return f"(n_words < {self.least_words} OR ({test}))" if self.least_words else f"({test})"

    def ansi(self) -> str:
        return self.sql().replace("L ", " ")


#: The base rules of the contract; a text that breaks one is never kept.
BASE = (Rule("words", "n_words", "1", low=1000), Rule("repeats", "n_repeat_words", "n_words", high=20))

#: The method's threshold table, in hundredths: length, symbol, stop-word and line ratios.
RULES = (
    Rule("mean_word_low", "word_chars", "n_words", low=200),
    Rule("mean_word_high", "word_chars", "n_words", high=1500),
    Rule("symbols", "n_symbols", "n_words", high=10),
    Rule("shouting", "n_capitals", "word_chars", high=30),
    Rule("stop_words", "n_stop_words", "n_words", low=2, least_words=50),
    Rule("dup_lines", "n_dup_lines", "n_lines", high=50),
)

#: SQL of each measure over the arrays made below; the stop-word list is put in when compiled.
_LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_capitals")



def measured(df: DataFrame, text: str = "text", out: str = "quality", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with a struct column ``out``: the measures, ``base_failed``, ``failed`` (names of broken rules) and ``kept``."""
    t, w, ln, g, s, d, m = (fresh(df, f"{out}_{x}") for x in ("t", "w", "ln", "g", "s", "d", "m"))
    quoted = ", ".join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS))
    df = df.withColumn(t, F.coalesce(F.col(text).cast("string"), F.lit("")))
    df = df.withColumn(w, F.filter(F.split(F.col(t), r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    df = df.withColumn(ln, F.filter(F.split(F.col(t), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    grams = f"CASE WHEN size({w}) < {WINDOW} THEN array() ELSE transform(sequence(1, size({w}) - {WINDOW - 1}), i -> array_join(slice({w}, i, {WINDOW}), ' ')) END"
    df = df.withColumn(g, F.expr(grams))
    # only texts in which some window recurs sort their windows
    df = df.withColumn(s, F.expr(f"CASE WHEN size(array_distinct({g})) < size({g}) THEN sort_array(transform({g}, (x, i) -> struct(x AS gram, i AS at))) END"))
    twin = f"(j > 0 AND {s}[j - 1].gram = {s}[j].gram) OR (j < size({s}) - 1 AND {s}[j + 1].gram = {s}[j].gram)"
    starts = f"CASE WHEN {s} IS NULL THEN array() ELSE sort_array(filter(transform(sequence(0, size({s}) - 1), j -> CASE WHEN {twin} THEN {s}[j].at END), x -> x IS NOT NULL)) END"
    df = df.withColumn(d, F.expr(starts))
    covered = f"aggregate({d}, named_struct('last', {-WINDOW}, 'n', 0L), (a, x) -> named_struct('last', x, 'n', a.n + least({WINDOW}, x - a.last)), a -> a.n)"
    values = {
        "n_words": f"CAST(size({w}) AS BIGINT)",
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.regexp_count(F.col(t), F.lit(f"[{SYMBOLS}]")).cast("long"),
        "n_dup_lines": f"CAST(size({ln}) - size(array_distinct({ln})) AS BIGINT)",
        "n_repeat_words": covered,
        "n_lines": f"CAST(size({ln}) AS BIGINT)",
        "n_stop_words": f"CAST(size(filter({w}, x -> x IN ({quoted}))) AS BIGINT)",
        "n_capitals": F.regexp_count(F.col(t), F.lit("[A-Z]")).cast("long"),
    }
    measures = F.struct(*[(F.expr(v) if isinstance(v, str) else v).alias(k) for k, v in values.items()])
    # a one-row explode: a filter on a verdict stops above it, where measures are columns; pushed further down it would
    # write every measure out again for each rule that uses it
    df = df.select("*", F.explode(F.array(measures)).alias(m))

    def test(rule: Rule) -> Column:
        sql = rule.sql()
        for name in _LONGS:
            sql = sql.replace(name, f"{m}.{name}")
        return F.expr(sql)

    broken = F.filter(F.array(*[F.when(~test(r), F.lit(r.name)) for r in (*BASE, *rules)]), lambda x: x.isNotNull())
    base_failed = ~(test(BASE[0]) & test(BASE[1]))
    whole = F.struct(f"{m}.*", base_failed.alias("base_failed"), broken.alias("failed"), (F.size(broken) == 0).alias("kept"))
    return df.withColumn(out, whole).drop(t, w, ln, g, s, d, m)


def keep_good(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``df`` that pass every rule, columns unchanged."""
    q = fresh(df, "quality")
    return measured(df, text, q, rules).where(F.col(f"{q}.kept")).select(*df.columns)


def report(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its measures and verdict."""
    return measured(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "quality.*").withColumn(
        "failed", F.array_join("failed", ",")
    )


def report_sql() -> str:
    """The same report for the SQL engine that checks results."""
    stops = ", ".join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS))
    rules = (*BASE, *RULES)
    broken = ", ".join(f"CASE WHEN NOT {r.ansi()} THEN '{r.name}' END" for r in rules)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS gram FROM (
        SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, range({WINDOW}) r(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
        CAST(len(ls) AS BIGINT) AS n_lines,
        CAST(len(list_filter(ws, lambda x: x IN ({stops}))) AS BIGINT) AS n_stop_words,
        CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals
      FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
f AS (SELECT *, list_filter([{broken}], lambda x: x IS NOT NULL) AS broken FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words, n_capitals,
  NOT ({BASE[0].ansi()} AND {BASE[1].ansi()}) AS base_failed, array_to_string(broken, ',') AS failed, len(broken) = 0 AS kept
FROM f"""
