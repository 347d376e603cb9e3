"""Line dedup: lines that many documents share are dropped from all of them, with DataFrame functions only.

Texts are split at line feeds and each line gets a key: the line without white space at its ends, A-Z in lower case.  Two
64-bit hashes name a key.  Each document adds one to each of its keys; keys of enough documents are common.  The positions
of common lines then go back to their text, and the other lines are joined again in their order.

A text is named by its MD5, so nothing has to be numbered first and copies of a text share one list of positions.  Lines
move as hashes, never as texts; counts are pre-aggregated before they move.  Common keys are broadcast only while they are
few (``BROADCAST_ROWS``, checked), else joined by a shuffle whose hot keys Spark splits; the rows are the same.

Defined results: a null text counts as the empty one, which is one empty line; each row is a document of its own, whatever
its id, so copies and repeated rows count once each; a line that a document repeats counts once for it; lines without a key
(only white space) always stay unless ``least_chars`` is 0; a text whose lines all go becomes the empty text; an empty
table gives an empty result; other columns are left alone whatever their names.  A document's lines must fit one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACES, discard, fresh, materialise

LEAST_DOCS = 10
LEAST_CHARS = 1
#: Common keys are broadcast up to so many (16 MB of hashes), else joined by a shuffle.
BROADCAST_ROWS = 1_000_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Beyond ASCII, what a full change to lower case may alter: upper and title case, and code points newer than the class tables.
_OTHER_CASE = r"[\P{ASCII}&&[\p{IsUppercase}\p{Lt}\p{Cn}]]"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is; ``lower`` is used where it can change nothing else."""
    plain = (F.octet_length(text) == F.length(text)) | ~F.rlike(text, F.lit(_OTHER_CASE))
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def _keyed(text: Column, least_chars: int) -> Column:
    """One struct (x, y) of two hashes for each line of a text; null where the key is too short to count."""
    # step by step, since an expression in a lambda is computed anew wherever it is written
    trimmed = F.transform(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)))
    keys = F.transform(trimmed, ascii_lower)
    return F.transform(keys, lambda k: F.when(F.length(k) >= least_chars, F.struct(F.xxhash64(k).alias("x"), F.xxhash64(F.lit("line"), k).alias("y"))))


def common_keys(df: DataFrame, text: str = "text", least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """Rows (x, y, n_docs): the hashes of keys that at least so many rows of ``df`` hold."""
    own = F.array_distinct(F.filter(_keyed(F.coalesce(F.col(text).cast("string"), F.lit("")), least_chars), lambda k: k.isNotNull()))
    held = df.select(F.explode(own).alias("k")).select("k.x", "k.y")
    return held.groupBy("x", "y").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= least_docs)


def without_common_lines(df: DataFrame, text: str = "text", least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, counts: str = "line_counts") -> DataFrame:
    """Every row of ``df`` with its common lines taken out of ``text``, and a struct ``counts`` of n_lines and n_dropped."""
    mark, own, lines, at = (fresh(df, x) for x in ("line_mark", "line_own", "line_parts", "line_at"))
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    found = materialise(common_keys(df, text, least_docs, least_chars).select("x", "y"), "common-lines")
    common = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    placed = df.select(F.unhex(F.md5(whole.cast("binary"))).alias(own), F.posexplode(_keyed(whole, least_chars)).alias("at", "k")).where("k IS NOT NULL")
    hits = placed.select(own, "at", "k.x", "k.y").join(common, ["x", "y"], "left_semi")
    # copies of a text hold the same positions; the set is formed before it moves
    drops = materialise(hits.groupBy(own).agg(F.collect_set("at").alias(at)), "dropped-lines")
    discard(found)
    marked = df.withColumn(mark, F.unhex(F.md5(whole.cast("binary"))))
    joined = marked.join(drops, F.col(mark) == F.col(own), "left").withColumn(lines, F.split(whole, "\n"))
    n, gone = F.size(lines), F.coalesce(F.size(at), F.lit(0))
    every = F.sequence(F.lit(0), n - 1)
    kept = F.array_join(F.transform(F.array_except(every, F.col(at)), lambda i: F.get(F.col(lines), i)), "\n")
    new = F.when(F.col(at).isNull(), whole).otherwise(kept)
    out = [(new.alias(c) if c == text else F.col(c)) for c in df.columns if c != counts]
    return joined.select(*out, F.struct(n.cast("long").alias("n_lines"), gone.cast("long").alias("n_dropped")).alias(counts))


def report(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its lines, how many are dropped, and the digest of what stays."""
    done = without_common_lines(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    return done.select("doc_id", "line_counts.n_lines", "line_counts.n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def report_sql() -> str:
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), '{_UPPER}', '{_UPPER.lower()}') AS key FROM l),
c AS (SELECT key FROM k WHERE length(key) >= {LEAST_CHARS} GROUP BY key HAVING count(DISTINCT r) >= {LEAST_DOCS}),
j AS (SELECT k.*, c.key IS NOT NULL AS gone FROM k LEFT JOIN c ON c.key = k.key),
g AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM j GROUP BY r)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped, sha256(kept) AS kept_sha256 FROM g JOIN d ON d.r = g.r"""
