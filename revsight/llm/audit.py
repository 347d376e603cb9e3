"""Filter interaction audit: what each filter removes in every order of application, from tables of failing ids.

Each filter stores one table of the ids that fail it.  What survives a prefix of filters depends on which filters it holds,
not on their order, so survivors are built for sets of filters: those of a set and one filter more are the survivors of the
set left-anti joined with that filter's table.  All sets are stacked in one relation, so five filters take five anti joins
for 32 sets.  A filter's removals after a set are that set's survivors left-semi joined with its table; the ids it would
have removed but that went earlier are redundant; what it removes after all others fails it alone.  Labels ride along with
the ids, so label losses are sums over removals.  Documents that fail nothing survive every prefix: they are counted once.

Only ids, flags and part names move, each to its own hash, so no group is large.  The relation has at most 2**n rows for an
id that fails one of n filters.  Every other join is between tables of a row or so for each part and set.

Defined results: a null text counts as the empty one; each row is a document of its own, whatever its id, and numbered for
that when facts are written; a null part is the empty string; an id is an exact duplicate if a smaller id has the same text
(by MD5), and null ids are neither; several labels of one id count if one of them does; labels without a document count
nothing; an empty table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import json
import math
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialise

#: First copies of repeated texts are broadcast up to so many (32 MB), else joined by a shuffle.
BROADCAST_ROWS = 1_000_000
LEAST_WORDS = 200
#: Of 100 words so many differ at least; of 100 code points so many are capitals at most.
DISTINCT, CAPITALS = 50, 3
SYMBOLS = "#$%&*|"


def text_filters(text: Column, words: Column) -> dict[str, Column]:
    """Failure conditions that a text alone decides; ``words`` is the array of its words."""
    n = F.size(words).cast("long")
    return {
        "A": n < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < DISTINCT * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > CAPITALS * F.length(text).cast("long"),
        "D": text.rlike(f"[{SYMBOLS}]"),
    }


def facts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Written rows (row, doc_id, part, digest, A to D): every document numbered, with its verdicts, without its text."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    named = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), whole.alias("t"))
    split = named.withColumn("w", F.filter(F.split("t", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    # numbers are written with the table, so every later read sees the same
    tests = [test.alias(name) for name, test in text_filters(F.col("t"), F.col("w")).items()]
    return materialise(split.select(F.monotonically_increasing_id().alias("row"), "doc_id", "part", F.unhex(F.md5(F.col("t").cast("binary"))).alias("digest"), *tests), "facts")


def repeats(known: DataFrame) -> DataFrame:
    """The rows of ``known`` (row, doc_id, digest) whose text has a smaller id too."""
    first = materialise(known.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "first-copies")
    small = F.broadcast(first) if first.count() <= BROADCAST_ROWS else first
    return known.join(small, "digest").where(F.col("doc_id") > F.col("first")).select("row")


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with ``good`` and ``toxic``, 1 if some label of their doc_id says so, else 0."""
    says = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    marks = labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy("doc_id").agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    joined = rows.join(marks, "doc_id", "left")
    return joined.withColumn("good", F.coalesce("good", F.lit(0))).withColumn("toxic", F.coalesce("toxic", F.lit(0)))


def survivors(pending: DataFrame, failing: dict[str, DataFrame]) -> list[DataFrame]:
    """Tables that together hold a row (row, part, good, toxic, done) for each set of filters and id that survives it.

    ``done`` is the set as bits in the order of ``failing``.  The first table is ``pending`` with the empty set; each filter
    adds one table, the left-anti join of all before with its failing ids.
    """
    held = [pending.withColumn("done", F.lit(0))]
    for k, ids in enumerate(failing.values()):
        state = held[0]
        for more in held[1:]:
            state = state.unionByName(more)
        held.append(materialise(state.join(ids, "row", "left_anti").withColumn("done", F.col("done") + (1 << k)), "survivors"))
    return held


def audit(rows: DataFrame, failing: dict[str, DataFrame]) -> DataFrame:
    """Rows (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), zeros too.

    ``rows``: row (unique), part (never null), good, toxic.  ``failing``: one table of ``row`` for each filter, named by one
    letter, no id twice.  Every order of the filters is reported for every part.
    """
    names, n = list(failing), len(failing)
    every = None
    for ids in failing.values():
        every = ids if every is None else every.unionByName(ids)
    pending = materialise(rows.join(every.distinct(), "row", "left_semi").select("row", "part", "good", "toxic"), "pending")
    held = survivors(pending, failing)
    state = held[0]
    for more in held[1:]:
        state = state.unionByName(more)
    left = materialise(state.groupBy("part", "done").agg(F.count("*").alias("n")), "left")
    gone = None
    for k, (name, ids) in enumerate(failing.items()):
        removed = state.where(F.col("done").bitwiseAND(F.lit(1 << k)) == 0).join(ids, "row", "left_semi")
        counted = removed.groupBy("part", "done").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")).withColumn("filter", F.lit(name))
        gone = counted if gone is None else gone.unionByName(counted)
    gone = materialise(gone, "gone")
    totals = materialise(rows.groupBy("part").agg(F.count("*").alias("total")), "totals")
    for table in held[1:]:
        discard(table)

    steps = []
    for order in permutations(sorted(names)):
        done = 0
        for at, name in enumerate(order, 1):
            bit = 1 << names.index(name)
            steps.append(("".join(order), at, name, done, done | bit, (1 << n) - 1 - bit))
            done |= bit
    # n! * n rows whatever the input
    kind = "array<struct<filter_order:string,step:int,filter:string,before:int,after:int,others:int>>"
    listed = F.from_json(F.lit(json.dumps([dict(zip(("filter_order", "step", "filter", "before", "after", "others"), s)) for s in steps])), kind)
    clean = totals.join(left.where("done = 0").select("part", F.col("n").alias("failing")), "part", "left").select("part", (F.col("total") - F.coalesce("failing", F.lit(0))).alias("clean"))
    # a set of k others stands before a filter in k! (n - 1 - k)! orders
    weight = F.element_at(F.array(*[F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n)]), F.bit_count("done") + 1)
    shares = gone.groupBy("part", "filter").agg(F.sum(F.col("n") * weight).alias("shapley"))
    at = lambda set_, n_, *more: gone.select("part", "filter", F.col("done").alias(set_), F.col("n").alias(n_), *more)
    out = (
        clean.select("part", "clean", F.explode(listed).alias("s"))
        .select("part", "clean", "s.*")
        .join(at("before", "removed", "good", "toxic"), ["part", "filter", "before"], "left")
        .join(at("others", "alone"), ["part", "filter", "others"], "left")
        .join(gone.where("done = 0").select("part", "filter", F.col("n").alias("fails")), ["part", "filter"], "left")
        .join(left.select("part", F.col("done").alias("after"), F.col("n").alias("pending")), ["part", "after"], "left")
        .join(shares, ["part", "filter"], "left")
    )
    long = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    removed = long(F.col("removed"))
    return out.select(
        "part",
        "filter_order",
        "step",
        (F.col("clean") + long(F.col("pending"))).alias("kept"),
        removed.alias("removed"),
        (long(F.col("fails")) - removed).alias("redundant"),
        long(F.col("alone")).alias("unique_fails"),
        long(F.col("good")).alias("good_lost"),
        long(F.col("toxic")).alias("toxic_lost"),
        long(F.col("shapley")).alias("shapley"),
    )


def report(df: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters A to E over whole documents, by language."""
    known = facts(df)
    failing = {name: materialise(known.where(name).select("row"), f"failing-{name}") for name in "ABCD"}
    failing["E"] = materialise(repeats(known), "failing-E")
    marked = materialise(with_labels(known.select("row", "doc_id", "part"), labels).select("row", "part", "good", "toxic"), "labelled")
    discard(known)
    return audit(marked, failing)


def report_sql() -> str:
    orders = ", ".join(f"'{''.join(p)}'" for p in permutations("ABCDE"))
    bit = lambda x: f"(1 << (ascii({x}) - 65))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
m AS (SELECT doc_id, part, CASE WHEN len(ws) < {LEAST_WORDS} THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < {DISTINCT} * len(ws) THEN 2 ELSE 0 END
  + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > {CAPITALS} * length(t) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(t, '[{SYMBOLS}]') THEN 8 ELSE 0 END + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS mask FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l ON l.doc_id = m.doc_id GROUP BY part, mask),
o AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f FROM (SELECT unnest([{orders}]) AS filter_order), (SELECT unnest(range(1, 6)) AS step)),
b AS (SELECT o.*, {bit("f")} AS bit, coalesce((SELECT sum({bit("substr(o.filter_order, CAST(k AS INTEGER), 1)")}) FROM range(1, 6) r(k) WHERE k < o.step), 0) AS before FROM o),
s AS (SELECT part, filter_order, step, f,
  sum(CASE WHEN mask & CAST(before | bit AS INTEGER) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN mask & CAST(before AS INTEGER) = 0 AND mask & CAST(bit AS INTEGER) <> 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & CAST(before AS INTEGER) <> 0 AND mask & CAST(bit AS INTEGER) <> 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & CAST(before AS INTEGER) = 0 AND mask & CAST(bit AS INTEGER) <> 0 THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN mask & CAST(before AS INTEGER) = 0 AND mask & CAST(bit AS INTEGER) <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, b GROUP BY part, filter_order, step, f)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM s"""
