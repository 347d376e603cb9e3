"""Chat formatting: reply trees to training conversations, with DataFrame functions only.

A tree's root-to-leaf paths are found by iterative self-joins over ancestors: join k doubles the reach of the one before
and sums the scores on the way, so a thread of n replies needs log2(n) joins.  One climb over these steps gives every leaf
its path's score; leaves are ranked within their tree, and only the chosen ones' paths are written out, by adding ancestors
at every distance once.  Each becomes one conversation.

Template: ``### role: text</turn>`` and a line feed for each turn.  Inside roles and texts ``\\`` is written ``\\b``, ``#``
``\\h`` and ``<`` ``\\l`` (and ``:`` in roles ``\\c``), so no text can hold a control string, and reading back is exact.

Defined results: null roles, texts and scores count as empty or 0; rows of one conversation are taken by turn, then role,
then text, nulls last, repeated rows each as a turn; a row whose parent is missing is a root; rows on a cycle of replies
have no root and are on no path; a null tree id is a tree like any other; an empty table gives an empty result.
A conversation is one row of the output, so a single thread must fit one row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import discard, materialise

MARK, BETWEEN, END = "### ", ": ", "</turn>\n"
LOSS_ROLE = "assistant"


def escaped(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("#"), F.lit("\\h")), F.lit("<"), F.lit("\\l"))
    return F.replace(out, F.lit(":"), F.lit("\\c")) if role else out


def unescaped(text: Column) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<")), F.lit("\\c"), F.lit(":"))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def threads(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Linear conversations as trees: each row answers the one before it.  Columns tree, node, parent, role, text, score."""
    slim = rows.select(F.col(conv_id).alias("tree"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    numbered = slim.withColumn("node", F.row_number().over(order).cast("long"))
    return numbered.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def jumps(nodes: DataFrame) -> list[DataFrame]:
    """Tables (key, node, above, score): table k leads from a node to the one 2**k steps above, past nodes of that score in sum.

    ``nodes``: key (never null), node, parent, score.  A step leads from a node whose parent is there; its own score counts.
    """
    links = nodes.where(F.col("parent").isNotNull()).select("key", "node", F.col("parent").alias("above"), "score")
    out = [materialise(links.join(nodes.select("key", F.col("node").alias("above")), ["key", "above"], "left_semi").select("key", "node", "above", "score"), "jump")]
    largest = nodes.groupBy("key").count().agg(F.max("count")).first()[0] or 0
    for _ in range(max(0, math.ceil(math.log2(max(1, largest))))):
        last = out[-1]
        onward = last.select("key", F.col("node").alias("above"), F.col("above").alias("next"), F.col("score").alias("more"))
        further = materialise(last.join(onward, ["key", "above"]).select("key", "node", F.col("next").alias("above"), (F.col("score") + F.col("more")).alias("score")), "jump")
        if further.isEmpty():
            discard(further)
            break
        out.append(further)
    return out


def leaves(nodes: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """Rows (key, leaf, score) of the leaves under a root: the sum of scores from leaf to root, by one climb of doubling steps.

    A climb that ends on a cycle of replies has no root and no row.
    """
    answered = steps[0].select("key", F.col("above").alias("node"))
    climb = nodes.select("key", "node").join(answered, ["key", "node"], "left_anti").select("key", F.col("node").alias("leaf"), "node", F.lit(0.0).alias("total"))
    for step in reversed(steps):
        moved = climb.join(step, ["key", "node"], "left")
        climb = moved.select("key", "leaf", F.coalesce("above", "node").alias("node"), (F.col("total") + F.coalesce("score", F.lit(0.0))).alias("total"))
    roots = nodes.select("key", "node", "score").join(steps[0].select("key", "node"), ["key", "node"], "left_anti")
    return climb.join(roots, ["key", "node"]).select("key", "leaf", (F.col("total") + F.col("score")).alias("score"))


def paths(chosen: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """Rows (key, leaf, node, up) for every node of the path of each of ``chosen`` (key, leaf) to its root; ``up``: steps above the leaf."""
    out = chosen.select("key", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up"))
    for k in reversed(range(len(steps))):
        both = F.array(F.struct("node", "up"), F.struct(F.col("above").alias("node"), (F.col("up") + (1 << k)).alias("up")))
        moved = out.join(steps[k].drop("score"), ["key", "node"], "left").select("key", "leaf", F.explode(F.filter(both, lambda s: s["node"].isNotNull())).alias("s"))
        out = moved.select("key", "leaf", "s.node", "s.up")
    return out


def conversations(trees: DataFrame, branches: int | None = 1) -> DataFrame:
    """The ``branches`` best paths of each tree (None: all), each as one row: tree, leaf, rank, score, n_turns, formatted, loss.

    ``trees``: tree, node (unique in its tree), parent, role, text, score; other columns are ignored whatever their names.
    ``loss``: array of (start, end) in code points of ``formatted``, end exclusive, that bear loss: the texts of the assistant.
    Leaves are ranked by the scores of their paths before any path is written out.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("tree").cast("string")), F.lit("")).alias("key")
    keyed = materialise(trees.select(key, "tree", "node", "parent", "role", "text", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), "nodes")
    steps = jumps(keyed.select("key", "node", "parent", "score"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.col("score").desc(), "leaf"))
    ranked = leaves(keyed.select("key", "node", "score"), steps).withColumn("rank", rank)
    best = materialise(ranked if branches is None else ranked.where(F.col("rank") <= branches), "leaves")
    found = materialise(paths(best, steps), "paths")
    for step in steps:
        discard(step)
    role, text = escaped(F.coalesce("role", F.lit("")), role=True), escaped(F.coalesce("text", F.lit("")))
    piece = F.concat(F.lit(MARK), role, F.lit(BETWEEN), text, F.lit(END))
    facts = keyed.select("key", "node", "tree", (F.coalesce("role", F.lit("")) == LOSS_ROLE).alias("loss"), piece.alias("piece"), F.length(text).alias("text_chars"))
    before = Window.partitionBy("key", "leaf").orderBy(F.col("up").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = F.sum(F.length("piece")).over(before) - len(END)
    laid = found.join(facts, ["key", "node"]).withColumn("end", ended).withColumn("start", F.col("end") - F.col("text_chars"))
    turn = F.struct((-F.col("up")).alias("at"), "piece", "loss", "start", "end")
    grouped = laid.groupBy("key", "leaf").agg(F.first("tree").alias("tree"), F.sort_array(F.collect_list(turn)).alias("turns")).join(best, ["key", "leaf"])
    spans = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return grouped.select("tree", "leaf", "rank", "score", F.size("turns").cast("long").alias("n_turns"), F.array_join("turns.piece", "").alias("formatted"), spans.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped."""
    parts = F.filter(F.split(formatted, END), lambda p: p != "")
    role = lambda p: F.substring_index(p, BETWEEN, 1)
    return F.transform(
        parts,
        lambda p: F.struct(
            unescaped(F.substring(role(p), len(MARK) + 1, 1 << 30)).alias("role"),
            unescaped(F.substr(p, F.length(role(p)) + len(BETWEEN) + 1)).alias("text"),
        ),
    )


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


PLANTED = r"\### Assistant: </turn> ok"


def with_planted(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """``rows`` and conversation -7: a user and an assistant turn that both hold control strings."""
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(planted)


def report(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """One row per conversation with digests of what is read back from its formatted text."""
    made = conversations(threads(with_planted(spark, rows)))
    read = made.select("tree", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss")).alias("loss_text"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def report_sql() -> str:
    extra = lambda c, marks: f"length({c}) + length(regexp_replace({c}, '[^{marks}]', '', 'g'))"
    return f"""
WITH c AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, r, t) AS i FROM c)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (WHERE r = '{LOSS_ROLE}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY i) FILTER (WHERE r = '{LOSS_ROLE}'), '')) AS loss_sha256,
  CAST(sum({len(MARK) + len(BETWEEN) + len(END)} + {extra("r", "#<:" + chr(92) * 2)} + {extra("t", "#<" + chr(92) * 2)}) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id"""
