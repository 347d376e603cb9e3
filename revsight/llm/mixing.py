"""Mixing sources to target weights by systematic sampling.

Targets.  Sources in code-point order, null last, weigh 3, 1, 2 and so on, and share 150% of all sizes; no target exceeds
twice its source's size, and what is cut off is shared again by weight.  That fixed point is a water level: sources are
taken by capacity per weight, and the capped ones form a prefix of that order, so two window sums give it without a loop.

Draw.  A document of a source with target t and size s has t / s expected copies.  They are summed up in the order of size
class, then a hash of the id, from one random offset per source; a document is emitted once for each integer its step
crosses.  Taking documents of like size together keeps the taken words near the target.  The prefix sum is distributed:
counts per cell (source, size class, leading hash digits) are summed over cells, and only ranks within a cell need a
window; cells shrink as the table grows, so neither a hot source nor a hot size makes a large group.

Defined results: null texts have size 0; a null source is a source of its own; rows without an id are ordered as the empty
id; equal rows are interchangeable; an empty table gives an empty result; a source of size 0 has target 0 and gives nothing.
Reruns agree: the offset and the order come from hashes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import fresh, materialise

WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2
_UNIT = float(1 << 32)


def words(text: str) -> Column:
    """Number of words of a text column; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Adds ``target`` to one row (source, source_size) per source."""
    first = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(first) - 1, F.lit(len(weights))) + 1).cast("int"))
    whole = Window.partitionBy()
    filling = Window.orderBy(F.col("source_size") * float(cap) / F.col("w"), F.col("source").asc_nulls_last())
    level = (share * F.col("total") - F.col("cut")) / F.col("open")
    out = (
        sizes.withColumn("w", w)
        .withColumn("total", F.sum("source_size").over(whole))
        .withColumn("cut", F.coalesce(F.sum(F.col("source_size") * cap).over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("w").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", level)
        .withColumn("capped", F.col("level") * F.col("w") >= F.col("source_size") * cap)
        .withColumn("water", F.max(F.when(~F.col("capped"), F.col("level"))).over(whole))
    )
    capped = (F.col("source_size") * cap).cast("double")
    return out.select("source", "source_size", F.when(F.col("capped"), capped).otherwise(F.col("water") * F.col("w")).alias("target"))


def planned(df: DataFrame, doc_id: str = "doc_id", source: str = "source", size: str = "size") -> DataFrame:
    """Every row of ``df`` with ``source_size``, ``target`` and ``copies``; ``size`` is a column of longs.

    ``df`` is read twice; all its columns are carried through one shuffle.
    """
    key, cls, mark, before, src, step, start = (fresh(df, x) for x in ("mix_cell", "mix_class", "mix_hash", "mix_before", "mix_source", "mix_step", "mix_start"))
    out_size, out_target, out_copies = (fresh(df, x) for x in ("source_size", "target", "copies"))
    n = df.count()
    digits = max(1, math.ceil(math.log(max(n, 2), 16) / 2))
    shown = F.col(size).cast("string")
    named = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    base = (
        df.withColumn(cls, F.length(shown) * 100 + F.substring(shown, 1, 2).cast("int"))
        .withColumn(mark, F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")))
        .withColumn(key, F.concat_ws("/", named, F.col(cls), F.substring(F.col(mark), 1, digits)))
    )
    cells = materialise(
        base.groupBy(F.col(key).alias("cell")).agg(F.first(F.col(source).cast("string")).alias("source"), F.first(cls).alias("class"), F.first(F.substring(F.col(mark), 1, digits)).alias("lead"), F.count("*").alias("n"), F.sum(size).alias("words")), "cells"
    )
    per_source = materialise(targets(cells.groupBy("source").agg(F.sum("words").alias("source_size"))), "sources")
    classes = cells.groupBy("source", "class").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.select("source", "class", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("of_classes"))
    within = Window.partitionBy("source", "class").orderBy("lead").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("of_cells", F.coalesce(F.sum("n").over(within), F.lit(0)))
    same = lambda a, b, *on: [a[c].eqNullSafe(b[c]) for c in on]
    offset = F.conv(F.substring(F.md5(F.coalesce(F.concat(F.lit("="), src), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / _UNIT
    placed = cells.join(classes, same(cells, classes, "source", "class")).select(cells["cell"], cells["source"].alias(src), (F.col("of_classes") + F.col("of_cells")).alias("before"))
    placed = placed.join(per_source, F.col(src).eqNullSafe(F.col("source"))).select(
        F.col("cell").alias(key),
        F.col("before").alias(before),
        F.col("source_size").alias(out_size),
        F.col("target").alias(out_target),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias(step),
        offset.alias(start),
    )
    placed = materialise(placed, "placed")
    rank = F.col(before) + F.row_number().over(Window.partitionBy(key).orderBy(mark, size))
    crossed = F.floor(rank * F.col(step) + F.col(start)) - F.floor((rank - 1) * F.col(step) + F.col(start))
    return base.join(placed, key).withColumn(out_copies, crossed.cast("long")).select(*[F.col(c) for c in df.columns], out_size, out_target, out_copies)


def mixed(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``df``, each as often as the draw takes it, columns unchanged."""
    size, one = fresh(df, "size"), fresh(df, "one")
    plan = planned(df.withColumn(size, words(text)), doc_id, source, size)
    copies = plan.columns[-1]
    return plan.where(F.col(copies) > 0).withColumn(one, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*df.columns)


def report(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: size, its source's size and target, copies, and words taken."""
    sized = materialise(df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(text).alias("size")), "sizes")
    return planned(sized).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def report_sql() -> str:
    """The same draw for the SQL engine that checks results: there one plain window ranks a source."""
    listed = ", ".join(map(str, WEIGHTS))
    return f"""
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([{listed}])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS w FROM s),
f AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
        CAST(coalesce(sum(source_size * {CAP}) OVER (ORDER BY source_size * {float(CAP)} / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cut,
        CAST(sum(w) OVER (ORDER BY source_size * {float(CAP)} / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS open FROM w),
l AS (SELECT *, (CAST({SHARE} AS DOUBLE) * total - cut) / CAST(open AS DOUBLE) AS level FROM f),
c AS (SELECT *, level * w >= source_size * {CAP} AS capped FROM l),
t AS (SELECT *, CASE WHEN capped THEN CAST(source_size * {CAP} AS DOUBLE) ELSE max(CASE WHEN NOT capped THEN level END) OVER () * w END AS target,
        CAST(('0x' || substr(md5(coalesce('=' || source, '')), 1, 8)) AS BIGINT) / {_UNIT}::DOUBLE AS start FROM c),
r AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, t.start, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS step,
        row_number() OVER (PARTITION BY d.source ORDER BY length(CAST(d.size AS VARCHAR)) * 100 + CAST(substr(CAST(d.size AS VARCHAR), 1, 2) AS INTEGER), md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), d.size) AS rank
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, CAST(floor(rank * step + start) - floor((rank - 1) * step + start) AS BIGINT) AS copies FROM r)
SELECT doc_id, source, size, source_size, target, copies, size * copies AS taken FROM k"""
