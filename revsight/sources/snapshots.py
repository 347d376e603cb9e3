"""Source trees over time: snapshots by content hash, their difference, and findings kept up to date from it.

A snapshot is one slim row a file.  Two of them are compared by one full outer join on the path; files that went and files
that came with the same content are renames, paired within each hash.  Findings of files that did not change are kept, those
of files that went or changed are retracted, and only files that are new, changed, or renamed to another kind are read and
analysed again.  So the work follows the difference, and the result is that of analysing the whole tree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import basename, is_config_file, is_dependency_file, is_test_file, suffix


def snapshot(files: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """keys and the hash of each file's content; a null content is the empty one."""
    return files.select(*keys, F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256).alias("digest"))


def difference(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Rows (keys, change, from_path) for every file of either snapshot: same, changed, added, removed, renamed or moved.

    ``renamed``: a new path whose content a removed path had, its ``from_path``; that one is ``moved``.  Of several files of
    one content the first by path are paired.  Keys but the path, such as a repository, are equal in a pair.
    """
    others = [k for k in keys if k != "path"]
    a, b = old.withColumnRenamed("digest", "was"), new.withColumnRenamed("digest", "now")
    both = a.join(b, list(keys), "full_outer")
    state = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") == F.col("now"), "same").otherwise("changed")
    told = both.withColumn("change", state)
    # only what came or went is ranked, within its own content
    loose = told.where("change IN ('added', 'removed')").withColumn("digest", F.coalesce("was", "now"))
    place = F.row_number().over(Window.partitionBy(*others, "digest", "change").orderBy("path"))
    ranked = loose.select(*keys, "digest", "change", place.alias("place"))
    came = ranked.where("change = 'added'").select(*others, F.col("path").alias("to_path"), "digest", "place")
    went = ranked.where("change = 'removed'").select(*others, F.col("path").alias("from_path"), "digest", "place")
    pairs = came.join(went, [*others, "digest", "place"]).select(*others, "to_path", "from_path")
    renamed = pairs.select(*others, F.col("to_path").alias("path"), "from_path", F.lit("renamed").alias("paired")).unionByName(pairs.select(*others, F.col("from_path").alias("path"), F.lit(None).cast("string").alias("from_path"), F.lit("moved").alias("paired")))
    return told.join(renamed, list(keys), "left").select(*keys, F.coalesce("paired", "change").alias("change"), "from_path")


def kind(path: Column | str) -> Column:
    """What an analysis may ask of a path; files of one content and one kind have the same findings."""
    return F.concat_ws("/", suffix(path), is_config_file(path).cast("string"), is_test_file(path).cast("string"), F.when(is_dependency_file(path), basename(path)).otherwise(""))


def rescanned(findings: DataFrame, changes: DataFrame, files: DataFrame, analyse: Callable[[DataFrame], DataFrame], keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """The findings of ``files`` (keys, content), given those of the tree before and the :func:`difference` since.

    ``analyse`` gets the files to be read again and gives findings with the same columns as ``findings``.
    """
    others = [k for k in keys if k != "path"]
    alike = (F.col("change") == "same") | ((F.col("change") == "renamed") & (kind("path") == kind("from_path")))
    marked = changes.withColumn("alike", alike)
    # where a file that is kept stood before
    kept = marked.where("alike").select(*others, F.coalesce("from_path", "path").alias("path"), F.col("path").alias("_path"))
    held = findings.join(kept, list(keys)).withColumn("path", F.col("_path")).select(*findings.columns)
    again = marked.where("NOT alike AND change NOT IN ('removed', 'moved')").select(*keys)
    return held.unionByName(analyse(files.join(again, list(keys), "left_semi")).select(*findings.columns))
