"""Duplicate code, an extension: subtrees of one shape anywhere in a table of files.

A node's shape is a Merkle hash: of its kind, its operator, what constants are of, and the shapes of what is below, in
order.  Names and values don't count, so copies that were renamed are found.  Shapes are hashed bottom-up while a file is
listed; everything over all files is one count by shape and two joins.  Whole modules don't count: those are equal files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder
from . import syntax

#: Nodes of a subtree that is worth reporting.
LEAST_NODES = 20


def clones(files: DataFrame, least_nodes: int = LEAST_NODES) -> DataFrame:
    """Rows (file columns, kind, name, line_start, line_end, nodes, shape, copies) of Python subtrees that occur again.

    A subtree inside a larger one that occurs again too is left out, unless it stands on its own there; ``copies`` counts all
    places of the shape.  Files are told apart by all columns but their content; equal rows are places of their own.
    """
    keys = [c for c in files.columns if c != "content"]
    big = syntax.nodes(files).where((F.col("nodes") >= least_nodes) & ~F.col("kind").isin("Module", "SyntaxError"))
    # stored, so that files are parsed once and a lost executor costs only its part
    folder = shared_folder(files.sparkSession, "subtrees")
    big.select(*keys, "kind", "name", F.col("line").alias("line_start"), F.col("end_line").alias("line_end"), "nodes", "shape", "above_shape").write.parquet(folder)
    slim = files.sparkSession.read.parquet(folder)
    # counts are formed before they move, so a shape of very many copies is one row of each task
    many = slim.groupBy("shape").agg(F.count("*").alias("copies")).where("copies > 1")
    found = slim.join(many, "shape")
    inside = many.select(F.col("shape").alias("above_shape"))
    return found.join(inside, "above_shape", "left_anti").drop("above_shape").select(*keys, "kind", "name", "line_start", "line_end", "nodes", "shape", "copies")
