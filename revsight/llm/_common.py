"""Helpers shared by the training-data operators: scratch tables, free names, word splitting."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\f\r"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name starting with ``stem`` that ``df`` does not have (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session that names none gets one of its own, a cluster an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = getattr(spark, "_revsight_scratch", None)
        if root is None:
            root = spark._revsight_scratch = "file://" + tempfile.mkdtemp(prefix="revsight-")
    return root.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


_SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside free their shuffle files when they end, and long texts make short Arrow batches.

    Only for jobs whose plan runs once, such as writing a table: nothing reads their shuffle files again.
    """
    before = {k: spark.conf.get(k) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and any executor may be lost afterwards."""
    path = scratch(df.sparkSession, label)
    with tidy(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table written by :func:`materialise` that nothing reads any more."""
    path = getattr(df, "_scratch_path", None)
    if path is None:
        return
    spark = df.sparkSession
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, after whose last batch the worker, which Spark keeps for later tasks, gives freed memory back.

    An allocator keeps what a task has freed, so every worker that stays holds as much as its largest task needed.
    """

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with suppress(AttributeError, OSError):  # glibc alone has it
            ctypes.CDLL(None).malloc_trim(0)

    return out


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def residue(column: str | Column, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus``; null ids count as the empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % modulus


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8, A-Z in lower case (bytes.split uses exactly SPACES)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []
