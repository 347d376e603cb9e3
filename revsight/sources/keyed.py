"""Keyed tables that are written to: copy-on-write merges into Parquet buckets, one manifest swapped at the end.

A table is a folder of Parquet files and of manifests.  Every key belongs to one of a fixed number of buckets, each of
which lies in one folder of files; a manifest names the folder of each bucket.  A merge reads and rewrites only the buckets
that its changes touch, into a new folder, and then adds a manifest that names those in place of the old ones.  Manifests
are numbered and one is never written over: it is written aside and renamed to the next number, which fails if another
writer took that number.  So a reader sees the table before a merge or after it, never in between, and a merge that dies
leaves files that nothing names.

Each writer numbers its batches; the manifest keeps the last number of each writer, and a batch that is not beyond it
changes nothing.  That makes a merge repeatable, so a stream may hand its micro-batches to :meth:`KeyedTable.sink`.

What goes through the driver is one name per bucket.  Changes and old rows meet in one shuffle, by bucket; keys are unique,
so no bucket is hot, and a table that outgrows its buckets is made anew with more of them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a change may ask: change what is there, add what isn't, either, or take away.
OPS = ("update", "insert", "upsert", "delete")


class Conflict(RuntimeError):
    """Another writer has changed the table since it was read."""


class KeyedTable:
    """A table of rows with unique, non-null values of ``key`` under ``path``, which all of the cluster can reach."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- files

    def _path(self, below: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{below}" if below else self.path)

    def _put(self, below: str, text: str) -> None:
        """Write a file aside, then give it its name; the name must be free."""
        aside = self._path(f"manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(aside, True)
        out.write(bytearray(text.encode()))
        out.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(self._fs.makeQualified(aside), self._fs.makeQualified(self._path(below)), none)
        except Exception as e:
            self._fs.delete(aside, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"{below} is taken") from e
            raise

    def _text(self, below: str) -> str:
        source = self._fs.open(self._path(below))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
        finally:
            source.close()

    # ---- manifests

    def versions(self) -> list[int]:
        """The numbers of the table's manifests, rising."""
        folder = self._path("manifests")
        if not self._fs.exists(folder):
            return []
        return sorted(int(name[:-5]) for f in self._fs.listStatus(folder) if (name := f.getPath().getName()).endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """key, buckets, schema, folders (bucket -> folder), writers (writer -> last batch), version."""
        held = self.versions()
        if not held:
            raise FileNotFoundError(f"no table in {self.path}")
        version = held[-1] if version is None else version
        return json.loads(self._text(f"manifests/{version:020d}.json")) | {"version": version}

    def _commit(self, manifest: dict, version: int) -> None:
        self._put(f"manifests/{version:020d}.json", json.dumps(manifest))

    # ---- reading and writing

    @classmethod
    def create(cls, df: DataFrame, path: str, key: str = "id", buckets: int = 16) -> KeyedTable:
        """A new table with the rows of ``df``; its columns are all the table has."""
        table = cls(df.sparkSession, path)
        if table.versions():
            raise Conflict(f"{path} holds a table")
        folders = table._write(df.withColumn("_bucket", _bucket(F.col(key), buckets)), buckets)
        table._commit({"key": key, "buckets": buckets, "schema": df.schema.json(), "folders": folders, "writers": {}}, 0)
        return table

    def read(self, version: int | None = None) -> DataFrame:
        """All rows, of the last version or of an earlier one that :meth:`vacuum` has not taken away."""
        return self._rows(self.manifest(version))

    def _rows(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(manifest["schema"]))
        folders = [f for b, f in manifest["folders"].items() if buckets is None or int(b) in buckets]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def _write(self, df: DataFrame, tasks: int) -> dict[str, str]:
        """Rows with ``_bucket`` to a new folder; where each bucket that has rows now lies."""
        folder = f"data/{uuid.uuid4().hex}"
        df.repartition(tasks, "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(folder))]
        return {n.removeprefix("_bucket="): f"{folder}/{n}" for n in names if n.startswith("_bucket=")}

    def merge(self, changes: DataFrame, writer: str, batch: int, op: str = "_op", order: str | None = None) -> bool:
        """Apply ``changes`` as one version; False if that batch of that writer, or a later one, has been applied.

        ``changes``: the key, some columns of the table, and ``op``, one of :data:`OPS`.  The last change of a key by
        ``order`` counts; without an order a key may come once only.  Updates take what is not null; a row is added with
        the columns given, others null.  A null key or an unknown op is an error, an update or delete of an absent key and
        an insert of a present one are none and change nothing.
        """
        before = self.manifest()
        if before["writers"].get(writer, -1) >= batch:
            return False
        key, n = before["key"], before["buckets"]
        columns = [c for c in changes.columns if c not in (op, order)]
        marked = changes.withColumn("_bucket", F.when(F.col(key).isNotNull() & F.col(op).isin(*OPS), _bucket(F.col(key), n)))
        found = marked.groupBy("_bucket").agg(F.count("*").alias("n"), F.count_distinct(key).alias("keys")).collect()  # a row a bucket
        if any(r["_bucket"] is None for r in found):
            raise ValueError(f"a change without a key, or with an op other than {', '.join(OPS)}")
        if order is None and any(r["n"] != r["keys"] for r in found):
            raise ValueError("several changes of one key need an order")
        touched = [r["_bucket"] for r in found]
        writers = before["writers"] | {writer: batch}
        folders = before["folders"]
        if touched:
            old = self._rows(before, touched)
            schema = old.schema
            row = F.struct(*[F.col(c) for c in schema.names])
            change = F.struct(F.col(order) if order else F.lit(0).alias("_at"), F.col(op).alias("_op"), *[F.col(c) for c in columns if c != key])
            kept = old.select(_bucket(F.col(key), n).alias("_bucket"), F.col(key).alias("_key"), row.alias("old"), F.lit(None).cast(marked.select(change).schema[0].dataType).alias("new"))
            asked = marked.select("_bucket", F.col(key).cast(schema[key].dataType).alias("_key"), F.lit(None).cast(kept.schema["old"].dataType).alias("old"), change.alias("new"))
            both = kept.unionByName(asked).repartition(min(len(touched), n), "_bucket")
            place = F.struct(F.col("new.*")) if order is None else F.col(f"new.{order}")
            merged = both.groupBy("_bucket", "_key").agg(F.first("old", ignorenulls=True).alias("old"), (F.first("new", ignorenulls=True) if order is None else F.max_by("new", place)).alias("new"))
            asks = F.col("new._op")
            stays = F.when(F.col("old").isNull(), asks.isin("insert", "upsert")).otherwise(asks.isNull() | (asks != "delete"))
            changed = asks.isin("update", "upsert") | (F.col("old").isNull() & (asks == "insert"))

            def value(f: T.StructField) -> Column:
                if f.name == key:
                    return F.col("_key").alias(key)
                if f.name not in columns:
                    return F.col("old")[f.name].alias(f.name)
                new = F.when(changed, F.col("new")[f.name].cast(f.dataType))
                return F.coalesce(new, F.col("old")[f.name]).alias(f.name)

            after = merged.where(stays).select("_bucket", *[value(f) for f in schema.fields])
            written = self._write(after, min(len(touched), n))
            folders = {b: f for b, f in folders.items() if int(b) not in touched} | written
        after = {k: before[k] for k in ("key", "buckets", "schema")} | {"folders": folders, "writers": writers}
        self._commit(after, before["version"] + 1)
        return True

    def sink(self, writer: str, op: str = "_op", order: str | None = None) -> Callable[[DataFrame, int], None]:
        """For ``writeStream.foreachBatch``: each micro-batch is merged once, however often it is handed on.

        It is computed once too, into files beside the table, as a stateful stream must not be run over for each use.
        """

        def put(df: DataFrame, batch: int) -> None:
            table = KeyedTable(df.sparkSession, self.path)
            aside = f"staged/{uuid.uuid4().hex}"
            df.write.parquet(f"{self.path}/{aside}")
            table.merge(df.sparkSession.read.schema(df.schema).parquet(f"{self.path}/{aside}"), writer, batch, op, order)
            table._fs.delete(table._path(aside), True)

        return put

    def vacuum(self, keep: int = 1) -> int:
        """Delete what the last ``keep`` manifests don't name, and earlier manifests; how many folders went.

        Not while a merge runs: its new files have no manifest yet.
        """
        held = self.versions()
        used = {f for v in held[-keep:] for f in self.manifest(v)["folders"].values()}
        for v in held[:-keep]:
            self._fs.delete(self._path(f"manifests/{v:020d}.json"), False)
        gone = 0
        if not self._fs.exists(self._path("data")):
            return 0
        for top in self._fs.listStatus(self._path("data")):
            name = top.getPath().getName()
            parts = [p.getPath().getName() for p in self._fs.listStatus(top.getPath())]
            unused = [p for p in parts if p.startswith("_bucket=") and f"data/{name}/{p}" not in used]
            for p in unused:
                gone += bool(self._fs.delete(self._path(f"data/{name}/{p}"), True))
            if len(unused) == sum(p.startswith("_bucket=") for p in parts):
                self._fs.delete(top.getPath(), True)
        return gone


def _bucket(key: Column, buckets: int) -> Column:
    # as text, so that a key's bucket doesn't depend on the width of its number
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")
