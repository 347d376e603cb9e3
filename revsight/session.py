"""A session with the settings the library's jobs rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName("revsight")
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | more).getOrCreate()


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder name that driver and executors share; a local session that names no shared folder gets one of its own."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = getattr(spark, "_revsight_shared", None)
        if root is None:
            root = spark._revsight_shared = "file://" + tempfile.mkdtemp(prefix="revsight-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
