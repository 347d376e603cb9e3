"""The registered queries of the training-data operators and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit, caps, chat, langid, lines, mixing, ngram, packing, periodic, quality, secrets, simhash, toxicity
from ._common import load

Query = Callable[[SparkSession, str], DataFrame]


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(spark, load(spark, sf_dir, "conversations"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(load(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(load(spark, sf_dir, "documents"))


def op4_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.report(load(spark, sf_dir, "embeddings"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(load(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op7_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.report(load(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(load(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(load(spark, sf_dir, "documents"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(load(spark, sf_dir, "documents"))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(load(spark, sf_dir, "documents"))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(load(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = {name: f for name, f in globals().items() if name.startswith("op")}
    return dict(sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat": chat.report_sql(),
        "op5_quality": quality.report_sql(),
        "op8_mixing": mixing.report_sql(),
        "op11_audit": audit.report_sql(),
        "op12_lines": lines.report_sql(),
    }
