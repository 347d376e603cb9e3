"""Sources: source trees, landed provider pages, branch lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import MAX_BYTES, is_scanned
from ..schemas import PROVIDERS, required, schema


def source_tree(spark: SparkSession, root: str) -> DataFrame:
    """Scanned files under ``root``: path below it and content; '' for files over a mebibyte, bad bytes left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    path = F.regexp_replace("path", rf"^.*?{base.lstrip('/')}/", "")
    text = F.replace(F.col("text"), F.lit("\ufffd"), F.lit(""))
    decoded = raw.select(path.alias("path"), F.when(F.col("length") <= MAX_BYTES, F.make_valid_utf8(F.col("content").cast("string"))).otherwise("").alias("text"))
    return decoded.where(is_scanned("path")).select("path", text.alias("content"))


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Provider repositories landed as JSON pages (page, items): one record each; a page over 100 or after a short one is no page."""
    item = "id long, name string, full_name string, description string, html_url string, clone_url string, default_branch string, language string, private boolean, archived boolean, size long"
    landed = spark.read.schema(f"page int, items array<struct<{', '.join(p.strip().replace(' ', ': ', 1) for p in item.split(','))}>>").json(path)
    short = landed.where(F.size("items") < 100).agg(F.coalesce(F.min("page"), F.lit(100)).alias("last"))
    used = landed.join(F.broadcast(short)).where((F.col("page") <= F.col("last")) & (F.col("page") <= 100))
    return used.select("page", F.explode("items").alias("i")).select("page", "i.*")


def branches(github: DataFrame, gitlab: DataFrame, bitbucket: DataFrame) -> DataFrame:
    """Branch lists of three providers in one form: provider, name, protected, default, commit_sha, commit_url."""
    no = F.lit(False)
    shape = lambda df, provider, protected, default, sha, url: df.select(F.lit(provider).alias("provider"), "name", F.coalesce(protected, no).alias("protected"), F.coalesce(default, no).alias("default"), sha.alias("commit_sha"), url.alias("commit_url"))
    one = shape(github, PROVIDERS[0], F.col("protected"), no, F.col("commit.sha"), F.col("commit.url"))
    two = shape(gitlab, PROVIDERS[1], F.col("protected"), F.col("default"), F.col("commit.id"), F.col("commit.web_url"))
    three = shape(bitbucket, PROVIDERS[2], no, no, F.col("target.hash"), F.col("target.links.html.href"))
    return one.unionByName(two).unionByName(three)


def table(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """An entity table with its contract: known columns in order, missing ones null."""
    df = spark.read.parquet(path)
    have = {c.lower() for c in df.columns}
    return df.select(*[(F.col(f.name) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(ddl).fields])


def violations(df: DataFrame, ddl: str, unique: tuple[str, ...] = (), parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """Rows (rule, column, rows) for each constraint that is broken: required, unique and referenced columns."""
    rules = [df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required(ddl) if c in df.columns]).selectExpr("'required' AS rule", f"stack({len([c for c in required(ddl) if c in df.columns])}, " + ", ".join(f"'{c}', {c}" for c in required(ddl) if c in df.columns) + ") AS (column, rows)")]
    for c in unique:
        dup = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).where("n > 1")
        rules.append(dup.agg(F.count("*").alias("rows")).select(F.lit("unique").alias("rule"), F.lit(c).alias("column"), "rows"))
    for c, parent in (parents or {}).items():
        lost = df.where(F.col(c).isNotNull()).join(parent.select(F.col("id").alias(c)), c, "left_anti")
        rules.append(lost.agg(F.count("*").alias("rows")).select(F.lit("reference").alias("rule"), F.lit(c).alias("column"), "rows"))
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out.where("rows > 0")
