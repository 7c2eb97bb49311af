"""Documents from files and tables."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.config import glob_pattern

EXTENSIONS = ("md", "markdown", "txt")
SKIPPED = ("node_modules", ".git")


def read_documents(spark: SparkSession, paths: list[str], extensions: tuple[str, ...] = EXTENSIONS, ignore_files: list[str] | None = None, base: str = "") -> DataFrame:
    """(path, text) of whole UTF-8 files, each path once; folders are walked, and of their files those with an extension count.

    Paths are relative to base, with '/'. ignore_files are globs on these paths. The filter is on file names, before any text is used."""
    df = spark.read.option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").text(paths, wholetext=True)
    full = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "/")
    df = df.select(full.alias("full"), F.col("value").alias("text"))
    df = df.filter(F.lower("full").rlike(r"\.(?:" + "|".join(extensions) + r")$") & ~F.col("full").rlike("/(?:" + "|".join(s.replace(".", r"\.") for s in SKIPPED) + ")/"))
    root = base.rstrip("/") + "/" if base else ""
    df = df.withColumn("path", F.when(F.col("full").startswith(root), F.substring("full", len(root) + 1, 1 << 30)).otherwise(F.col("full")) if root else F.col("full"))
    for g in ignore_files or []:
        df = df.filter(~F.col("path").rlike(glob_pattern(g)))
    return df.select("path", "text").dropDuplicates(["path"])


def read_glob(spark: SparkSession, root: str, patterns: list[str], **options) -> DataFrame:
    """(path, text) below root whose relative path matches one of the globs. Braces and brackets in a glob are plain characters."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.col("path").rlike(glob_pattern(p))
    return read_documents(spark, [root], base=root, **options).filter(hit)


def read_stdin(spark: SparkSession, text: str | None = None) -> DataFrame:
    return spark.createDataFrame([("<stdin>", sys.stdin.read() if text is None else text)], "path string, text string")


def table_documents(spark: SparkSession, sf_dir: str, table: str = "documents", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(path, text) of a Parquet table, path being the key as text."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key).cast("string").alias("path"), F.col(text).alias("text"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON-lines file with their line number and, where a line can't be read, the line itself in `corrupt`; blank lines are skipped."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("pos", "raw"))
    rows = whole.filter(F.trim("raw") != "").select((F.col("pos") + 1).alias("line_no"), F.from_json("raw", f"{schema}, corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}).alias("r"))
    return rows.select("line_no", "r.*")


OCCURRENCE = "array<struct<column:int,index:int,length:int,excerpt:string>>"
REPORT = f"tool string, version string, language string, files array<struct<path:string,messages:array<struct<ruleId:string,severity:string,line:int,column:int,index:int,length:int,message:string,excerpt:string,occurrences:{OCCURRENCE}>>>>"


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The findings of a JSON report, as lint() gives them."""
    files = spark.read.schema(REPORT).json(path, multiLine=True).select(F.explode("files").alias("f"))
    m = files.select("f.path", F.explode("f.messages").alias("m"))
    return m.select("path", F.col("m.ruleId").alias("rule_id"), *[f"m.{c}" for c in ("severity", "line", "column", "index", "length", "message", "excerpt", "occurrences")])


def report_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT).json(path, multiLine=True).select(F.explode("files").alias("f")).select("f.path")
