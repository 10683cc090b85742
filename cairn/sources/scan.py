"""Scans of file trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ignore
from .languages import language_of


def relative_path(root: str):
    """The path below ``root`` of Spark's file column."""
    plain = F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), r"^[a-zA-Z][a-zA-Z0-9+.-]*:/+", "/")
    base = "/" + root.split("://", 1)[-1].strip("/") if "://" in root or root.startswith("/") else root
    return F.expr("substr(_p, " + str(len(base.rstrip("/")) + 2) + ")"), plain


def scan(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, defaults: bool = True) -> DataFrame:
    """(file_path, sha1, size, mtime, language, text) of the files below ``root``.

    Patterns are applied to the listing, so what they leave out is never opened; a consumer of paths alone doesn't read contents.
    """
    import os

    patterns = [*(ignore.default_excludes() if defaults else []), *(exclude or [])]
    if defaults and os.path.isdir(root):
        patterns += ignore.load_ignore_files(root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    below, plain = relative_path(os.path.abspath(root) if os.path.isdir(root) else root)
    files = files.withColumn("_p", plain).withColumn("file_path", below)
    if include and include != ["**/*"]:
        files = files.where(F.col("file_path").rlike(ignore.any_of(include)))
    if patterns:
        files = files.where(~F.col("file_path").rlike(ignore.any_of(patterns)))
    return files.select("file_path", F.sha1("content").alias("sha1"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), language_of("file_path").alias("language"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def manifest(files: DataFrame) -> DataFrame:
    return files.select("file_path", "sha1", "size", "mtime", "language")


def eval_set(spark: SparkSession, path: str) -> DataFrame:
    """(query, expectedFile, expectedSymbol) from JSON lines; blank ones are dropped."""
    from ..model import EVAL_SET

    return spark.read.schema(EVAL_SET).json(path).where("query is not null")
