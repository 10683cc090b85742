"""Change detection between two manifests (file_path, sha1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest_diff(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(file_path, status): new, changed, unchanged or removed; one full outer join on the path."""
    cur = current.select("file_path", F.col("sha1").alias("_now"))
    old = previous.select("file_path", F.col("sha1").alias("_before"))
    status = F.when(F.col("_now").isNull(), "removed").when(F.col("_before").isNull(), "new").when(F.col("_now") == F.col("_before"), "unchanged").otherwise("changed")
    return cur.join(old, "file_path", "full_outer").select("file_path", status.alias("status"))


def removed_files(current: DataFrame, previous: DataFrame) -> DataFrame:
    return previous.join(current.select("file_path"), "file_path", "left_anti").select("file_path")


def upsert(old: DataFrame, new: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """``new`` replaces the rows of ``old`` with its keys; of equal keys within ``new`` the last by ``order`` stays."""
    from .filters import one_per

    latest = one_per(new, key, F.desc(order)) if order else new
    return old.join(latest.select(key).distinct(), key, "left_anti").select(old.columns).unionByName(latest.select(old.columns))


def delete(old: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return old.join(keys.select(key), key, "left_anti").select(old.columns)


def cascade_edges(edges: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Edges without those that start in one of ``files`` (file_path) or lead to one of its ``chunks``."""
    gone = chunks.join(files.select("file_path"), "file_path", "left_semi").select(F.col("id").alias("target_chunk_id"))
    left = edges.join(files.select(F.col("file_path").alias("source_file_path")), "source_file_path", "left_anti")
    return left.join(gone, "target_chunk_id", "left_anti").select(edges.columns)
