"""Predicates on chunks and edges, all of them pushed to the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import glob_regex


def _listed(value: str | tuple[str, ...] | list[str]) -> list[str]:
    return [value] if isinstance(value, str) else list(value)


def by_language(language: str | tuple[str, ...] | None, column: str = "language") -> Column:
    """One language or several; none at all admits nothing."""
    if language is None:
        return F.lit(True)
    return F.col(column).isin(*kinds) if (kinds := _listed(language)) else F.lit(False)


def by_type(types: tuple[str, ...] | None, column: str = "type") -> Column:
    return F.col(column).isin(*types) if types else F.lit(True)


def by_path(pattern: str | None, column: str = "file_path") -> Column:
    """Equality, or a glob in which ``*`` crosses slashes; a leading literal narrows the scan by a prefix test."""
    if pattern is None:
        return F.lit(True)
    if "*" not in pattern:
        return F.col(column) == pattern
    lead = pattern.split("*", 1)[0]
    match = F.col(column).rlike(glob_regex(pattern))
    return F.col(column).startswith(lead) & match if lead else match


def chunk_filter(language=None, types=None, file_path=None) -> Column:
    return by_language(language) & by_type(types) & by_path(file_path)


def one_per(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")
