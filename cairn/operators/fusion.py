"""Result lists: reciprocal rank fusion, duplicates, pages, reranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bm25 import ranked

RRF_K = 45


def fuse(semantic: DataFrame, lexical: DataFrame, k: int = RRF_K, limit: int | None = None, id_col: str = "id") -> DataFrame:
    """(id, score, rank): the sum of 1 / (k + rank + 1) over both lists; ties in the order of the semantic list, then the lexical one."""
    both = semantic.select(F.col(id_col), F.col("rank").alias("s"), F.lit(None).cast("int").alias("l")).unionAll(lexical.select(id_col, F.lit(None).cast("int"), F.col("rank")))
    term = lambda c: F.coalesce(1 / (F.lit(k) + F.col(c) + 1), F.lit(0.0))
    per = both.groupBy(id_col).agg(F.min("s").alias("s"), F.min("l").alias("l")).withColumn("score", term("s") + term("l"))
    order = [F.desc("score"), F.asc_nulls_last("s"), F.asc_nulls_last("l"), F.col(id_col)]
    few = per.orderBy(*order).limit(limit) if limit is not None else per
    return ranked(few, order).select(id_col, "score", "rank")


def dedupe(results: DataFrame, id_col: str = "id", rank_col: str = "rank") -> DataFrame:
    """The best-ranked row of each id."""
    n = F.row_number().over(Window.partitionBy(id_col).orderBy(rank_col))
    return results.withColumn("_n", n).where("_n = 1").drop("_n")


def page(results: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit``, with ``has_more``: one row more is looked at, never the whole rest."""
    few = ranked(results.orderBy(*order).limit(offset + limit + 1), order, "_at")
    more = F.max("_at").over(Window.partitionBy()) >= offset + limit
    return few.withColumn("has_more", more).where((F.col("_at") >= offset) & (F.col("_at") < offset + limit)).drop("_at")


def rerank(results: DataFrame, query: str, score: Callable[[str, list[str]], list[float]], text_col: str = "context_content", rank_col: str = "rank") -> DataFrame:
    """Orders a bounded result list by a reranker's scores; a missing score counts as 0, ties keep their order, errors propagate."""
    rows = results.orderBy(rank_col).collect()  # once: neither scores nor ranks are computed again
    got = score(query, [r[text_col] or "" for r in rows]) if rows else []
    scores = [float(got[i]) if i < len(got) and got[i] is not None else 0.0 for i in range(len(rows))]
    order = sorted(range(len(rows)), key=lambda i: (-scores[i], rows[i][rank_col]))
    kept = [c for c in results.columns if c != rank_col]
    schema = T.StructType([*results.select(*kept).schema, T.StructField("rerank_score", T.DoubleType()), T.StructField(rank_col, T.IntegerType())])
    return results.sparkSession.createDataFrame([(*(rows[i][c] for c in kept), scores[i], n) for n, i in enumerate(order)], schema)
