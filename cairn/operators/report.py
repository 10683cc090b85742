"""Figures and listings: statistics, repository maps, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import SYMBOL_TYPES
from .shared import cut


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def stats(chunks: DataFrame, edges: DataFrame, project: str) -> DataFrame:
    """One row: totals, and counts by language, by chunk type and by edge type as maps.  Chunks and edges are read once each."""
    kinds = ["language", "type", "file_path"]
    sets = chunks.groupingSets([[k] for k in kinds], *kinds).agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    of = {"language": 0b011, "type": 0b101, "file_path": 0b110}  # a bit is set for what isn't grouped by

    def counts(name: str, condition: Column) -> Column:
        return F.map_from_entries(F.array_sort(F.collect_list(F.when(condition, F.struct(name, "n")))))

    totals = sets.agg(
        F.coalesce(F.sum(F.when(F.col("g") == of["type"], F.col("n"))), F.lit(0)).alias("total_chunks"), F.count_if((F.col("g") == of["file_path"]) & F.col("file_path").isNotNull()).alias("total_files"),
        counts("language", F.col("g") == of["language"]).alias("by_language"), counts("type", F.col("g") == of["type"]).alias("by_type"),
    )
    links = count_by(edges, "type").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_edges"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("by_edge_type"))
    # One row each.
    return totals.crossJoin(links).select(F.lit(project).alias("project_id"), "total_chunks", "total_files", "total_edges", "by_language", "by_type", "by_edge_type")


def list_files(chunks: DataFrame) -> DataFrame:
    return chunks.select("file_path").distinct().orderBy("file_path")


def chunks_of(chunks: DataFrame, file_path: str) -> DataFrame:
    return chunks.where(F.col("file_path") == file_path).orderBy("start_line", "ord")


def symbols(chunks: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    """(file_path, type, name, start_line, end_line) of named chunks."""
    return chunks.where(F.col("type").isin(*(types or SYMBOL_TYPES)) & (F.coalesce("name", F.lit("")) != "")).select("file_path", "type", "name", "start_line", "end_line")


def repo_map(chunks: DataFrame, types: tuple[str, ...] | None = None, max_files: int | None = None) -> DataFrame:
    """(file_path, symbols, outline): files by path, or with ``max_files`` those with most symbols; symbols by first line."""
    per = symbols(chunks, types).groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("start_line", "type", "name", "end_line"))).alias("symbols"))
    shown = F.transform("symbols", lambda s: F.format_string("  %s %s (%d-%d)", s["type"], s["name"], s["start_line"], s["end_line"]))
    out = per.select("file_path", "symbols", F.array_join(F.concat(F.array("file_path"), shown), "\n").alias("outline"))
    return out.orderBy("file_path") if max_files is None else out.orderBy(F.desc(F.size("symbols")), "file_path").limit(max_files)


def repo_map_text(chunks: DataFrame, types=None, max_files=None, format: str = "text") -> str:
    """The map as a document for a reader; its length follows the files it is asked for."""
    import json

    rows = repo_map(chunks, types, max_files).toLocalIterator()
    if format == "json":
        return json.dumps([{"file": r["file_path"], "symbols": [{"type": s["type"], "name": s["name"], "startLine": s["start_line"], "endLine": s["end_line"]} for s in r["symbols"]]} for r in rows], indent=2)
    return "\n\n".join(r["outline"] for r in rows)


def recall_at(ranked_hits: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """(k, recall) from one row for each query with ``hit_rank`` (from 0, null for a miss); to four places."""
    each = [F.struct(F.lit(k).alias("k"), F.round(F.avg(F.when(F.col("hit_rank") < k, 1.0).otherwise(0.0)), 4).alias("recall")) for k in ks]
    return ranked_hits.agg(F.array(*each).alias("r")).select(F.inline("r"))


def percentiles(values: DataFrame, column: str, points: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """(p, value): the entry at place floor(p / 100 * n) of the sorted values.

    Values are sorted by ranges and numbered within them; the ranges' counts tell where each place lies.
    """
    spark, kind = values.sparkSession, dict(values.dtypes)[column]
    sorted_ = values.select(column).where(F.col(column).isNotNull()).repartitionByRange(column).sortWithinPartitions(column)
    numbered = cut(sorted_.select(column, F.monotonically_increasing_id().alias("_at")), "percentiles")
    counts = numbered.groupBy(F.shiftright("_at", 33).alias("r")).count().orderBy("r").collect()  # a number for each range
    n = sum(c for _, c in counts)
    wanted = []
    for p in points if n else ():
        left = min(p * n // 100, n - 1)
        for r, c in counts:
            if left < c:
                wanted.append((p, (r << 33) + left))
                break
            left -= c
    at = spark.createDataFrame(wanted, "p int, _at long")
    return numbered.join(F.broadcast(at), "_at").select("p", F.col(column).cast(kind).alias("value"))
