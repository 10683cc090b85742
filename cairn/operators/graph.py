"""Edges between chunks: look-ups, relations, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .filters import by_type, one_per
from .shared import cut


def outgoing(edges: DataFrame, chunk: str, types: tuple[str, ...] | None = None) -> DataFrame:
    return edges.where((F.col("source_chunk_id") == chunk) & by_type(types))


def incoming(edges: DataFrame, chunk: str, types: tuple[str, ...] | None = None) -> DataFrame:
    return edges.where((F.col("target_chunk_id") == chunk) & by_type(types))


def related(edges: DataFrame, chunks: DataFrame, direction: str, types: tuple[str, ...]) -> DataFrame:
    """(of, chunk columns): for every chunk, the distinct chunks at the other end of its edges of these kinds.

    ``direction`` is "in" or "out".  Callers are in/CALLS, callees out/CALLS, implementors in/IMPLEMENTS+EXTENDS,
    supertypes out/IMPLEMENTS+EXTENDS, usages in/USES.
    """
    near, far = ("target_chunk_id", "source_chunk_id") if direction == "in" else ("source_chunk_id", "target_chunk_id")
    # Sent once, by the id: that serves the join as well as the removal of repeats.
    ends = edges.where(by_type(types)).select(F.col(near).alias("of"), F.col(far).alias("id")).repartition("id").distinct()
    return ends.join(chunks, "id").select("of", *chunks.columns)


RELATED = {"callers": ("in", ("CALLS",)), "callees": ("out", ("CALLS",)), "implementors": ("in", ("IMPLEMENTS", "EXTENDS")), "supertypes": ("out", ("IMPLEMENTS", "EXTENDS")), "usages": ("in", ("USES",))}


def related_files(edges: DataFrame, chunks: DataFrame, direction: str) -> DataFrame:
    """(of_file, chunk columns): through IMPORTS edges of the files' import chunks; "out" gives dependencies, "in" dependents."""
    imports = one_per(chunks.where("type = 'import'"), "file_path", F.desc("ord")).select(F.col("id").alias("_import"), F.col("file_path").alias("of_file"))
    near, far = ("source_chunk_id", "target_chunk_id") if direction == "out" else ("target_chunk_id", "source_chunk_id")
    ends = edges.where("type = 'IMPORTS'").select(F.col(near).alias("_import"), F.col(far).alias("id")).distinct()
    return imports.join(ends, "_import").join(chunks, "id").select("of_file", *chunks.columns)


#: Frontiers of up to so many chunks are pushed into the scan; larger ones are joined.
PUSHED = 2000


def neighbourhood(edges: DataFrame, center: str | list[str], depth: int = 1, limit: int | None = 20, types: tuple[str, ...] | None = None, pushed: int = PUSHED) -> DataFrame:
    """(hop, direction, edge columns, neighbour): breadth first in both directions; of several centres, with ``seed`` before.

    Hop by hop, an edge is reported when its far end is met for the first time in that hop.  Order: hop, place of
    the near end in the frontier (that is, of its first mention), outgoing before incoming, edge id; ``limit``
    cuts in this order, for each centre.  A hop is one scan of the edges: with the frontier as a filter on both
    ends while it is small, joined with it when it isn't.
    """
    spark = edges.sparkSession
    seeds = [center] if isinstance(center, str) else list(center)
    pool = edges.where(by_type(types))
    turned = [F.struct(F.col(f"{a}_chunk_id").alias("near"), F.col(f"{b}_chunk_id").alias("neighbour"), F.lit(d).alias("direction")) for a, b, d in (("source", "target", "outgoing"), ("target", "source", "incoming"))]
    frontier = spark.createDataFrame([(s, s, "") for s in seeds], "seed string, near string, place string")
    names: list[str] | None = seeds
    seen = frontier.select("seed", F.col("near").alias("neighbour"))
    found: DataFrame | None = None
    for hop in range(1, depth + 1):
        some = pool if names is None else pool.where(F.col("source_chunk_id").isin(names) | F.col("target_chunk_id").isin(names))
        both = some.withColumn("_end", F.explode(F.array(*turned))).select(*edges.columns, "_end.*")
        small = names is not None
        ahead = both.join(F.broadcast(frontier) if small else frontier, "near").join(F.broadcast(seen) if small else seen, ["seed", "neighbour"], "left_anti")
        step = ahead.withColumn("hop", F.lit(hop))
        if hop < depth:
            step = cut(step, "hop")  # three readers: the result, the next frontier, what has been seen
        found = step if found is None else found.unionByName(step)
        if hop == depth:
            break
        # The next frontier, in order of first mention.  A place is the path of edges that led there, which sorts in
        # that order (the mark between its parts sorts before all else), so nothing has to be numbered.
        path = F.concat("place", F.lit("\x01"), F.when(F.col("direction") == "outgoing", "0").otherwise("1"), "id")
        frontier = step.groupBy("seed", "neighbour").agg(F.min(path).alias("place")).select("seed", F.col("neighbour").alias("near"), "place")
        few = frontier.limit(pushed + 1).collect()
        names = sorted({r["near"] for r in few}) if len(few) <= pushed else None
        if names is not None:
            frontier = spark.createDataFrame([tuple(r) for r in few], frontier.schema)
        seen = seen.unionAll(frontier.select("seed", F.col("near").alias("neighbour")))
    order = [F.col("hop"), F.col("place"), F.desc("direction"), F.col("id"), F.col("neighbour")]  # "outgoing" sorts after "incoming"
    out = ["hop", "direction", "neighbour", *edges.columns]
    if not isinstance(center, str):
        out = ["seed", *out]
    if limit is None:
        return found.select(*out)
    if isinstance(center, str):
        few = found.orderBy(*order).limit(limit)
        return few.withColumn("pos", F.row_number().over(Window.orderBy(*order)) - 1).select("pos", *out)
    return found.withColumn("pos", F.row_number().over(Window.partitionBy("seed").orderBy(*order)) - 1).where(F.col("pos") < limit).select("pos", *out)


def defines(chunks: DataFrame) -> DataFrame:
    """(source_chunk_id, target_chunk_id, source_file_path): the file's first import chunk with each of its other named chunks."""
    first = one_per(chunks.where("type = 'import'"), "file_path", F.col("ord")).select("file_path", F.col("id").alias("source_chunk_id"))
    named = chunks.where("type <> 'import' and coalesce(name, '') <> ''").select("file_path", F.col("id").alias("target_chunk_id"))
    return first.join(named, "file_path").select("source_chunk_id", "target_chunk_id", F.col("file_path").alias("source_file_path"))


def fill_sources(raw_edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Edges without a source chunk start from the first chunk of their file."""
    first = one_per(chunks, "file_path", F.col("ord")).select(F.col("file_path").alias("source_file_path"), F.col("id").alias("_first"))
    joined = raw_edges.join(first, "source_file_path", "left")
    source = F.coalesce(F.when(F.col("source_chunk_id") != "", F.col("source_chunk_id")), F.col("_first"))
    return joined.withColumn("source_chunk_id", source).select(raw_edges.columns)
