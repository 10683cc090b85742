"""Tables kept as Parquet snapshots.

Every table is split into buckets by a hash of its file path.  A snapshot is a list of bucket folders: a
commit writes the touched buckets anew, names the others again, and then replaces the pointer to the current list in
one rename.  ``buckets`` is chosen for the project's size when its index is made.  Readers of an older list keep their files until ``compact``.  Changing a few files of a
large project thus costs as much as the buckets they lie in.

Beside the chunks lie their postings, sorted by term within a bucket and written with the buckets of the chunks they belong to, so
that a text search reads a few pages of each bucket and no text.  Vectors get an inverted file from ``ANN_ROWS`` rows on, made by
``optimize`` and used as long as the vectors are those it was made from; a search through it is exact.  Ids have Parquet Bloom
filters, so look-ups by id, by an edge's source and by its target pass over row groups that can't hold them.
"""

from __future__ import annotations

import base64
import json
import uuid
from abc import ABC, abstractmethod

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from . import bm25, graph, knn, report
from .filters import chunk_filter
from .shared import cut

BUCKETS = 64
#: Keys of up to so many rows are broadcast to the rows they are looked up in; more are joined.
BROADCAST_ROWS = 1 << 20
TABLES = {
    "files": model.FILES, "chunks": model.CHUNKS, "raw_edges": model.RAW_EDGES, "edges": model.EDGES, "vectors": model.VECTORS + ", file_path string",
    "postings": "term string, chunk_id string, tf int, positions array<int>, file_path string", "lengths": "chunk_id string, dl int, file_path string",
}
_PATH = {"raw_edges": "source_file_path", "edges": "source_file_path"}
_SORTED = {"postings": ["term"], "chunks": ["id"], "edges": ["source_chunk_id"], "vectors": ["chunk_id"], "lengths": ["chunk_id"]}
_BLOOM = {"chunks": ["id"], "edges": ["id", "source_chunk_id", "target_chunk_id"], "postings": ["term"]}


def _few(keys: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(keys) if rows <= BROADCAST_ROWS else keys


class DimensionMismatch(ValueError):
    pass


class Snapshots:
    """Tables below one folder of any file system that Arrow and Spark both reach."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        uri = root if "://" in root else "file://" + root
        self.system, self.root = fs.FileSystem.from_uri(uri)
        self.prefix = uri[: len(uri) - len(self.root)] if uri.endswith(self.root) else "file://"
        self.system.create_dir(self.root, recursive=True)

    # -- small records

    def read_json(self, name: str, default=None):
        try:
            with self.system.open_input_stream(f"{self.root}/{name}") as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return default

    def write_json(self, name: str, value) -> None:
        temporary = f"{self.root}/.{name}-{uuid.uuid4().hex}"
        with self.system.open_output_stream(temporary) as f:
            f.write(json.dumps(value).encode())
        self.system.move(temporary, f"{self.root}/{name}")

    # -- tables

    def _list(self, name: str) -> dict[str, str]:
        return (self.read_json("CURRENT", {}) or {}).get(name, {})

    def table(self, name: str, only: list[int] | None = None) -> DataFrame:
        """The current snapshot, or some buckets of it; an empty table before the first commit."""
        return self.read(name, [f for b, f in self._list(name).items() if only is None or int(b) in only])

    def bucket(self, column: str = "file_path"):
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def commit(self, tables: dict[str, DataFrame], touched: list[int] | None = None, moved: bool = True) -> None:
        """Replaces the touched buckets (all by default) of the given tables by the given rows, at once.

        ``moved=False``: the rows come straight from their buckets' files and none was added, so they are written where they are read.
        """
        self.publish({name: self.write(name, df, moved) for name, df in tables.items()}, touched)

    def publish(self, written: dict[str, dict[str, str]], touched: list[int] | None = None) -> None:
        """``commit`` of folders that ``write`` made."""
        written = dict(written)
        if "chunks" in written:  # from what was just written, so that nothing is parsed or merged again
            new = self.read("chunks", written["chunks"].values())
            for name, df in zip(("postings", "lengths"), bm25.build_postings(new, keep=("file_path",))):
                written[name] = self.write(name, df, moved=False)
        # Only here is the list read that the new one replaces: the time in which another writer could come between is that of two renames.
        current = self.read_json("CURRENT", {}) or {}
        for name, listed in written.items():
            current[name] = ({} if touched is None else {b: f for b, f in current.get(name, {}).items() if int(b) not in touched}) | listed
        self.write_json("CURRENT", current)

    def write(self, name: str, df: DataFrame, moved: bool = True) -> dict[str, str]:
        """New folders of the buckets that the rows lie in; no list names them yet."""
        column = _PATH.get(name, "file_path")
        folder = f"{name}/{uuid.uuid4().hex}"
        rows = df.select(*[f.split(" ")[0] for f in TABLES[name].split(", ")]).withColumn("_bucket", self.bucket(column))
        # Small buckets share a task and large ones are split, by their measured sizes.  Rows of a bucket's files lie together without that.
        out = (rows.hint("rebalance", "_bucket") if moved else rows).sortWithinPartitions("_bucket", *_SORTED.get(name, [column])).write.partitionBy("_bucket")
        out = out.option("compression", "zstd")
        for c in _BLOOM.get(name, []):
            out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
        out.parquet(f"{self.prefix}{self.root}/{folder}")
        return {i.base_name[8:]: f"{folder}/{i.base_name}" for i in self.system.get_file_info(fs.FileSelector(f"{self.root}/{folder}")) if i.base_name.startswith("_bucket=")}

    def read(self, name: str, folders) -> DataFrame:
        folders = sorted(set(folders))
        if not folders:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*[f"{self.prefix}{self.root}/{f}" for f in folders])

    def buckets_of(self, *frames: tuple[DataFrame, str]) -> list[int]:
        """The buckets that the rows of some frames lie in, by their path columns: at most ``buckets`` numbers."""
        found: set[int] = set()
        for df, column in frames:
            found |= {r[0] for r in df.select(self.bucket(column).alias("b")).distinct().collect()}
        return sorted(found)

    def replace_files(self, changed: DataFrame, tables: dict[str, DataFrame]) -> None:
        """The rows of the changed files (file_path) are dropped from the given tables and the new ones put in, bucket by bucket."""
        touched = sorted(r[0] for r in changed.select(self.bucket().alias("b")).distinct().collect())  # at most ``buckets`` numbers
        if not touched:
            return
        out = {}
        for name, new in tables.items():
            column = _PATH.get(name, "file_path")
            old = self.table(name, touched)
            kept = old.join(changed.select(F.col("file_path").alias(column)), column, "left_anti").select(old.columns)
            out[name] = kept.unionByName(new.select(old.columns))
        self.commit(out, touched)

    def compact(self) -> None:
        """Removes the folders that the current list doesn't name."""
        used = {f for listed in (self.read_json("CURRENT", {}) or {}).values() for f in listed.values()}
        for name in TABLES:
            try:
                folders = self.system.get_file_info(fs.FileSelector(f"{self.root}/{name}"))
            except FileNotFoundError:
                continue
            for folder in folders:
                inside = {f"{name}/{folder.base_name}/{i.base_name}" for i in self.system.get_file_info(fs.FileSelector(folder.path)) if i.base_name.startswith("_bucket=")}
                if not inside & used:
                    self.system.delete_dir(folder.path)
                else:
                    for gone in inside - used:
                        self.system.delete_dir(f"{self.root}/{gone}")

    def clear(self) -> None:
        self.system.delete_dir_contents(self.root, missing_dir_ok=True)


class VectorStore(ABC):
    """Chunks and vectors: what another back end has to offer."""

    @abstractmethod
    def upsert(self, chunks: DataFrame, vectors: DataFrame | None = None) -> None: ...
    @abstractmethod
    def delete(self, ids: list[str]) -> None: ...
    @abstractmethod
    def delete_by_file(self, file_path: str) -> None: ...
    @abstractmethod
    def search_vector(self, query: list[float], limit: int = 20, language=None, types=None, file_path=None) -> DataFrame: ...
    @abstractmethod
    def search_text(self, query: str, limit: int = 20, language=None, types=None, file_path=None) -> DataFrame: ...
    @abstractmethod
    def get(self, ids: list[str]) -> DataFrame: ...
    @abstractmethod
    def list_files(self) -> DataFrame: ...
    @abstractmethod
    def count(self) -> int: ...

    def optimize(self) -> None:
        """Nothing to do, unless a back end has something."""


class GraphStore(ABC):
    """Edges."""

    @abstractmethod
    def upsert_edges(self, edges: DataFrame) -> None: ...
    @abstractmethod
    def delete_edges_by_file(self, file_path: str) -> None: ...
    @abstractmethod
    def delete_edges_by_target(self, ids: list[str]) -> None: ...
    @abstractmethod
    def outgoing(self, chunk: str, types=None) -> DataFrame: ...
    @abstractmethod
    def incoming(self, chunk: str, types=None) -> DataFrame: ...
    @abstractmethod
    def count_edges(self) -> int: ...


class IndexStore(VectorStore, GraphStore):
    """Chunks, vectors and edges of one project, with the searches on them."""

    def __init__(self, snapshots: Snapshots, dimensions: int | None = None, model_id: str | None = None):
        self.snapshots = snapshots
        known = snapshots.read_json("META") or {}
        if dimensions and known.get("dimensions") not in (None, dimensions):
            raise DimensionMismatch(f"the index has {known['dimensions']} dimensions, the embedder {dimensions}")
        self.dimensions = dimensions or known.get("dimensions")
        self.model_id = model_id or known.get("model_id")
        if dimensions:
            snapshots.write_json("META", {"dimensions": dimensions, "model_id": self.model_id})

    @property
    def chunks(self) -> DataFrame:
        return self.snapshots.table("chunks")

    @property
    def edges(self) -> DataFrame:
        return self.snapshots.table("edges")

    @property
    def vectors(self) -> DataFrame:
        return self.snapshots.table("vectors")

    # -- writing

    def upsert(self, chunks: DataFrame, vectors: DataFrame | None = None) -> None:
        """Chunks replace those of their ids; without vectors the old ones of these ids go as well.  Buckets without such chunks stay as they are."""
        from .filters import one_per

        s = self.snapshots
        written, merged, touched = self._merged("chunks", chunks, lambda df: one_per(df, "id", F.desc("ord")))
        paths = s.read("chunks", written.values()).select(F.col("id").alias("chunk_id"), "file_path")
        rest = s.table("vectors", touched).join(paths.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", "embedding", "file_path")
        new = rest if vectors is None else rest.unionByName(vectors.join(paths, "chunk_id").select("chunk_id", "embedding", "file_path"))
        s.publish({"chunks": merged, "vectors": s.write("vectors", new)}, touched)

    def delete(self, ids: list[str]) -> None:
        touched = self.snapshots.buckets_of((self.get(ids), "file_path"))
        self._without(touched, ids, {"chunks": "id", "vectors": "chunk_id"})

    def delete_by_file(self, file_path: str) -> None:
        self._without(self._bucket_of(file_path), [file_path], {"chunks": "file_path", "vectors": "file_path"})

    def upsert_edges(self, edges: DataFrame) -> None:
        _, merged, touched = self._merged("edges", edges, lambda df: df.dropDuplicates(["id"]))
        self.snapshots.publish({"edges": merged}, touched)

    def delete_edges_by_file(self, file_path: str) -> None:
        self._without(self._bucket_of(file_path), [file_path], {"edges": "source_file_path"})

    def delete_edges_by_target(self, ids: list[str]) -> None:
        touched = self.snapshots.buckets_of((self.edges.where(F.col("target_chunk_id").isin(list(ids))), "source_file_path"))
        self._without(touched, ids, {"edges": "target_chunk_id"})

    def _bucket_of(self, file_path: str) -> list[int]:
        return self.snapshots.buckets_of((self.snapshots.spark.createDataFrame([(file_path,)], "file_path string"), "file_path"))

    def _merged(self, name: str, rows: DataFrame, single) -> tuple[dict[str, str], dict[str, str], list[int]]:
        """(folders of the new rows, folders of the new and the old that stay, touched buckets); ``single`` leaves one row of each id.

        The rows are computed and moved once, into their buckets.  These folders are what is published, unless an id repeats
        or old rows lie in the touched buckets.
        """
        s, path = self.snapshots, _PATH.get(name, "file_path")
        written = s.write(name, rows)
        n, most = self._repeats(s.read(name, written.values()))
        if most > 1:
            written = s.write(name, single(s.read(name, written.values())))
        new, touched = s.read(name, written.values()), {int(b) for b in written}
        if not s._list(name):
            return written, written, sorted(touched)
        # Only ids are looked up, and only those met are taken out.
        met = cut(s.table(name).select("id", path).join(_few(new.select("id"), n), "id", "left_semi"), "replaced")
        touched = sorted(touched | set(s.buckets_of((met, path))))
        if not any(int(b) in touched for b in s._list(name)):
            return written, written, touched
        old = s.table(name, touched)
        return written, s.write(name, old.join(_few(met.select("id"), n), "id", "left_anti").select(old.columns).unionByName(new)), touched

    @staticmethod
    def _repeats(rows: DataFrame) -> tuple[int, int]:
        """(rows, the most that share an id) by 64-bit hashes of the ids: two that agree by chance count as repeated, which costs time only."""
        each = rows.groupBy(F.xxhash64("id").alias("h")).agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows"), F.max("n").alias("most")).first()
        return each["rows"] or 0, each["most"] or 0

    def _without(self, touched: list[int], values: list[str], columns: dict[str, str]) -> None:
        """Rows with one of the values, a list of the caller's, leave the touched buckets.  The others are filtered where they lie, with no shuffle."""
        s = self.snapshots
        if not touched:
            return
        gone = F.broadcast(s.spark.createDataFrame([(v,) for v in values], "_gone string"))
        s.commit({n: s.table(n, touched).join(gone, F.col(c) == F.col("_gone"), "left_anti") for n, c in columns.items()}, touched, moved=False)

    def optimize(self, ann_rows: int = knn.ANN_ROWS) -> None:
        """Drops what no list names any more and, from ``ann_rows`` vectors on, makes the inverted file anew if vectors changed."""
        s = self.snapshots
        s.compact()
        version = self._vectors_version()
        known = s.read_json("ANN") or {}
        if known.get("version") == version:
            return
        rows = self.vectors.count()
        if rows < max(1, ann_rows):
            s.write_json("ANN", {})
        else:
            centres = knn.fit_cells(self.vectors, max(8, knn.cells_for(rows)))
            folder = f"ann/{uuid.uuid4().hex}"
            path = f"{s.prefix}{s.root}/{folder}"
            knn.assign_cells(self.vectors, centres).hint("rebalance", "cell").write.partitionBy("cell").parquet(path)
            assigned = s.spark.read.schema("chunk_id string, embedding array<float>, cell int").parquet(path)
            radii = knn.cell_radii(assigned, centres)
            pack = lambda a: base64.b64encode(np.asarray(a, "<f8").tobytes()).decode()
            s.write_json("ANN", {"version": version, "folder": folder, "centres": pack(centres), "shape": list(centres.shape), "radii": pack(radii)})
        if known.get("folder"):
            s.system.delete_dir(f"{s.root}/{known['folder']}")

    def _vectors_version(self) -> str:
        return json.dumps(sorted(self.snapshots._list("vectors").items()))

    # -- reading

    def search_vector(self, query: list[float], limit: int = 20, language=None, types=None, file_path=None, post_filter: int | None = None) -> DataFrame:
        """(id, dist, rank): filters first, then the nearest.

        With ``post_filter`` the filters are applied to that many times ``limit`` nearest instead, which may leave fewer than ``limit``.
        """
        filtered = (language, types, file_path) != (None, None, None)
        admitted = self.chunks.where(chunk_filter(language, types, file_path)).select(F.col("id").alias("chunk_id")) if filtered else None
        if filtered and post_filter is None:
            return knn.nearest(self.vectors.join(admitted, "chunk_id", "left_semi"), query, limit).withColumnRenamed("chunk_id", "id")
        near = self._nearest(query, limit * (post_filter if filtered else 1))
        if filtered:
            near = bm25.ranked(near.join(admitted, "chunk_id", "left_semi").orderBy("rank").limit(limit), [F.col("rank")], "_r").drop("rank").withColumnRenamed("_r", "rank")
        return near.withColumnRenamed("chunk_id", "id")

    def _nearest(self, query: list[float], limit: int) -> DataFrame:
        s = self.snapshots
        ann = s.read_json("ANN") or {}
        if not ann or ann["version"] != self._vectors_version():
            return knn.nearest(self.vectors, query, limit)
        unpack = lambda a: np.frombuffer(base64.b64decode(a), "<f8")
        assigned = s.spark.read.schema("chunk_id string, embedding array<float>, cell int").parquet(f"{s.prefix}{s.root}/{ann['folder']}")
        return knn.nearest_in_cells(assigned, unpack(ann["centres"]).reshape(ann["shape"]), unpack(ann["radii"]), query, limit)

    def search_text(self, query: str, limit: int = 20, language=None, types=None, file_path=None) -> DataFrame:
        """(id, score, rank) by BM25 from the postings; a query without words is looked for literally."""
        from ..functions.text import query_phrases

        where = chunk_filter(language, types, file_path)
        if not query_phrases(query):
            return bm25.like_search(self.chunks.where(where), query, limit).select("id", F.lit(0.0).alias("score"), "rank")
        admitted = None if (language, types, file_path) == (None, None, None) else self.chunks.where(where).select(F.col("id").alias("chunk_id"))
        scored = bm25.score_postings(self.snapshots.table("postings"), self.snapshots.table("lengths"), query, admitted).withColumnRenamed("chunk_id", "id")
        # Rounded, so that the order of a sum decides no tie.
        return bm25.top_k(scored.withColumn("score", F.round("score", 9)), limit)

    def get(self, ids: list[str]) -> DataFrame:
        return self.chunks.where(F.col("id").isin(ids))

    def chunks_by_file(self, file_path: str) -> DataFrame:
        return report.chunks_of(self.chunks, file_path)

    def list_files(self) -> DataFrame:
        return report.list_files(self.chunks)

    def count(self) -> int:
        return self.chunks.count()

    def count_by_language(self) -> DataFrame:
        return report.count_by(self.chunks, "language")

    def count_by_type(self) -> DataFrame:
        return report.count_by(self.chunks, "type")

    def symbols(self) -> DataFrame:
        return report.symbols(self.chunks)

    def outgoing(self, chunk: str, types=None) -> DataFrame:
        return graph.outgoing(self.edges, chunk, types)

    def incoming(self, chunk: str, types=None) -> DataFrame:
        return graph.incoming(self.edges, chunk, types)

    def count_edges(self) -> int:
        return self.edges.count()

    def count_edges_by_type(self) -> DataFrame:
        return report.count_by(self.edges, "type")


#: Back ends by name: functions of (spark, storage, buckets, dimensions, model) that give a store.
BACK_ENDS = {"parquet": lambda spark, storage, buckets, dimensions, model_id: IndexStore(Snapshots(spark, storage, buckets), dimensions, model_id)}


def open_store(spark: SparkSession, storage: str, back_end: str = "parquet", buckets: int = BUCKETS, dimensions: int | None = None, model_id: str | None = None):
    """A store of the named back end; others are added to ``BACK_ENDS``."""
    if back_end not in BACK_ENDS:
        raise ValueError(f"unknown back end {back_end}; there are {', '.join(sorted(BACK_ENDS))}")
    return BACK_ENDS[back_end](spark, storage, buckets, dimensions, model_id)
