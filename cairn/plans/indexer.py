"""The index of one folder: building, keeping up to date, asking."""

from __future__ import annotations

import logging
import os
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..chunking.extract import MAX_TOKENS
from ..chunking.spark import chunks_of, parse_files, raw_edges_of
from ..embedding.base import Embedder, embed
from ..functions.ids import project_id
from ..operators import diff, graph, report, resolve
from ..operators.filters import one_per
from ..operators.search import Searcher
from ..operators.shared import cut, shared_dir
from ..operators.store import IndexStore, Snapshots
from ..sources import scan, settings
from ..streaming.lock import IndexLock, SharedLock

log = logging.getLogger("cairn")


class NotInitialised(RuntimeError):
    pass


class Busy(RuntimeError):
    """The project is being indexed already."""


class Indexer:
    """``storage`` may lie on any shared file system; the lock lies beside a local one."""

    def __init__(self, spark: SparkSession, root: str, storage: str | None = None, embedder: Embedder | None = None, reranker: Callable | None = None, include: list[str] | None = None, exclude: list[str] | None = None,
                 max_chunk_tokens: int = MAX_TOKENS, min_chunk_tokens: int = 0, edge_source: str = "enclosing", on_event: Callable[[dict], None] | None = None, buckets: int = 64, poll_seconds: float = 10.0):
        self.spark, self.root = spark, os.path.abspath(root) if "://" not in root else root
        self.storage = storage or os.path.join(self.root, ".cairn")
        self.project = project_id(self.root)
        self.embedder, self.reranker = embedder, reranker
        self.include, self.exclude = include, [*(exclude or []), ".cairn/**", os.path.relpath(self.storage, self.root) + "/**" if "://" not in self.storage else ".cairn/**"]
        self.max_tokens, self.min_tokens, self.edge_source, self.on_event, self.buckets = max_chunk_tokens, min_chunk_tokens, edge_source, on_event, buckets
        self.store: IndexStore | None = None
        self.lock = IndexLock(self.storage) if "://" not in self.storage else SharedLock(spark, self.storage)
        self.poll_seconds, self._indexing, self._closed = poll_seconds, threading.Lock(), threading.Event()

    @property
    def is_leader(self) -> bool:
        return self.lock.held

    def initialize(self) -> None:
        """Opens the store.  Another embedding model or size than the index has starts it afresh."""
        self._closed.clear()
        if not self.lock.acquire():
            threading.Thread(target=self._follow, daemon=True).start()
        snapshots = Snapshots(self.spark, self.storage, self.buckets)
        meta = snapshots.read_json("META") or {}
        e = self.embedder
        if e and meta and (meta.get("dimensions"), meta.get("model_id")) != (e.dimensions, e.model_id) and self.is_leader:
            log.warning("the index was made with %s; it is made anew", meta.get("model_id"))
            snapshots.write_json("CURRENT", {})
            snapshots.write_json("META", {})
        self.store = IndexStore(snapshots, e.dimensions if e else None, e.model_id if e else None)
        self.searcher = Searcher(self.store, e, self.reranker)
        if warm_up := getattr(e, "warm_up", None):
            warm_up()

    def _follow(self) -> None:
        """Of a process that found the writer's place taken: it asks again and again, and once it leads brings the index up to date and goes on watching."""
        while not self._closed.wait(self.poll_seconds):
            if self.lock.acquire():
                log.info("this process is the writer now")
                try:
                    self.index_project()
                    if wanted := getattr(self, "_wanted", None):
                        self.start_watching(*wanted)
                except Exception:
                    log.exception("indexing after taking over failed")
                return

    def _opened(self) -> IndexStore:
        if self.store is None:
            raise NotInitialised("call initialize() first")
        return self.store

    def _scan(self) -> DataFrame:
        return scan.scan(self.spark, self.root, self.include, self.exclude)

    def _tables(self, files: DataFrame) -> dict[str, DataFrame]:
        """The new rows of every table for some files, each computed from one written parse."""
        parsed = parse_files(files, self.project, self.max_tokens, self.min_tokens, self.edge_source)
        # Parsing is Python; it is done once for all tables.
        folder = shared_dir(self.spark, "parsed")
        parsed.write.parquet(folder)
        parsed = self.spark.read.schema(parsed.schema).parquet(folder)
        chunks = one_per(chunks_of(parsed), "id", F.desc("ord"))
        defined = graph.defines(chunks).select("source_chunk_id", "source_file_path", F.lit("DEFINES").alias("type"), F.col("target_chunk_id").alias("target_symbol"), F.lit(None).cast("string").alias("target_file_path"), F.lit("{}").alias("metadata"), F.lit(1 << 30).alias("ord"))
        tables = {"chunks": chunks, "raw_edges": raw_edges_of(parsed).unionByName(defined)}
        paths = chunks.select(F.col("id").alias("chunk_id"), "file_path")
        tables["vectors"] = embed(chunks, self.embedder).join(paths, "chunk_id") if self.embedder else self.spark.createDataFrame([], model.VECTORS + ", file_path string")
        self._errors = parsed.where("error is not null").select("file_path", "error")
        return tables

    def _resolve(self) -> None:
        """All edges anew from all raw ones: what a changed file exports may be the target of any other's."""
        s = self._opened().snapshots
        aliases = resolve.aliases_frame(self.spark, settings.path_aliases(self.root)) if os.path.isdir(self.root) else None
        edges = resolve.resolve_all(s.table("raw_edges"), s.table("chunks"), s.table("files"), self.project, aliases)
        s.commit({"edges": edges})

    def index_project(self) -> dict:
        """Brings the index up to date with the folder and returns its statistics."""
        store = self._opened()
        if not self.is_leader:
            return {"project_id": self.project, "total_chunks": 0, "total_files": 0, "total_edges": 0}
        if not self._indexing.acquire(blocking=False):
            raise Busy("index_project() is running already")
        try:
            return self._index()
        finally:
            self._indexing.release()

    def _index(self) -> dict:
        store = self._opened()
        files = self._scan()
        changes = diff.manifest_diff(scan.manifest(files), store.snapshots.table("files")).where("status <> 'unchanged'")
        changes = cut(changes, "changes")
        if not changes.isEmpty():
            self._apply(files, changes)
            self._resolve()
            store.optimize()
        return self.stats()

    def _apply(self, files: DataFrame, changes: DataFrame) -> DataFrame:
        """Replaces what changed, and gives the events: one row for each changed file."""
        store = self._opened()
        again = files.join(changes.where("status <> 'removed'").select("file_path"), "file_path", "left_semi")
        tables = self._tables(again)
        store.snapshots.replace_files(changes, {**tables, "files": scan.manifest(again)})
        counts = store.chunks.join(changes.select("file_path"), "file_path", "left_semi").groupBy("file_path").agg(F.count("*").cast("int").alias("chunks_affected"))
        kind = F.when(F.col("error").isNotNull(), "error").when(F.col("status") == "removed", "removed").otherwise("indexed")
        told = changes.join(self._errors, "file_path", "left").join(counts, "file_path", "left")
        events = told.select(kind.alias("type"), "file_path", F.when(kind == "indexed", F.col("status")).alias("reason"), F.when(kind == "indexed", F.coalesce("chunks_affected", F.lit(0))).alias("chunks_affected"), "error")
        if self.on_event:
            for e in events.orderBy("file_path").toLocalIterator():
                self.on_event({k: v for k, v in e.asDict().items() if v is not None})
        return events

    def index_files(self, changed: list[str], removed: list[str] = ()) -> list[dict]:
        """Some files again, others removed; paths are relative.  What the scan's rules leave out is left alone."""
        store = self._opened()
        if not self.is_leader or not (changed or removed):
            return []
        files = self._scan().where(F.col("file_path").isin(list(changed)))
        known = store.snapshots.table("files").where(F.col("file_path").isin([*changed, *removed]))
        changes = cut(diff.manifest_diff(scan.manifest(files), known).where("status <> 'unchanged'"), "changes")
        if changes.isEmpty():
            return []
        events = self._apply(files, changes)
        self._resolve()
        return [{k: v for k, v in e.asDict().items() if v is not None} for e in events.orderBy("file_path").collect()]

    def index_file(self, path: str) -> list[dict]:
        return self.index_files([path])

    def remove_file(self, path: str) -> list[dict]:
        return self.index_files([], [path])

    def start_watching(self, checkpoint: str, debounce_ms: int = 500):
        """Watches the folder; a follower starts to once it leads."""
        if not self.is_leader:
            self._wanted = (checkpoint, debounce_ms)
            return None
        from ..streaming.watch import watch

        self._query = watch(self.spark, self, self.root, checkpoint, debounce_ms, self.on_event, r"(^|/)\.")
        return self._query

    def stop_watching(self) -> None:
        if getattr(self, "_query", None):
            self._query.stop()
            self._query = None

    # -- asking

    def search(self, query: str, options: model.SearchOptions = model.SearchOptions()) -> DataFrame:
        self._opened()
        return self.searcher.search(query, options)

    def search_semantic(self, query: str, options: model.SearchOptions = model.SearchOptions()) -> DataFrame:
        self._opened()
        return self.searcher.semantic(query, options)

    def search_lexical(self, query: str, options: model.SearchOptions = model.SearchOptions()) -> DataFrame:
        self._opened()
        return self.searcher.lexical(query, options)

    def search_with_context(self, query: str, options: model.ContextOptions = model.ContextOptions()) -> DataFrame:
        self._opened()
        return self.searcher.with_context(query, options)

    def neighbourhood(self, chunk: str, options: model.TraversalOptions = model.TraversalOptions()) -> DataFrame:
        """Edges around a chunk with the neighbours' columns, in order; nothing for an unknown chunk."""
        s = self._opened()
        found = graph.neighbourhood(s.edges, chunk, options.depth, options.limit, options.relation_types)
        shown = s.chunks.select(*[F.col(c).alias(f"chunk_{c}") for c in s.chunks.columns])
        return found.join(shown, F.col("neighbour") == F.col("chunk_id")).drop("neighbour")

    def related(self, chunk: str, relation: str) -> DataFrame:
        """``relation``: callers, callees, implementors, supertypes or usages."""
        s = self._opened()
        direction, types = graph.RELATED[relation]
        near = "target_chunk_id" if direction == "in" else "source_chunk_id"
        return graph.related(s.edges.where(F.col(near) == chunk), s.chunks, direction, types).drop("of")

    def dependencies(self, file_path: str) -> DataFrame:
        s = self._opened()
        return graph.related_files(s.edges, s.chunks, "out").where(F.col("of_file") == file_path).drop("of_file")

    def dependents(self, file_path: str) -> DataFrame:
        s = self._opened()
        return graph.related_files(s.edges, s.chunks, "in").where(F.col("of_file") == file_path).drop("of_file")

    def edges_from(self, chunk: str, types=None) -> DataFrame:
        return self._opened().outgoing(chunk, types)

    def edges_to(self, chunk: str, types=None) -> DataFrame:
        return self._opened().incoming(chunk, types)

    def stats(self) -> dict:
        s = self._opened()
        row = report.stats(s.chunks, s.edges, self.project).first().asDict()
        last = s.snapshots.table("files").agg(F.max("mtime")).first()[0]
        return row | {"last_indexed": last}

    def repo_map(self, options: model.RepoMapOptions = model.RepoMapOptions()) -> str:
        return report.repo_map_text(self._opened().chunks, options.types, options.max_files, options.format)

    def list_files(self) -> list[str]:
        return [r[0] for r in self._opened().list_files().toLocalIterator()]

    def chunks(self, file_path: str) -> DataFrame:
        return self._opened().chunks_by_file(file_path)

    def evaluate(self, queries: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
        """Recall at k of (query, expectedFile, expectedSymbol) rows: a hit lies in the file and, if given, has the symbol's name."""
        ranks = []
        for q in queries.collect():  # one search each
            hits = self.search(q["query"], model.SearchOptions(limit=max(ks)))
            ok = F.col("file_path") == q["expectedFile"]
            if q["expectedSymbol"]:
                ok &= F.col("name") == q["expectedSymbol"]
            ranks.append((q["query"], hits.where(ok).agg(F.min("rank")).first()[0]))
        return report.recall_at(self.spark.createDataFrame(ranks, "query string, hit_rank int"), ks)

    def close(self) -> None:
        self._closed.set()
        self.stop_watching()
        self.lock.release()
        self.store = None
