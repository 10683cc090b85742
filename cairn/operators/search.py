"""Searches over a store: routing, fusion, reranking, widening by the graph."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..embedding.base import Embedder
from ..model import ContextOptions, SearchOptions
from . import fusion, graph
from .bm25 import ranked
from .store import IndexStore

log = logging.getLogger("cairn")
#: How many more than asked each leg fetches: alone, within a hybrid search, and of those what is fused.
ALONE, LEG, FUSED = 2, 9, 3


class Searcher:
    def __init__(self, store: IndexStore, embedder: Embedder | None = None, reranker: Callable[[str, list[str]], list[float]] | None = None):
        self.store, self.embedder, self.reranker = store, embedder, reranker

    def search(self, query: str, options: SearchOptions = SearchOptions()) -> DataFrame:
        """(rank, match_type, chunk columns): hybrid with an embedder, unless switched off; otherwise semantic or lexical."""
        if self.embedder is not None:
            return self.hybrid(query, options) if options.hybrid else self.semantic(query, options)
        return self.lexical(query, options)

    def _filters(self, o: SearchOptions) -> dict:
        return {"language": o.language, "types": o.types, "file_path": o.file_path}

    def _vector(self, query: str) -> list[float]:
        if self.embedder is None:
            raise ValueError("semantic search needs an embedder")
        return self.embedder.embed_query(query)

    def _shown(self, hits: DataFrame, match: str, limit: int) -> DataFrame:
        few = hits.select("id", "rank")
        joined = self.store.chunks.join(F.broadcast(few), "id")  # a result list
        kept = fusion.dedupe(joined)
        out = ranked(kept.orderBy("rank", "id").limit(limit), [F.col("rank"), F.col("id")], "_r").drop("rank").withColumnRenamed("_r", "rank")
        return out.withColumn("match_type", F.lit(match)).select("rank", "match_type", *self.store.chunks.columns)

    def semantic(self, query: str, options: SearchOptions = SearchOptions()) -> DataFrame:
        v = self._vector(query)
        if not v:
            return self.store.chunks.limit(0).select(F.lit(0).alias("rank"), F.lit("semantic").alias("match_type"), "*")
        return self._shown(self.store.search_vector(v, ALONE * options.limit, **self._filters(options)), "semantic", options.limit)

    def lexical(self, query: str, options: SearchOptions = SearchOptions()) -> DataFrame:
        return self._shown(self.store.search_text(query, ALONE * options.limit, **self._filters(options)), "lexical", options.limit)

    def hybrid(self, query: str, options: SearchOptions = SearchOptions()) -> DataFrame:
        """Both legs by reciprocal rank, then the reranker over all that was fused.  A leg that fails, when planned or when run, counts as empty."""
        n, legs = options.limit, []
        for name, leg in (("semantic", lambda: self.store.search_vector(self._vector(query), LEG * n, **self._filters(options))), ("lexical", lambda: self.store.search_text(query, LEG * n, **self._filters(options)))):
            rows = []
            try:
                rows = [(r["id"], r["rank"]) for r in leg().select("id", "rank").collect()]  # at most LEG times the limit
            except Exception:
                log.exception("the %s leg failed", name)
            legs.append(self.store.snapshots.spark.createDataFrame(rows, "id string, rank int"))
        fused = fusion.fuse(*legs, k=options.rrf_k, limit=FUSED * n)
        shown = self._shown(fused, "hybrid", FUSED * n)
        if self.reranker is not None and options.rerank:
            shown = fusion.rerank(shown, query, self.reranker).drop("rerank_score").select(shown.columns)
        return shown.where(F.col("rank") < n)

    def with_context(self, query: str, options: ContextOptions = ContextOptions()) -> DataFrame:
        """Base hits, filled up to the limit with up to five neighbours of each hit, in the hits' order."""
        base = self.search(query, options)
        if options.graph_depth == 0:
            return base
        hits = base.select("id", "rank").orderBy("rank").collect()  # at most ``limit``
        seen, more = {h[0] for h in hits}, []
        if len(hits) >= options.limit:
            return base
        around = graph.neighbourhood(self.store.edges, [h[0] for h in hits], options.graph_depth, 5, options.graph_relation_types).select("seed", "pos", "neighbour").collect()  # five of each hit
        place = {h[0]: h[1] for h in hits}
        for row in sorted(around, key=lambda r: (place[r["seed"]], r["pos"])):
            if len(seen) >= 3 * options.limit:
                break
            if row["neighbour"] not in seen:
                seen.add(row["neighbour"])
                more.append((row["neighbour"], len(hits) + len(more)))
        extra = self.store.snapshots.spark.createDataFrame(more, "id string, rank int")
        match = base.select("match_type").first()
        added = self.store.chunks.join(F.broadcast(extra), "id").withColumn("match_type", F.lit(match[0] if match else "lexical")).select(base.columns)
        return ranked(base.unionByName(added).orderBy("rank").limit(options.limit), [F.col("rank")], "_r").drop("rank").withColumnRenamed("_r", "rank").select(base.columns)
