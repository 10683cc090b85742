"""``python -m cairn.cli``: index, watch, search, graph, map, stats, clear, eval."""

from __future__ import annotations

import argparse
import json
import sys
import time

from .embedding.services import from_settings
from .model import ContextOptions, RepoMapOptions, TraversalOptions
from .sources.scan import eval_set
from .sources.settings import find_settings

FORMATS = ("raw", "json", "pretty-json")


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cairn", description=__doc__)
    p.add_argument("--dir", default=".")
    p.add_argument("--storage")
    p.add_argument("--include", action="append")
    p.add_argument("--exclude", action="append")
    p.add_argument("--format", choices=FORMATS, default="raw")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("index", "stats", "clear"):
        sub.add_parser(name)
    w = sub.add_parser("watch")
    w.add_argument("--checkpoint", required=True)
    w.add_argument("--debounce", type=int, default=500)
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--limit", type=int, default=10)
    s.add_argument("--offset", type=int, default=0)
    s.add_argument("--language", action="append")
    s.add_argument("--type", action="append")
    s.add_argument("--path")
    s.add_argument("--depth", type=int, default=0)
    s.add_argument("--no-hybrid", action="store_true")
    g = sub.add_parser("graph")
    g.add_argument("chunk")
    g.add_argument("--depth", type=int, choices=(1, 2, 3), default=1)
    g.add_argument("--limit", type=int, default=20)
    g.add_argument("--relation", action="append")
    m = sub.add_parser("map")
    m.add_argument("--max-files", type=int)
    m.add_argument("--type", action="append")
    e = sub.add_parser("eval")
    e.add_argument("queries")
    e.add_argument("--k", default="1,5,10")
    return p


def shown(rows: list[dict], how: str) -> str:
    if how == "raw":
        return "\n".join("\t".join(str(v) for v in r.values()) for r in rows)
    return json.dumps(rows, indent=2 if how == "pretty-json" else None, default=str, ensure_ascii=False)


def search_page(indexer, query: str, limit: int = 10, offset: int = 0, include_content: bool = True, **filters) -> dict:
    """One page of results with location, and whether there are more; one hit more than shown is fetched."""
    hits = indexer.search_with_context(query, ContextOptions(limit=offset + limit + 1, **filters)).orderBy("rank").collect()
    page = hits[offset : offset + limit]
    out = [{"id": h["id"], "loc": f"{h['file_path']}:{h['start_line']}-{h['end_line']}", "type": h["type"], "name": h["name"], "match": h["match_type"]} | ({"content": h["content"]} if include_content else {}) for h in page]
    more = {"has_more": True} if len(hits) > offset + limit else {}
    warning = {} if indexer.embedder else {"warning": "semantic search is off: no embedder"}
    return {"results": out, "total": len(out), **({"offset": offset} if offset else {}), **more, **warning}


def run(argv: list[str] | None = None, spark=None) -> int:
    from .plans.indexer import Indexer

    a = _parser().parse_args(argv)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("cairn").getOrCreate()
    embedder, reranker = from_settings(find_settings(a.dir))
    ix = Indexer(spark, a.dir, a.storage, embedder, reranker, a.include, a.exclude, on_event=lambda e: print(json.dumps(e), file=sys.stderr))
    ix.initialize()
    try:
        if a.command == "index":
            print(shown([ix.index_project()], a.format))
        elif a.command == "stats":
            print(shown([ix.stats()], a.format))
        elif a.command == "clear":
            ix.store.snapshots.clear()
        elif a.command == "watch":
            ix.index_project()
            query = ix.start_watching(a.checkpoint, a.debounce)
            try:
                query.awaitTermination()
            except KeyboardInterrupt:
                pass
        elif a.command == "search":
            t = time.time()
            out = search_page(ix, a.query, a.limit, a.offset, language=tuple(a.language) if a.language else None, types=tuple(a.type) if a.type else None, file_path=a.path, hybrid=not a.no_hybrid, graph_depth=a.depth)
            print(shown(out["results"], a.format) if a.format == "raw" else json.dumps(out, indent=2 if a.format == "pretty-json" else None, default=str))
            print(f"{time.time() - t:.2f} s", file=sys.stderr)
        elif a.command == "graph":
            rows = ix.neighbourhood(a.chunk, TraversalOptions(a.depth, a.limit, tuple(a.relation) if a.relation else None)).orderBy("pos")
            print(shown([r.asDict() for r in rows.select("hop", "direction", "type", "chunk_id", "chunk_name", "chunk_file_path").collect()], a.format))
        elif a.command == "map":
            print(ix.repo_map(RepoMapOptions(a.max_files, tuple(a.type) if a.type else None, "text" if a.format == "raw" else "json")))
        elif a.command == "eval":
            print(shown([r.asDict() for r in ix.evaluate(eval_set(spark, a.queries), tuple(map(int, a.k.split(",")))).collect()], a.format))
        return 0
    finally:
        ix.close()


if __name__ == "__main__":
    sys.exit(run())
