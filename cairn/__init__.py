"""Cairn: retrieval over source code and documents, as Spark DataFrames."""

from importlib import import_module

__version__ = "0.2.0"
_FROM = {
    "cairn.plans.indexer": ("Indexer", "NotInitialised", "Busy"),
    "cairn.model": ("SearchOptions", "ContextOptions", "TraversalOptions", "RepoMapOptions"),
    "cairn.operators.store": ("IndexStore", "Snapshots", "VectorStore", "GraphStore", "open_store", "DimensionMismatch"),
    "cairn.operators.search": ("Searcher",),
    "cairn.embedding.base": ("Embedder", "HashEmbedder"),
    "cairn.embedding.services": ("ServiceEmbedder", "ServiceReranker", "from_settings"),
    "cairn.chunking.extract": ("extract",),
    "cairn.chunking.spark": ("parse_files", "chunks_of", "raw_edges_of"),
    "cairn.sources.scan": ("scan",),
}
_WHERE = {name: module for module, names in _FROM.items() for name in names}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    """Public names are loaded when they are asked for."""
    if name not in _WHERE:
        raise AttributeError(f"module 'cairn' has no attribute {name!r}")
    return getattr(import_module(_WHERE[name]), name)
