"""Embedding and reranking: protocols, an offline embedder, clients of hosted services."""
