"""What an embedder is, how Spark runs one, and one that needs no service."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from typing import Protocol, runtime_checkable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import identifier_parts


@runtime_checkable
class Embedder(Protocol):
    dimensions: int
    model_id: str | None

    def generate(self, texts: list[str]) -> list[list[float]]: ...

    def embed_query(self, text: str) -> list[float]: ...


class HashEmbedder:
    """Signed hashes of words, their parts and character trigrams, in unit length: the same everywhere, without training."""

    def __init__(self, dimensions: int = 256):
        self.dimensions, self.model_id = dimensions, f"hash-{dimensions}"

    def _one(self, text: str) -> list[float]:
        v = np.zeros(self.dimensions)
        for token in re.findall(r"[^\W_]\w*", text):
            words = [token.lower(), *identifier_parts(token)]
            for w in words:
                for g, weight in [(w, 1.0), *((f"#{w[i : i + 3]}", 0.3) for i in range(len(w) - 2))]:
                    h = int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest())
                    v[h % self.dimensions] += weight if h >> 63 else -weight
        n = math.sqrt(float(v @ v))
        return (v / n if n else v).tolist()

    def generate(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def embed_query(self, text: str) -> list[float]:
        return self._one(text)


def embed(rows: DataFrame, embedder: Embedder, id_col: str = "id", text_col: str = "context_content", batch: int = 256) -> DataFrame:
    """(chunk_id, embedding) by tasks that call the embedder on Arrow batches; null texts and vectors of a wrong length are left out."""
    size = embedder.dimensions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, values = b.column(0).to_pylist(), b.column(1).to_pylist()
            for a in range(0, len(ids), batch):
                got = embedder.generate(values[a : a + batch])
                kept = [(i, v) for i, v in zip(ids[a : a + batch], got) if v is not None and len(v) == size]
                yield pa.record_batch([pa.array([i for i, _ in kept], b.column(0).type), pa.array([v for _, v in kept], pa.list_(pa.float32()))], ["chunk_id", "embedding"])

    return rows.select(id_col, text_col).where(F.col(text_col).isNotNull()).mapInArrow(run, f"chunk_id {dict(rows.dtypes)[id_col]}, embedding array<float>")
