"""Chunking as a Spark operator."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import CHUNKS, RAW_EDGES
from .extract import MAX_TOKENS, chunk_rows, edge_rows, extract

_TEXT = pa.string()
_CHUNK = pa.struct([(f.split()[0], pa.int32() if f.split()[1] == "int" else _TEXT) for f in CHUNKS.split(", ")])
_EDGE = pa.struct([(f.split()[0], pa.int32() if f.split()[1] == "int" else _TEXT) for f in RAW_EDGES.split(", ")])
PARSED = f"file_path string, chunks array<struct<{CHUNKS.replace(' ', ':').replace(',:', ',')}>>, raw_edges array<struct<{RAW_EDGES.replace(' ', ':').replace(',:', ',')}>>, error string"


def parse_files(files: DataFrame, project: str, max_tokens: int = MAX_TOKENS, min_tokens: int = 0, edge_source: str = "enclosing") -> DataFrame:
    """(file_path, chunks, raw_edges, error), one row for each row of ``files`` (file_path, language, text).

    A file that can't be parsed has its reason in ``error`` and no chunks; the others go on.  Null texts count as empty.
    """

    def one(path: str, language: str | None, text: str | None) -> dict:
        try:
            chunks, edges = extract(text or "", path, project, language, max_tokens, min_tokens, edge_source)
            return {"file_path": path, "chunks": chunk_rows(chunks, path, project, language or ""), "raw_edges": edge_rows(edges, path), "error": None}
        except Exception as e:  # one file's trouble is that file's
            return {"file_path": path, "chunks": [], "raw_edges": [], "error": f"{type(e).__name__}: {e}"}

    schema = pa.schema([("file_path", _TEXT), ("chunks", pa.list_(_CHUNK)), ("raw_edges", pa.list_(_EDGE)), ("error", _TEXT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, languages, values = (b.column(c).to_pylist() for c in range(3))
            for a in range(0, len(paths), 64):
                part = slice(a, a + 64)
                yield pa.RecordBatch.from_pylist([one(*x) for x in zip(paths[part], languages[part], values[part])], schema)

    return files.select("file_path", "language", "text").mapInArrow(run, PARSED)


def chunks_of(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.inline("chunks"))


def raw_edges_of(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.inline("raw_edges"))
