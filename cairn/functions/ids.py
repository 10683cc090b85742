"""Identifiers of projects, chunks and edges, all of them hashes of what they name."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digest(length: int, *parts: Column | str) -> Column:
    return F.substring(F.sha1(F.concat_ws(":", *[F.col(p) if isinstance(p, str) else p for p in parts])), 1, length)


def project_id(root: str) -> str:
    return hashlib.sha1(root.encode()).hexdigest()[:12]


def chunk_id(project: Column | str, file_path: Column | str, start_line: Column | str) -> Column:
    """Two chunks that begin on one line of a file share an id; writers keep the later one."""
    return _digest(16, project, file_path, start_line)


def chunk_id_of(project: str, file_path: str, start_line: int) -> str:
    return hashlib.sha1(f"{project}:{file_path}:{start_line}".encode()).hexdigest()[:16]


def edge_id(project: Column | str, source: Column | str, target: Column | str, kind: Column | str) -> Column:
    return _digest(16, project, source, target, kind)
