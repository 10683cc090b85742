"""Schemas, kinds and options."""

from __future__ import annotations

from dataclasses import dataclass

RELATIONS = ("CALLS", "IMPORTS", "DEFINES", "EXTENDS", "IMPLEMENTS", "USES")

CHUNK_TYPES = tuple(
    """actor class const dsl_call enum error event extension file function functor import instance interface library
    macro method mixin modifier module module_type namespace newtype object param_block property protocol record
    section state_variable struct test trait type typealias variable""".split()
)

#: What a repository map lists unless told otherwise.
SYMBOL_TYPES = ("class", "enum", "function", "interface", "method", "type")
#: Kinds that a run of small neighbours never swallows.
ANCHORS = ("class", "enum", "file", "import", "interface", "library", "module", "namespace", "protocol", "record", "struct", "trait")

#: ``ord`` is the order of emission within a file; "first" and "last" below always mean by it.
CHUNKS = (
    "id string, project_id string, file_path string, language string, type string, name string, content string, "
    "context_content string, start_line int, end_line int, metadata string, search_content string, ord int"
)
RAW_EDGES = "source_chunk_id string, source_file_path string, type string, target_symbol string, target_file_path string, metadata string, ord int"
EDGES = "id string, project_id string, source_chunk_id string, source_file_path string, target_chunk_id string, type string, metadata string"
FILES = "file_path string, sha1 string, size long, mtime timestamp, language string"
VECTORS = "chunk_id string, embedding array<float>"
EVENTS = "type string, file_path string, reason string, chunks_affected int, error string"
EVAL_SET = "query string, expectedFile string, expectedSymbol string"


@dataclass(frozen=True)
class SearchOptions:
    """Filters are applied before ranking; an empty language list admits nothing, an empty type list everything."""

    limit: int = 10
    language: str | tuple[str, ...] | None = None
    types: tuple[str, ...] | None = None
    file_path: str | None = None
    hybrid: bool = True
    rerank: bool = True
    rrf_k: int = 45


@dataclass(frozen=True)
class ContextOptions(SearchOptions):
    graph_depth: int = 1
    graph_relation_types: tuple[str, ...] | None = None


@dataclass(frozen=True)
class TraversalOptions:
    depth: int = 1
    limit: int | None = 20
    relation_types: tuple[str, ...] | None = None


@dataclass(frozen=True)
class RepoMapOptions:
    max_files: int | None = None
    types: tuple[str, ...] | None = None
    format: str = "text"
