"""Chunk types for the kinds that parsers report."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import CHUNK_TYPES

_ENDING = re.compile(r"_(?:declaration|definition|item|specifier|statement)$")
_SAME = {
    "class": "impl", "const": "static", "enum": "enum_class", "extension": "category_interface", "function": "arrow_function generator generator_function",
    "macro": "defmacro preproc_def", "module": "mod", "namespace": "internal_module", "typealias": "alias type_alias", "variable": "let",
}
_OTHER = {other: kind for kind, names in _SAME.items() for other in names.split()} | {k: k for k in CHUNK_TYPES if k != "file"}


def chunk_type(kind: str) -> str:
    """By name, with or without a parser's ending; "file" for what is no declaration.  A Rust type item is an alias."""
    kind = kind.lower()
    if kind == "type_item":
        return "typealias"
    return _OTHER.get(kind) or _OTHER.get(_ENDING.sub("", kind)) or "file"


def chunk_type_of(kind: Column | str) -> Column:
    c = F.lower(F.col(kind) if isinstance(kind, str) else kind)
    table = F.create_map(*[F.lit(x) for kv in _OTHER.items() for x in kv])
    known = F.coalesce(F.try_element_at(table, c), F.try_element_at(table, F.regexp_replace(c, _ENDING.pattern, "")), F.lit("file"))
    return F.when(c == "type_item", "typealias").otherwise(known)


def sections_from_outline(text: str, items: list[tuple[str, str | None, int, int, list[tuple[str, str | None, int, int]]]], imports: list[tuple[int, int, str]] = ()):
    """Chunks and import edges from any parser's outline: (kind, name, first row, last row, children) and (first row, last row, statement).

    Children of one level become chunks of their own, named after their parent's class; without an outline the text is one chunk.
    """
    from .extract import Chunk, RawEdge, _import_chunk, file_chunk

    lines, chunks, edges = text.split("\n"), [], []

    def add(kind: str, name: str | None, a: int, b: int, parent: str | None) -> None:
        crumbs = ([f"// Class: {parent}"] if parent else []) + ([f"// {kind[:1].upper() + kind[1:]}: {name}"] if name else [])
        content, crumb = "\n".join(lines[a : b + 1]), "\n".join(crumbs)
        meta = ({"className": parent} if parent else {}) | ({"breadcrumb": crumb} if crumb else {})
        chunks.append(Chunk(chunk_type(kind), name, content, f"{crumb}\n\n{content}" if crumb else content, a + 1, b + 1, meta))

    for kind, name, a, b, children in items:
        add(kind, name, a, b, None)
        for k, n, x, y in children:
            add(k, n, x, y, name)
    if not chunks:
        chunks.append(file_chunk(text, ""))
    if imports:
        chunks.insert(0, _import_chunk(lines, [(a, b) for a, b, _ in imports]))
        edges = [RawEdge("IMPORTS", m, m) for *_, s in imports if (m := imported_module(s))]
    return chunks, edges


_MODULE = (r"from\s+(\S+)\s+import\b", r"import\s+(?:static\s+)?([\w.]+)", r"use\s+([\w:]+)")


def imported_module(statement: str) -> str | None:
    """The module that an import statement of a common language names."""
    s = statement.strip().removesuffix(";")
    return next((m[1] for p in _MODULE if (m := re.match(p, s))), None)
