"""One file's chunks and raw edges."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from ..functions.ids import chunk_id_of
from ..functions.text import expand_identifiers_text
from ..model import ANCHORS
from .absorb import absorb
from .formats import FORMATS, Section
from .scanner import KEYWORDS, Source, Spec
from .specs import SPECS

CHARS_PER_TOKEN = 4
MAX_TOKENS = 1500


@dataclass
class Chunk:
    type: str
    name: str | None
    content: str
    context: str
    start: int  # lines from 1
    end: int
    metadata: dict = field(default_factory=dict)
    id: str = ""


@dataclass
class RawEdge:
    type: str
    symbol: str
    file: str | None = None
    line: int | None = None
    source: str = ""
    metadata: dict = field(default_factory=dict)


Extracted = tuple[list[Chunk], list[RawEdge]]


def file_chunk(text: str, path: str) -> Chunk:
    return Chunk("file", path.rsplit("/", 1)[-1], text, text, 1, text.count("\n") + 1)


def _label(mark: tuple[str, str], kind: str, name: str) -> str:
    return f"{mark[0]} {kind[:1].upper() + kind[1:]}: {name}{mark[1]}"


def _built(lines: list[str], language: str, spec: Spec, kind: str, name: str, first: int, last: int, imports: str, parent: str | None, header: str | None) -> Chunk:
    first = absorb(lines, first, language) if language != "lua" else first
    content = "\n".join(lines[first : last + 1])
    crumbs = ([f"{spec.mark[0]} {spec.parent_label}: {parent}{spec.mark[1]}"] if parent else []) + [_label(spec.mark, kind, name)]
    crumb = "\n".join(crumbs)
    context = "\n\n".join(p for p in (crumb, imports, header if parent else None, content) if p)
    return Chunk(kind, name, content, context, first + 1, last + 1, ({"className": parent} if parent else {}) | {"breadcrumb": crumb})


def _import_chunk(lines: list[str], spans: list[tuple[int, int]]) -> Chunk:
    a, b = min(s[0] for s in spans), max(s[1] for s in spans)
    text = "\n".join(lines[a : b + 1])
    return Chunk("import", None, text, text, a + 1, b + 1)


def _names(listed: str) -> list[str]:
    """The last word of every type in a list, type arguments left out."""
    flat = re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", listed))
    out = []
    for part in flat.split(","):
        part = re.sub(r"\b(?:public|private|protected|virtual|where|with|by|permits)\b.*?(?=[A-Z_]|$)", "", part.split("(")[0]).strip()
        if words := re.findall(r"[A-Za-z_$][\w$]*", part):
            out.append(words[-1])
    return out


def scan_language(text: str, language: str) -> Extracted:
    spec = SPECS[language]
    source = Source(text, spec)
    chunks: list[Chunk] = []
    edges: list[RawEdge] = []
    imports, spans, hints = "", [], {}
    if spec.imports:
        for m in re.finditer(spec.imports, text, re.M):
            at = m.start() + len(m[0]) - len(m[0].lstrip())
            if at < len(source.masked) and source.masked[at].isspace() and not text[at].isspace():
                continue  # inside a comment or a string
            if language == "go" and not _go_import(source, at):
                continue
            module = next((m[g] for g in ("module", "module2") if g in m.re.groupindex and m[g]), None)
            if language == "php" and source.depth(at) > 0:
                continue
            spans.append((source.row(at), source.row(max(at, m.end() - 1))))
            if module:
                module = module.rstrip(".:\\") or module
                edges.append(RawEdge("IMPORTS", module, module))
                if named := re.search(r"\{([^}]*)\}", m[0]):
                    for n in named[1].split(","):
                        if n := re.split(r"\s+as\s+", n.strip())[-1].strip():
                            hints[n] = module
                if default := re.match(r"\s*import\s+(\w+)\s+from", m[0]):
                    hints[default[1]] = module
    if spans:
        if language == "go":
            spans = [(source.row(text.rfind("import", 0, source.starts[a] + len(source.lines[a]))), b + (text[source.starts[a] :].lstrip(" \t").startswith('"') or 0)) for a, b in spans]
            spans = [(a, _closing(source, a, b)) for a, b in spans]
        first = _import_chunk(source.lines, spans)
        imports = first.content
        chunks.append(first)
    nodes, taken, clauses = source.nodes(), set(), set()
    kinds = {(n.name, n.type) for n in nodes}
    for n in nodes:
        if (n.at, n.type) in taken or language in ("go", "csharp", "kotlin") and any((n.at, t) in taken for t in ("struct", "interface", "enum", "record", "class")):
            continue
        if language == "haskell" and n.type == "function":
            if n.name in clauses:
                continue
            clauses.add(n.name)
        if language == "objc" and n.head.startswith("@implementation") and (n.name, "class") in kinds and any(c.type == "class" and c.name == n.name for c in chunks):
            continue
        if language == "kotlin" and n.type == "class" and re.match(r"\s*(?:\w+\s+)*enum\s+class\b", n.head):
            continue
        taken.add((n.at, n.type))
        inner = n.parent if n.type not in spec.containers or n.rule.place == "member" else None
        header = None
        if inner and spec.header:
            header = next((source.lines[b.start] for b in nodes if b.name == inner and b.type in spec.containers), None)
        if n.type == "const" and any(c.type in ("function", "method", "class") and c.start - 1 < n.start and c.end - 1 > n.end for c in chunks):
            continue
        chunks.append(_built(source.lines, language, spec, n.type, n.name, n.start, n.end, imports, inner, header))
        if n.type in spec.containers:
            for relation, pattern in spec.heritage:
                for m in re.finditer(pattern, n.head):
                    for base in _names(m["names"]):
                        if base != n.name and base not in KEYWORDS:
                            edges.append(RawEdge(relation, base, hints.get(base), n.start + 1))
    if spec.calls:
        declared = {n.name_at for n in nodes}
        # Signatures in an interface and constructors in a Kotlin class's head are no calls.
        quiet = [(n.at, n.stop) for n in nodes if language in ("go", "typescript") and n.type == "interface"] + [(n.at, n.at + len(n.head)) for n in nodes if language == "kotlin" and n.type == "class"]
        for m in re.finditer(spec.calls, source.masked, re.M):
            callee, line = m["callee"], source.row(m.start("callee"))
            if callee in KEYWORDS or m.start("callee") in declared or _DECLARES.search(source.masked[source.starts[line] : m.start("callee")]) or language == "clojure" and callee.startswith(("def", "ns", "let", "fn")):
                continue
            if any(x <= m.start("callee") < y for x, y in quiet) or language == "erlang" and source.lines[line].startswith("-"):
                continue
            edges.append(RawEdge("CALLS", callee, None, line + 1))
    return chunks, edges


_DECLARES = re.compile(r"\b(?:def|defp|defmacro|func|function|fn|fun|sub|class|macro|modifier|event|error)\s+(?:\([^)]*\)\s*)?[\w.:&*]*$")


def _go_import(source: Source, at: int) -> bool:
    """Whether a quoted path stands in an import clause."""
    before = source.masked[:at]
    if source.masked.startswith("import", at):
        return True
    opened = before.rfind("import (")
    return opened >= 0 and ")" not in before[opened:]


def _closing(source: Source, first: int, last: int) -> int:
    head = source.masked[source.starts[first] :]
    if re.match(r"\s*import\s*\(", head) and (stop := head.find(")")) >= 0:
        return max(last if last < len(source.lines) and first == last else 0, source.row(source.starts[first] + stop))
    return min(last, len(source.lines) - 1) if first == last else first


def scan_python(text: str) -> Extracted:
    """By the grammar where the text has it, otherwise by indentation."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return scan_language(text, "python")
    spec, lines = SPECS["python"], text.split("\n")
    chunks: list[Chunk] = []
    edges: list[RawEdge] = []
    every = sorted((n for n in ast.walk(tree) if hasattr(n, "lineno")), key=lambda n: (n.lineno, n.col_offset))
    imported = [n for n in every if isinstance(n, ast.Import | ast.ImportFrom)]
    imports = ""
    if imported:
        first = _import_chunk(lines, [(n.lineno - 1, n.end_lineno - 1) for n in imported])
        imports = first.content
        chunks.append(first)
        for n in imported:
            for module in [a.name for a in n.names] if isinstance(n, ast.Import) else ["." * n.level + (n.module or "")]:
                edges.append(RawEdge("IMPORTS", module, module))
    classes = [n for n in every if isinstance(n, ast.ClassDef)]

    def top(n) -> int:
        return min([n.lineno, *(d.lineno for d in getattr(n, "decorator_list", ()))]) - 1

    for n in classes:
        chunks.append(_built(lines, "python", spec, "class", n.name, top(n), n.end_lineno - 1, imports, None, None))
        for b in n.bases:
            name = b.id if isinstance(b, ast.Name) else b.attr if isinstance(b, ast.Attribute) else None
            if name:
                edges.append(RawEdge("EXTENDS", name, None, n.lineno))
    for n in every:
        if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
            parent = next((c.name for c in classes if c.lineno <= n.lineno and c.end_lineno >= n.end_lineno), None)
            chunks.append(_built(lines, "python", spec, "function", n.name, top(n), n.end_lineno - 1, imports, parent, None))
    for n in every:
        if isinstance(n, ast.TypeAlias):
            chunks.append(_built(lines, "python", spec, "typealias", n.name.id, n.lineno - 1, n.end_lineno - 1, imports, None, None))
    for n in tree.body:
        target = n.targets[0] if isinstance(n, ast.Assign) else n.target if isinstance(n, ast.AnnAssign) and n.value else None
        if isinstance(target, ast.Name) and len("\n".join(lines[n.lineno - 1 : n.end_lineno])) >= 40:
            chunks.append(_built(lines, "python", spec, "const", target.id, n.lineno - 1, n.end_lineno - 1, imports, None, None))
    for n in every:
        if isinstance(n, ast.Call):
            name = n.func.id if isinstance(n.func, ast.Name) else n.func.attr if isinstance(n.func, ast.Attribute) else None
            if name:
                edges.append(RawEdge("CALLS", name, None, n.lineno))
    return chunks, edges


def _sections(text: str, path: str, found: list[Section]) -> list[Chunk]:
    lines, out = text.split("\n"), []
    for s in found:
        content = s.content if s.content is not None else "\n".join(lines[s.first : s.last + 1])
        context = s.context if s.context is not None else f"{s.breadcrumb}\n\n{content}" if s.breadcrumb else content
        meta = ({"level": s.level} if s.level is not None else {}) | ({"breadcrumb": s.breadcrumb} if s.breadcrumb else {})
        out.append(Chunk(s.type, s.name, content, context, s.first + 1, s.last + 1, meta))
    return out


_BLOCK = re.compile(r"<(script|template|style)\b([^>]*)>([\s\S]*?)</\1\s*>", re.I)


def scan_component(text: str, language: str) -> Extracted:
    """Vue and Svelte: scripts as TypeScript in place, styles and templates as sections."""
    chunks: list[Chunk] = []
    edges: list[RawEdge] = []
    covered: set[int] = set()
    for m in _BLOCK.finditer(text):
        kind, first, last = m[1].lower(), text.count("\n", 0, m.start()), text.count("\n", 0, m.end())
        covered.update(range(first, last + 1))
        if kind == "script":
            offset = text.count("\n", 0, m.start(3))
            found, own = scan_language(m[3], "typescript" if "ts" in m[2] or language == "vue" else "typescript")
            for c in found:
                c.start, c.end = c.start + offset, c.end + offset
            for e in own:
                e.line = e.line + offset if e.line else None
            chunks += found
            edges += own
        elif kind == "style" or language == "vue":
            crumb = f"// Section: {kind}"
            chunks.append(Chunk("section", kind, m[0], f"{crumb}\n\n{m[0]}", first + 1, last + 1, {"breadcrumb": crumb}))
    if language == "svelte":
        lines = text.split("\n")
        rest = [i for i, x in enumerate(lines) if i not in covered and x.strip()]
        if rest:
            content = "\n".join(x for i, x in enumerate(lines) if rest[0] <= i <= rest[-1] and i not in covered)
            chunks.append(Chunk("section", "template", content, f"// Section: template\n\n{content}", rest[0] + 1, rest[-1] + 1, {"breadcrumb": "// Section: template"}))
    return chunks, edges


def merge_small(chunks: list[Chunk], least: int) -> list[Chunk]:
    """Runs of short neighbours as one chunk; the DataFrame form is ``operators.structure.merge_siblings``."""
    runs: list[list[Chunk]] = []
    for c in chunks:
        small = c.type not in ANCHORS and len(c.content) < least
        p = runs[-1][-1] if runs else None
        if p and small and p.type not in ANCHORS and len(p.content) < least and c.start <= p.end + 2 and c.metadata.get("className") == p.metadata.get("className"):
            runs[-1].append(c)
        else:
            runs.append([c])
    out = []
    for run in runs:
        first = run[0]
        if len(run) == 1:
            out.append(first)
            continue
        content = "\n".join(c.content for c in run)
        at = first.context.rfind(first.content)
        prefix = first.context[:at].rstrip() if at > 0 else ""
        out.append(Chunk(first.type, first.name and f"{first.name} +{len(run) - 1}", content, f"{prefix}\n\n{content}" if prefix else content, first.start, run[-1].end, dict(first.metadata)))
    return out


def _enclosing(chunks: list[Chunk], line: int) -> str:
    inside = [c for c in chunks if c.type in ("function", "method") and c.start <= line <= c.end]
    if not inside:
        inside = [c for c in chunks if c.type not in ("import", "file") and c.start <= line <= c.end]
    return inside[0].id if inside else ""


def extract(text: str, path: str, project: str, language: str | None, max_tokens: int = MAX_TOKENS, min_tokens: int = 0, edge_source: str = "enclosing", extra: dict[str, Callable[[str], Extracted]] | None = None) -> Extracted:
    """Chunks with ids, and edges with their source chunk.

    An unknown language gives nothing.  A known one without declarations gives the whole file.  ``edge_source``:
    "enclosing" attributes an edge to the first function or method around it, "first_chunk" every edge to the file's first chunk.
    ``extra`` adds or replaces languages.
    """
    if extra and language in extra:
        chunks, edges = extra[language](text)
    elif language in FORMATS:
        chunks, edges = _sections(text, path, FORMATS[language](text.split("\n"), max_tokens * CHARS_PER_TOKEN)), []
    elif language in ("vue", "svelte"):
        chunks, edges = scan_component(text, language)
    elif language == "python":
        chunks, edges = scan_python(text)
    elif language in SPECS:
        chunks, edges = scan_language(text, language)
    else:
        return [], []
    if not chunks or all(c.type == "import" for c in chunks) and language not in ("vue", "svelte", "typescript", "javascript"):
        chunks = [*chunks, file_chunk(text, path)]
    if min_tokens and language not in FORMATS:
        chunks = merge_small(chunks, min_tokens * CHARS_PER_TOKEN)
    for c in chunks:
        c.id = chunk_id_of(project, path, c.start)
        if c.type == "file" and c.name is None and language in ("yaml", "toml", "json", "sql", "css", "scss"):
            c.name = path.rsplit("/", 1)[-1]
    for e in edges:
        e.source = (_enclosing(chunks, e.line) if edge_source == "enclosing" and e.line else "") or chunks[0].id
    return chunks, edges


def chunk_rows(chunks: list[Chunk], path: str, project: str, language: str) -> list[dict]:
    return [
        {
            "id": c.id, "project_id": project, "file_path": path, "language": language, "type": c.type, "name": c.name or None, "content": c.content, "context_content": c.context,
            "start_line": c.start, "end_line": c.end, "metadata": json.dumps(c.metadata, ensure_ascii=False, sort_keys=True), "search_content": expand_identifiers_text(f"{c.content} {c.name or ''}"), "ord": i,
        }
        for i, c in enumerate(chunks)
    ]


def edge_rows(edges: list[RawEdge], path: str) -> list[dict]:
    return [{"source_chunk_id": e.source, "source_file_path": path, "type": e.type, "target_symbol": e.symbol, "target_file_path": e.file, "metadata": json.dumps(e.metadata), "ord": i} for i, e in enumerate(edges)]
