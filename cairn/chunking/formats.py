"""Data, markup and style formats: sections of lines, most of them without edges.

Each function gives (type, name, first row, last row, breadcrumb, metadata) per section; rows count from 0.  A name of
None with type "file" is the whole text.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from typing import NamedTuple

from .scanner import Lexis

#: A format is split only where it has more sections than this.
FEW = 3


class Section(NamedTuple):
    type: str
    name: str | None
    first: int
    last: int
    breadcrumb: str = ""
    level: int | None = None
    content: str | None = None
    context: str | None = None


def whole(lines: list[str]) -> list[Section]:
    return [Section("file", None, 0, len(lines) - 1)]


def _between(marks: list[tuple[int, str]], lines: list[str], label) -> list[Section]:
    ends = [m[0] for m in marks[1:]] + [len(lines)]
    return [Section("file", name, a, b - 1, label(name)) for (a, name), b in zip(marks, ends) if any(x.strip() for x in lines[a:b])]


def json_sections(lines: list[str], max_chars: int) -> list[Section]:
    """One for each key at an indent of two; else the whole text while it isn't too long; else its outermost entries."""
    marks = [(i, m[1]) for i, x in enumerate(lines) if (m := re.match(r' {2}"([^"]+)"\s*:', x))]
    if len(marks) > FEW:
        return _between(marks, lines, lambda _: "")
    if sum(map(len, lines)) + len(lines) - 1 <= max_chars:
        return whole(lines)
    text = "\n".join(lines)
    masked, depth, found, start = Lexis(line=(), block=(), strings=('"',)).mask(text), 0, [], 0
    for m in re.finditer(r"[\[\]{},]", masked):
        if m[0] in "[{":
            depth += 1
            if depth == 1:
                start = m.end()
        elif m[0] != ",":
            depth -= 1
        if depth == 1 and m[0] == "," or depth == 0:
            key = re.match(r'\s*"([^"]+)"\s*:', text[start : m.start()])
            at = start + len(text[start : m.start()]) - len(text[start : m.start()].lstrip())
            if text[start : m.start()].strip():
                found.append(Section("file", key[1] if key else None, text.count("\n", 0, at), text.count("\n", 0, m.start())))
            start = m.end()
    return found if len(found) > 1 else whole(lines)


def yaml_sections(lines: list[str], max_chars: int) -> list[Section]:
    marks: list[tuple[int, str]] = []
    for i, x in enumerate(lines):
        if m := re.match(r"([a-zA-Z_][\w-]*):", x, re.A):
            marks.append((i, m[1]))
        elif x.startswith("---") and marks:
            marks.append((i, "---"))
    found = _between(marks, lines, lambda n: f"# Key: {n}")
    return found if len(found) > FEW else whole(lines)


def toml_sections(lines: list[str], max_chars: int) -> list[Section]:
    marks = [(i, m[1].strip()) for i, x in enumerate(lines) if (m := re.match(r"\[{1,2}([^\]]+)\]", x))]
    found = _between(marks, lines, lambda n: f"# Table: {n}")
    return found if len(found) > FEW else whole(lines)


class _Elements(HTMLParser):
    """Outermost elements; void ones and unclosed ones end where the text says they do."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.found: list[list] = []

    def handle_starttag(self, tag, attrs):
        if not self.open:
            self.found.append([tag, self.getpos()[0] - 1, self.getpos()[0] - 1 + (self.get_starttag_text() or "").count("\n")])
        if tag not in self.VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        if not self.open:
            self.found.append([tag, self.getpos()[0] - 1, self.getpos()[0] - 1])

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass
            if not self.open and self.found:
                self.found[-1][2] = self.getpos()[0] - 1


def html_elements(text: str) -> list[tuple[str, int, int]]:
    """(tag, first row, last row) of the outermost elements; where one element holds the others, of those in its body."""
    p = _Elements()
    p.feed(text)
    p.close()
    last = text.count("\n")
    if p.open and p.found:
        p.found[-1][2] = last
    return [tuple(f) for f in p.found]


def _element_sections(lines: list[str], found: list[tuple[str, int, int]]) -> list[Section]:
    return [Section("file", t, a, b, f"<!-- Element: {t} -->") for t, a, b in found] if len(found) > FEW else whole(lines)


def html_sections(lines: list[str], max_chars: int) -> list[Section]:
    return _element_sections(lines, html_elements("\n".join(lines)))


def xml_sections(lines: list[str], max_chars: int) -> list[Section]:
    """The root's children; a text that isn't well formed stays whole."""
    from xml.parsers import expat

    depth, found = 0, []
    parser = expat.ParserCreate()

    def start(tag, _):
        nonlocal depth
        depth += 1
        if depth == 2:
            found.append([tag, parser.CurrentLineNumber - 1, parser.CurrentLineNumber - 1])

    def end(_):
        nonlocal depth
        if depth == 2:
            found[-1][2] = parser.CurrentLineNumber - 1
        depth -= 1

    parser.StartElementHandler, parser.EndElementHandler = start, end
    try:
        parser.Parse("\n".join(lines), True)
    except expat.ExpatError:
        return whole(lines)
    return _element_sections(lines, [tuple(f) for f in found])


def markdown_sections(lines: list[str], max_chars: int) -> list[Section]:
    """A section for each heading of level 1 to 3; what precedes the first is dropped.  A section whose text with
    breadcrumb is too long is cut at blank lines, its parts without name."""
    marks = [(i, len(m[1]), m[2].strip()) for i, x in enumerate(lines) if (m := re.match(r"(#{1,3})\s+(.+)", x))]
    if not marks:
        return whole(lines)
    out: list[Section] = []
    stack: list[str] = []
    for (a, level, heading), b in zip(marks, [m[0] for m in marks[1:]] + [len(lines)]):
        stack = [*stack[: level - 1], heading]
        content = "\n".join(lines[a:b]).strip()
        crumb = " > ".join(stack)
        context = f"{crumb}\n\n{content}"
        if len(context) <= max_chars:
            out.append(Section("section", heading, a, b - 1, crumb, level, content, context))
            continue
        buffer, begin, at = "", a, a
        for part in re.split(r"\n{2,}", content):
            if buffer and len(buffer) + len(part) > max_chars:
                out.append(Section("section", None, begin, at - 1, "", None, buffer.strip(), f"{context}\n\n{buffer.strip()}"))
                buffer, begin = part, at
            else:
                buffer = f"{buffer}\n\n{part}" if buffer else part
            at += part.count("\n") + 2
        if buffer.strip():
            out.append(Section("section", None, begin, at - 1, "", None, buffer.strip(), f"{context}\n\n{buffer.strip()}"))
    return out


_SQL = (
    ("TABLE", "struct"), ("VIEW", "type"), ("FUNCTION", "function"), ("PROCEDURE", "function"), ("TRIGGER", "type"), ("INDEX", "type"), ("SCHEMA", "namespace"),
)


def sql_sections(lines: list[str], max_chars: int) -> list[Section]:
    """A chunk for each statement, by its semicolons outside strings, comments and dollar quotes."""
    from .absorb import absorb

    text = "\n".join(lines)
    masked = re.sub(r"\$(\w*)\$[\s\S]*?\$\1\$", lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    masked = Lexis(line=("--",), strings=("'", '"')).mask(masked)
    out, start, seen = [], 0, set()
    for stop in [*(m.start() for m in re.finditer(";", masked)), len(masked)]:
        piece = masked[start:stop]
        at = start + len(piece) - len(piece.lstrip())
        row, last = text.count("\n", 0, at), text.count("\n", 0, start + len(piece.rstrip()))
        label = kind = None
        if m := re.match(rf"\s*CREATE\s+(?:(?:OR\s+REPLACE|UNIQUE|TEMP|TEMPORARY|MATERIALIZED|EXTERNAL)\s+)*({'|'.join(k for k, _ in _SQL)})\s+(?:IF\s+NOT\s+EXISTS\s+)?(?:[\w\"`]+\.)?([\w\"`]+)?", text[start:stop][len(piece) - len(piece.lstrip()) :], re.I):
            kind = dict(_SQL)[m[1].upper()]
            label = f"CREATE {m[1].upper()}" + (f" {m[2].strip(chr(34) + '`')}" if m[2] else "")
        elif m := re.match(r"\s*(?:WITH\b[\s\S]*?)?\b(SELECT|INSERT|UPDATE|DELETE)\b", piece, re.I):
            kind, label = "file", m[1].upper()
        if label and kind and row not in seen:
            seen.add(row)
            out.append(Section(kind, label, absorb(lines, row, "sql"), last, f"// {label}"))
        start = stop + 1
    return sorted(out, key=lambda s: s.first) or whole(lines)


def _rules(lines: list[str], line: tuple[str, ...]) -> list[tuple[str, int, int]]:
    """(selector or declaration, first row, last row) of outermost rules and statements."""
    text = "\n".join(lines)
    masked, depth, start, out = Lexis(line=line).mask(text), 0, 0, []
    for m in re.finditer(r"[{};]", masked):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth = max(0, depth - 1)
        if depth == 0 and m[0] in "};":
            piece = masked[start : m.start()]
            at = start + len(piece) - len(piece.lstrip())
            if head := " ".join(masked[at : m.start()].split("{")[0].split()):
                out.append((head, text.count("\n", 0, at), text.count("\n", 0, m.start())))
            start = m.end()
    return out


def css_sections(lines: list[str], max_chars: int) -> list[Section]:
    from .absorb import absorb

    found = [r for r in _rules(lines, ()) if not re.match(r"@(?:import|charset|namespace)\b", r[0])]
    return [Section("file", h, absorb(lines, a, "css"), b, f"/* Selector: {h} */") for h, a, b in found] if len(found) > FEW else whole(lines)


def scss_sections(lines: list[str], max_chars: int) -> list[Section]:
    from .absorb import absorb

    named, plain = [], []
    for head, a, b in _rules(lines, ("//",)):
        first = absorb(lines, a, "scss")
        if m := re.match(r"@(mixin|function|keyframes)\s+([\w-]+)", head):
            named.append(Section("function", m[2], first, b, f"/* {m[1].capitalize()}: {m[2]} */"))
        elif m := re.match(r"\$([\w-]+)\s*:", head):
            if len("\n".join(lines[a : b + 1])) >= 30:
                named.append(Section("const", "$" + m[1], first, b, f"/* Variable: ${m[1]} */"))
        elif m := re.match(r"@media\s+(.*)", head):
            named.append(Section("section", f"@media {m[1]}", first, b, f"/* Media: {m[1]} */"))
        elif not head.startswith("@"):
            plain.append(Section("section", head, first, b, f"/* Selector: {head} */"))
    return [*named, *(plain if len(plain) > FEW else ())] or whole(lines)


FORMATS = {"json": json_sections, "yaml": yaml_sections, "toml": toml_sections, "html": html_sections, "xml": xml_sections, "markdown": markdown_sections, "sql": sql_sections, "css": css_sections, "scss": scss_sections}
