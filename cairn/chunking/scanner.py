"""A lexer-driven scanner: strings and comments are blanked, declarations found by patterns, their ends by structure."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field
from functools import cached_property


@dataclass(frozen=True)
class Lexis:
    """What isn't structure: comment marks and string delimiters."""

    line: tuple[str, ...] = ("//",)
    block: tuple[tuple[str, str], ...] = (("/*", "*/"),)
    strings: tuple[str, ...] = ('"', "'")
    char: bool = False  # ' encloses one character only
    long: tuple[tuple[str, str], ...] = ()  # delimiters of strings over several lines

    @cached_property
    def pattern(self) -> re.Pattern:
        parts = [f"{re.escape(a)}[\\s\\S]*?(?:{re.escape(b)}|\\Z)" for a, b in (*self.block, *self.long)]
        parts += [(r"(?:(?<=\s)|(?<![^\n]))" if m == "#" else "") + re.escape(m) + (r"(?!\[)" if m == "#" else "") + r"[^\n]*" for m in self.line]
        for q in self.strings:
            if q == "'" and self.char:
                parts.append(r"'(?:\\[^\n]{1,8}?|[^'\\\n])'")
            elif q == "`":
                parts.append(r"`(?:\\.|[^`\\])*`")
            else:
                parts.append(f"{q}(?:\\\\.|[^{q}\\\\\\n])*{q}")
        return re.compile("|".join(parts)) if parts else re.compile(r"(?!)")

    def mask(self, text: str) -> str:
        """The text with comments and the insides of strings blanked, every character in its place."""

        def blank(m: re.Match) -> str:
            s = m[0]
            inner = re.sub(r"[^\n]", " ", s)
            return s[0] + inner[1:-1] + s[-1] if len(s) > 1 and s[0] in self.strings and s[-1] == s[0] else inner

        return self.pattern.sub(blank, text)


@dataclass(frozen=True)
class Rule:
    """A kind of declaration: a pattern with the groups name and, as far as it has them, parent and body.

    place: "any", "top" (outside all blocks) or "member" (directly inside a container).
    end: "brace", "line", "stmt", "keyword" (up to its ``end``), "indent", "paren", "blank" (up to a blank line or the next top-level line).
    """

    pattern: str
    type: str
    place: str = "any"
    end: str | None = None
    least: int = 0
    member_type: str | None = None  # inside a container it is this instead
    name: str | None = None

    @cached_property
    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, re.M)


@dataclass(frozen=True)
class Spec:
    rules: tuple[Rule, ...]
    lexis: Lexis = Lexis()
    end: str = "brace"
    imports: str | None = None  # one import statement, with the group module
    raw_imports: bool = True  # imports are found in the source, not in the masked text
    containers: tuple[str, ...] = ("class", "interface", "struct", "enum", "trait", "record", "object", "protocol", "extension", "actor", "module", "library", "instance", "mixin")
    parent_label: str = "Class"
    mark: tuple[str, str] = ("//", "")
    calls: str | None = r"(?<![\w.$])(?:\w+(?:\.|->|::))*(?P<callee>[A-Za-z_]\w*)\s*\("
    heritage: tuple[tuple[str, str], ...] = ()  # (relation, pattern with the group names) on a container's head
    openers: str = ""  # keywords that an ``end`` closes
    closer: str = r"\bend\b"
    header: bool = False  # a container's first line belongs to its members' context


@dataclass
class Node:
    rule: Rule
    type: str
    name: str
    start: int  # rows from 0
    end: int
    at: int
    head: str
    parent: str | None = None
    stop: int = 0
    name_at: int = -1


KEYWORDS = frozenset("if for while switch catch return else do try elif elseif unless until case when match with synchronized using lock fixed sizeof typeof function func fn def new throw await async assert in not and or defined guard repeat foreach print echo yield del lambda super this self require include".split())
#: What a pattern without a keyword of its own may take for a name.
CONTROL = frozenset("if for while switch catch return else do try elif elseif unless until case when match with synchronized using lock sizeof typeof throw await foreach in not and or".split())
_CONTINUES = re.compile(r"\s*(?:[{.:,|&?=]|->|(?:where|extends|implements|throws|with|deriving|requires|permits)\b)")
_OPEN_END = re.compile(r"(?:[=,(|&+\\:\[{<]|=>|->|\b(?:extends|implements|with))\s*$")


class Source:
    def __init__(self, text: str, spec: Spec):
        self.text, self.spec = text, spec
        self.lines = text.split("\n")
        self.masked = spec.lexis.mask(text)
        self.starts = [0]
        for line in self.lines:
            self.starts.append(self.starts[-1] + len(line) + 1)
        self.events = [(m.start(), 1 if m[0] == "{" else -1) for m in re.finditer(r"[{}]", self.masked)]
        self.places = [e[0] for e in self.events]
        self.depths = [0]
        for _, d in self.events:
            self.depths.append(max(0, self.depths[-1] + d))

    def row(self, at: int) -> int:
        return min(bisect_right(self.starts, at) - 1, len(self.lines) - 1)

    def depth(self, at: int) -> int:
        return self.depths[bisect_right(self.places, at - 1)]

    # -- where a declaration ends, as a position of its last character

    def end_brace(self, at: int, bodies: bool = True) -> int:
        """From the declaration's last matched character on: its block, or its statement where it has none."""
        text, depth, i, n, seen = self.masked, 0, at, len(self.masked), False
        while i < n:
            c = text[i]
            if c in "([{":
                depth += 1
                seen |= c == "{" and depth == 1
            elif c in ")]}":
                depth -= 1
                if depth < 0:
                    return max(at, i - 1)
                if c == "}" and depth == 0 and bodies:
                    return i
            elif c == ";" and depth == 0:
                return i
            elif c == "\n" and depth == 0 and not _CONTINUES.match(text, i + 1) and not _OPEN_END.search(text, self.starts[self.row(i)], i):
                return i - 1
            i += 1
        return n - 1

    def end_keyword(self, at: int) -> int:
        depth, line = 0, self.starts[self.row(at) + 1]
        for m in re.finditer(rf"(?P<open>{self.spec.openers})|(?P<close>{self.spec.closer})", self.masked[at:], re.M):
            if not depth and at + m.start() >= line:
                break  # the declaration opens no block
            depth += 1 if m["open"] is not None else -1
            if depth == 0:
                return at + m.end() - 1
        return self.starts[self.row(at) + 1] - 2

    def end_indent(self, at: int) -> int:
        row = self.row(at)
        own = len(self.lines[row]) - len(self.lines[row].lstrip())
        last = row
        for r in range(row + 1, len(self.lines)):
            line = self.masked[self.starts[r] : self.starts[r] + len(self.lines[r])]
            if not line.strip():
                continue
            if len(line) - len(line.lstrip()) <= own and line.strip()[0] not in ")]}":
                break
            last = r
        return self.starts[last] + len(self.lines[last]) - 1

    def end_paren(self, at: int) -> int:
        depth = 0
        for m in re.finditer(r"[()\[\]{}]", self.masked[at:]):
            depth += 1 if m[0] in "([{" else -1
            if depth <= 0:
                return at + m.start()
        return len(self.masked) - 1

    def end_blank(self, at: int) -> int:
        """Lines that are indented further than the first belong to it; blank ones only between such."""
        return self.end_indent(at)

    def end_dot(self, at: int) -> int:
        m = re.compile(r"\.(?=\s|\Z)").search(self.masked, at)
        return m.start() if m else len(self.masked) - 1

    def end_statement(self, at: int) -> int:
        return self.end_brace(at, bodies=False)

    def end_line(self, at: int) -> int:
        return self.starts[self.row(at) + 1] - 2

    def finish(self, how: str, start: int, head_end: int) -> int:
        at = {"brace": head_end, "stmt": head_end}.get(how, start)
        ends = {"brace": self.end_brace, "stmt": self.end_statement, "keyword": self.end_keyword, "indent": self.end_indent, "paren": self.end_paren, "blank": self.end_blank, "dot": self.end_dot, "line": self.end_line}
        return max(start, ends[how](at))

    # -- declarations

    def nodes(self) -> list[Node]:
        """In the order of the rules, of each rule from top to bottom."""
        out: list[Node] = []
        boxes: list[Node] = []
        for rule in self.spec.rules:
            if rule.type in self.spec.containers:
                boxes += self._of(rule, [])
        boxes.sort(key=lambda b: (b.at, -b.stop))
        for rule in self.spec.rules:
            out += self._of(rule, boxes)
        return out

    def _of(self, rule: Rule, boxes: list[Node]) -> list[Node]:
        found = []
        for m in rule.regex.finditer(self.masked):
            name = rule.name or ""
            group = next((g for g in ("name", "name2") if g in m.re.groupindex and m[g] is not None), None)
            if group:  # strings are blanked: names come from the source
                name = self.text[m.start(group) : m.end(group)]
            if not rule.name and (not name.strip() or name in CONTROL):
                continue
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            # From the name on, so that the brackets of what follows are balanced.
            stop = self.finish(rule.end or self.spec.end, start, m.end(group) if group else m.end())
            inside = [b for b in boxes if b.at < start and b.stop >= stop]
            if rule.place == "top" and (self.depth(start) or any(b for b in inside if b.type not in ("module", "namespace", "class"))):
                continue
            if rule.place == "member" and not (inside and (self.spec.end != "brace" or self.depth(start) == self.depth(inside[-1].at) + 1)):
                continue
            first, last = self.row(start), self.row(stop)
            if rule.least and len("\n".join(self.lines[first : last + 1])) < rule.least:
                continue
            kind = rule.member_type if rule.member_type and inside else rule.type
            parent = m["parent"] if "parent" in m.re.groupindex and m["parent"] else (inside[0].name if inside and rule.type not in self.spec.containers else None)
            brace = self.masked.find("{", start, stop + 1) if self.spec.end == "brace" else -1
            head = self.text[start : brace if brace > 0 else self.starts[first + 1]]
            found.append(Node(rule, kind, name, first, last, start, head, parent, stop, m.start(group) if group else -1))
        return found
