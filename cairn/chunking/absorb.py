"""Leading comments and decorators belong to what they precede."""

from __future__ import annotations

import re
from functools import lru_cache

_SLASHES, _HASH = ("//",), ("#",)
_STARS, _DOC = (("/*", "*/"),), (("/**", "*/"),)
_AT = r"@\w"

#: By language: line prefixes, block pairs, patterns.
PRESETS: dict[str, tuple[tuple[str, ...], tuple[tuple[str, str], ...], str | None]] = {
    **dict.fromkeys(("javascript", "typescript"), (_SLASHES, _STARS, _AT)),
    **dict.fromkeys(("c", "cpp", "go", "objc", "scss", "solidity"), (_SLASHES, _STARS, None)),
    **dict.fromkeys(("dart", "groovy", "kotlin", "scala", "swift"), (_SLASHES, _DOC, _AT)),
    **dict.fromkeys(("bash", "r", "ruby"), (_HASH, (), None)),
    "clojure": ((";",), (), None),
    "csharp": (_SLASHES, _STARS, r"\[[A-Za-z_]"),
    "css": ((), _STARS, None),
    "elixir": (_HASH, (), r"@(?:callback|doc|moduledoc|opaque|spec|type|typedoc|typep)\b"),
    "erlang": (("%",), (), r"-(?:callback|doc|opaque|spec|type|typedoc)\b"),
    "haskell": (("--",), (("{-", "-}"),), None),
    "java": (_SLASHES, _DOC, r"@[A-Z]\w*"),
    "julia": (_HASH, (("#=", "=#"),), _AT),
    "lua": (("--",), (("--[[", "]]"),), None),
    "matlab": (("%",), (("%{", "%}"),), None),
    "ocaml": ((), (("(*", "*)"),), None),
    "perl": (_HASH, (("=", "=cut"),), None),
    "php": (("//", "#"), _DOC, r"#\[\w|@\w"),
    "powershell": (_HASH, (("<#", "#>"),), None),
    "python": (_HASH, (), _AT),
    "rust": (_SLASHES, _STARS, r"#!?\["),
    "sql": (("--",), _STARS, None),
    "zig": (_SLASHES, (), None),
}
FARTHEST = 80


@lru_cache
def _pattern(language: str) -> re.Pattern | None:
    _, _, p = PRESETS[language]
    return re.compile(p) if p else None


def absorb(lines: list[str], row: int, language: str) -> int:
    """The row where the leading comments of ``row`` begin: at most 80 lines up, over one blank line once something was found."""
    if language not in PRESETS:
        return row
    prefixes, blocks, _ = PRESETS[language]
    pattern = _pattern(language)
    floor, at, low, skipped = max(0, row - FARTHEST), row - 1, row, False
    while at >= floor:
        line = lines[at].strip()
        if not line:
            if skipped or low == row:
                break
            skipped, at = True, at - 1
            continue
        top = next((r for a, b in blocks if line.endswith(b) for r in range(at, floor - 1, -1) if lines[r].strip().startswith(a)), None)
        if top is None and (line.startswith(prefixes) or pattern is not None and pattern.match(line)):
            top = at
        if top is None:
            break
        low, at, skipped = top, top - 1, False
    return low
