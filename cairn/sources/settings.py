"""Settings and path aliases, read on the driver."""

from __future__ import annotations

import json
import os
import re
import tomllib
from typing import Any

NAMES = ("cairn.toml", "cairn.json")


def find_settings(folder: str) -> dict[str, Any]:
    """The settings file nearest to ``folder`` on the way up; empty without one."""
    folder = os.path.abspath(folder)
    while True:
        for name in NAMES:
            path = os.path.join(folder, name)
            if os.path.isfile(path):
                with open(path, "rb") as f:
                    return tomllib.load(f) if name.endswith("toml") else json.load(f)
        if (up := os.path.dirname(folder)) == folder:
            return {}
        folder = up


_STRING = r'"(?:\\.|[^"\\])*"'
_COMMENT = re.compile(_STRING + r"|//[^\n]*|/\*.*?(?:\*/|\Z)", re.S)
_TRAILING = re.compile(_STRING + r"|,(?=\s*[\]}])", re.S)


def strip_comments(text: str) -> str:
    """JSON without comments and trailing commas; what looks like one inside a string stays."""
    keep = lambda m: m[0] if m[0][0] == '"' else ""
    return _TRAILING.sub(keep, _COMMENT.sub(keep, text))


def path_aliases(root: str, name: str = "tsconfig.json") -> list[tuple[str, list[str]]]:
    """(pattern, targets) from a TypeScript project file and those it extends, targets relative to ``root``; the nearest file's pattern wins."""
    found: dict[str, list[str]] = {}

    def read(path: str, seen: set[str]) -> None:
        if path in seen or not os.path.isfile(path):
            return
        seen.add(path)
        with open(path, encoding="utf-8") as f:
            try:
                data = json.loads(strip_comments(f.read()))
            except json.JSONDecodeError:
                return
        options = data.get("compilerOptions") or {}
        base = os.path.join(os.path.dirname(path), options.get("baseUrl") or ".")
        for pattern, targets in (options.get("paths") or {}).items():
            found.setdefault(pattern, [os.path.relpath(os.path.join(base, t), root).replace(os.sep, "/") for t in targets])
        above = data.get("extends") or []
        for other in [above] if isinstance(above, str) else above:
            if other.startswith("."):
                other = os.path.normpath(os.path.join(os.path.dirname(path), other))
                read(other if other.endswith(".json") else other + ".json", seen)

    read(os.path.join(os.path.abspath(root), name), set())
    return list(found.items())
