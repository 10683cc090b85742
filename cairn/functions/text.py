"""Text: identifier expansion, tokens, query parsing, splitting and truncation.

Everything that runs per row is a built-in expression, so it stays in the JVM; the functions on Python
strings serve the driver and the extractors and agree with the expressions.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_IDENTIFIER = re.compile(r"[A-Za-z][A-Za-z0-9_]*[A-Za-z0-9]")
_HUMP, _ACRONYM = re.compile(r"([a-z])([A-Z])"), re.compile(r"([A-Z]+)([A-Z][a-z])")
#: Where a word may end within an identifier.
_MARK = re.compile(r"[A-Z_](?:(?<=_)|(?<=[a-z][A-Z])|(?<=[A-Z]{2})(?=[a-z]))")
_WORD_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")
ELLIPSIS = "/* … */"
WORD = r"([\p{L}\p{N}]+)"


def identifier_parts(token: str) -> list[str]:
    """The distinct lower-case words of an identifier."""
    spaced = _ACRONYM.sub(r"\1 \2", _HUMP.sub(r"\1 \2", token.replace("_", " ")))
    return [p for p in dict.fromkeys(spaced.lower().split(" ")) if p]


def expand_identifiers_text(text: str) -> str:
    """Every compound identifier followed by its words: ``getUserById get user by id``.

    Only identifiers in which a word can end are looked at; prose has few.
    """
    out, done = [], 0
    while mark := _MARK.search(text, done):
        a = mark.start()
        while a > done and text[a - 1] in _WORD_CHARS:
            a -= 1
        m = _IDENTIFIER.search(text, a)
        if not m:
            break
        parts = identifier_parts(m[0])
        out.append(text[done : m.end()] if len(parts) < 2 else " ".join((text[done : m.end()], *parts)))
        done = m.end()
    return "".join((*out, text[done:])) if out else text


def identifier_terms(text: Column | str) -> Column:
    """Array of the identifiers in a text, each followed by its words if it has several."""

    def parts(t: Column) -> Column:
        humps = F.regexp_replace(F.regexp_replace(t, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
        return F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace(humps, "_", " ")), " "), lambda x: x != ""))

    def spread(t: Column) -> Column:
        p = parts(t)
        return F.when(F.size(p) < 2, F.array(t)).otherwise(F.concat(F.array(t), p))

    return F.flatten(F.transform(F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit("([A-Za-z][A-Za-z0-9_]*[A-Za-z0-9])"), F.lit(1)), spread))


def search_content(content: Column, name: Column) -> Column:
    """What is indexed for full-text search: content and name, then the words of their identifiers.

    The bag of words is that of an in-place expansion; only adjacency of the added words differs.
    """
    whole = F.concat_ws(" ", content, F.coalesce(name, F.lit("")))
    words = F.filter(identifier_terms(whole), lambda t: t == F.lower(t))
    return F.concat_ws(" ", whole, F.array_join(words, " "))


def tokens(text: Column | str) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(F.col(text) if isinstance(text, str) else text), F.lit(WORD), F.lit(1))


def query_phrases(query: str) -> list[tuple[str, ...]]:
    """What a query looks for: one phrase for each white-space separated part, joined by OR; quotes, ``*`` and ``:`` don't count."""
    out = []
    for part in query.split():
        words = tuple(re.findall(r"[^\W_]+", re.sub(r'["*:]', "", part).lower()))
        if words and words not in out:
            out.append(words)
    return out


def like_literal(text: str) -> str:
    """A pattern for LIKE that matches the text itself anywhere."""
    return "%" + re.sub(r"([\\%_])", r"\\\1", text) + "%"


def glob_regex(pattern: str) -> str:
    """A path filter: ``*`` stands for any run of characters, slashes included; all else for itself."""
    return "^" + ".*".join(re.escape(p) for p in pattern.split("*")) + "$"


def truncate_middle(text: Column | str, limit: int) -> Column:
    """At most ``limit`` characters: 60 % from the start, the rest from the end, a mark between."""
    c = F.col(text) if isinstance(text, str) else text
    room = limit - len(ELLIPSIS)
    head = math.ceil(room * 0.6)
    tail = room - head
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, head), F.lit(ELLIPSIS), F.substring(c, F.length(c) - (tail - 1), F.lit(tail))))


def truncate_text(text: str, limit: int, share: float = 0.6) -> str:
    if len(text) <= limit:
        return text
    room = limit - len(ELLIPSIS)
    head = math.ceil(room * share)
    return text[:head] + ELLIPSIS + text[len(text) - (room - head) :]


def head_and_tail(text: str, head: int = 1024, tail: int = 900, mark: str = "\n...\n") -> str:
    """What rerankers with a short window are given of a long text."""
    return text if len(text) <= head + tail else text[:head] + mark + text[-tail:]


def split_fixed(text: Column | str, width: int) -> Column:
    """Pieces of ``width`` characters; an empty text is one empty piece."""
    c = F.col(text) if isinstance(text, str) else text
    last = F.greatest(F.ceil(F.length(c) / width).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(c, i * width + 1, F.lit(width)))


def pieces(text: str, width: int) -> list[str]:
    return [text[i : i + width] for i in range(0, len(text), width)] or [text]


def snippet(text: Column | str, width: int = 200) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.concat(F.trim(F.substring(c, 1, width)), F.when(F.length(c) > width, F.lit("...")).otherwise(F.lit("")))


def location(file_path: Column | str, start: Column | str, end: Column | str) -> Column:
    return F.format_string("%s:%d-%d", file_path, start, end)


def capitalise(text: Column | str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, (1 << 31) - 1))
