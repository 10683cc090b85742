"""Chat formatting proved by a grammar round trip.

A conversation is rendered as

    conversation := turn*
    turn         := "<|im_start|>" role "\\n" content "<|im_end|>" "\\n"

and parsed again by a deterministic parser that knows nothing of the source.  Where the recovered turns
differ from the source, the turns that don't survive alone are escaped and the text is rendered
and parsed again, until both are identical.  Content is escaped by a backslash after the "<" of every
"<|", "<\\|", "<\\\\|" and so on; the parser takes one backslash out of each such place, escaped or not, so a
text that has them by itself conflicts as well.  Roles also escape backslashes and line feeds.

Turns are ordered by turn, then role, then text; ties and repeated rows all stay.  Null texts and roles
are empty strings, a null turn comes first.  Rows with a null conversation id belong to no
conversation and are left out.  An empty text is a turn with empty content.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_MARK = re.compile(r"<\|im_(?:start|end)\|>")
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


class Unparsable(ValueError):
    pass


def escape(content: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", content)


def escape_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n").replace("<|", "<\\e|")


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "e": ""}.get(m[1], m[1]), role, flags=re.S)


def render(turns: list[tuple[str, str]], escaped: list[bool]) -> str:
    return "".join(f"{START}{escape_role(r) if e else r}\n{escape(c) if e else c}{END}\n" for (r, c), e in zip(turns, escaped))


def parse(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        if not text.startswith(START, at):
            raise Unparsable(f"no turn at {at}")
        at += len(START)
        line = text.find("\n", at)
        stop = _MARK.search(text, at)
        if line < 0 or not stop or stop.start() <= line or stop[0] != END:
            raise Unparsable(f"no role or end of turn from {at}")
        out.append((_unescape_role(text[at:line]), _UNESCAPE.sub(r"<\1|", text[line + 1 : stop.start()])))
        at = stop.end()
        if not text.startswith("\n", at):
            raise Unparsable(f"text after the turn at {at}")
        at += 1
    return out


def _survives(turns: list[tuple[str, str]], escaped: list[bool]) -> bool:
    try:
        return parse(render(turns, escaped)) == turns
    except Unparsable:
        return False


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, int, bool]:
    """The text, how many turns are escaped, and whether the round trip is exact (it always ends so)."""
    escaped = [False] * len(turns)
    ok = _survives(turns, escaped)
    if not ok:
        escaped = [not _survives([t], [False]) for t in turns]
        ok = _survives(turns, escaped)
    if not ok:
        escaped = [True] * len(turns)
        ok = _survives(turns, escaped)
    return render(turns, escaped), sum(escaped), ok


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation: id, ``chat``, ``turns``, ``escaped``, ``exact``."""
    # Values are carried beside their column names, so further columns can have any names.
    rows = turns.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.struct(F.col(turn_col).alias("t"), F.coalesce(role_col, F.lit("")).alias("r"), F.coalesce(text_col, F.lit("")).alias("c")).alias("s")
    )
    chats = rows.groupBy("id").agg(F.array_sort(F.collect_list("s")).alias("s")).select("id", F.col("s.r").alias("r"), F.col("s.c").alias("c"))

    def run(batches):
        for b in batches:
            done = [(len(r), *format_turns(list(zip(r, c)))) for r, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.record_batch(
                [b.column(0), pa.array([d[1] for d in done], pa.string()), pa.array([d[0] for d in done], pa.int32()), pa.array([d[2] for d in done], pa.int32()), pa.array([d[3] for d in done], pa.bool_())],
                [id_col, "chat", "turns", "escaped", "exact"],
            )

    return chats.mapInArrow(run, f"`{id_col}` {dict(turns.dtypes)[id_col]}, chat string, turns int, escaped int, exact boolean")
