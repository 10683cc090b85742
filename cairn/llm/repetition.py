"""Quality rules: how much of a text lies inside repeated n-grams and lines.

Words are runs without ASCII white space, lines are what lies between line feeds, trimmed of
ASCII white space, empty ones left out.  For each n of 5 to 10 a word is covered when it lies in
an n-gram that occurred earlier in the text; the figure is the covered words' share of the
characters of all words.  For each n of 2 to 4 the figure is the largest share that one n-gram
occurring at least three times takes (its count times its characters).  Lines give the share of lines,
and of their characters, that repeat an earlier line.  A text is rejected when any figure is
above its limit.  The limits are such that a short text framed by the same line at both ends is
kept, while one that says most of its content again and again is not.

Every figure is 0 for texts that are null, empty or too short to have the n-gram; such texts are
kept.  Rows are judged one by one, so repeated rows get repeated results; null ids stay null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import rolling as R
from .common import map_arrow, slices, texts

TOP = {2: 0.25, 3: 0.25, 4: 0.25}
COVERED = dict.fromkeys(range(5, 11), 0.5)
LINES, LINE_CHARS = 0.45, 0.45
#: An n-gram found twice is an ordinary header or quotation; coverage measures those.
TOP_TIMES = 3
FIGURES = [*(f"top_{n}" for n in TOP), *(f"dup_{n}" for n in COVERED), "dup_lines", "dup_line_chars"]
LIMITS = np.array([*TOP.values(), *COVERED.values(), LINES, LINE_CHARS])
SLICE_CHARS = 1 << 20


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all keys that occur more than once, in groups, in order; where groups begin."""
    s = np.sort(keys)
    again = s[1:][s[1:] == s[:-1]]
    if not len(again):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    again = again[np.concatenate(([True], again[1:] != again[:-1]))]
    at = np.minimum(np.searchsorted(again, keys), len(again) - 1)
    where = np.flatnonzero(again[at] == keys)
    order = np.argsort(at[where], kind="stable")
    where, group = where[order], at[where][order]
    return where, np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))


def _spread(size: int, at: np.ndarray, n: int) -> np.ndarray:
    """Which of ``size`` words lie in the ``n`` from any of the positions ``at``."""
    step = np.zeros(size + 1, np.int32)
    np.add.at(step, at, 1)
    np.add.at(step, at + n, -1)
    return np.cumsum(step[:-1]) > 0


def figures(values: list[str]) -> np.ndarray:
    """One row of FIGURES for each text."""
    out = np.zeros((len(values), len(FIGURES)))
    if not values:
        return out
    parts = [R.codes(v + "\n") for v in values]
    bounds = np.cumsum([0, *map(len, parts)])
    c = np.concatenate(parts)
    space = R.is_space(c)
    starts, ends = R.spans(~space)
    if not len(starts):
        return out
    doc = np.searchsorted(bounds, starts, side="right") - 1
    last = np.searchsorted(doc, doc, side="right")  # where each word's text ends
    size = (ends - starts).astype(np.float64)
    chars = np.bincount(doc, size, len(values))
    total = np.maximum(chars, 1)
    words = R.span_hashes(c, starts, ends)
    so_far = np.concatenate(([0], np.cumsum(size)))
    of_doc = R.mix(np.arange(len(values)), 99)
    for k, n in enumerate([*TOP, *COVERED]):
        grams = R.gram_hashes(words, n)
        begin = np.flatnonzero(np.arange(len(grams)) + n <= last[: len(grams)])
        if not len(begin):
            continue
        where, groups = _repeats(grams[begin] ^ of_doc[doc[begin]])
        if not len(where):
            continue
        at = begin[where]
        if n in TOP:
            count = np.diff(np.append(groups, len(at)))
            groups, count = groups[count >= TOP_TIMES], count[count >= TOP_TIMES]
            first = at[groups]
            np.maximum.at(out[:, k], doc[first], count * (so_far[first + n] - so_far[first]))
        else:
            later = np.ones(len(at), bool)
            later[groups] = False
            inside = _spread(len(words), at[later], n)
            out[:, k] = np.bincount(doc[inside], size[inside], len(values))
        out[:, k] /= total
    # A line's words lie between two line feeds: its trimmed text runs from its first word to its last.
    line = np.searchsorted(np.flatnonzero(c == 10), starts)
    head = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    tail = np.append(head[1:], len(starts)) - 1
    width = (ends[tail] - starts[head]).astype(np.float64)
    owner = doc[head]
    where, groups = _repeats(R.span_hashes(c, starts[head], ends[tail]) ^ of_doc[owner])
    later = np.ones(len(where), bool)
    later[groups] = False
    where = where[later]
    for k, weight in ((-2, np.ones(len(head))), (-1, width)):
        out[:, k] = np.bincount(owner[where], weight[where], len(values)) / np.maximum(np.bincount(owner, weight, len(values)), 1)
    return out


def _all_figures(values: list[str]) -> np.ndarray:
    return np.concatenate([figures(values[a:b]) for a, b in slices(values, SLICE_CHARS)])


def repetition_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its id, every figure rounded to 6 places, and ``rejected``."""
    kind = dict(docs.dtypes)[id_col]

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        f = _all_figures(texts(batch.column(1)))
        rejected = (f > LIMITS).any(axis=1)
        return pa.record_batch([batch.column(0), *(pa.array(np.round(f[:, i], 6)) for i in range(len(FIGURES))), pa.array(rejected)], [id_col, *FIGURES, "rejected"])

    return map_arrow(docs.select(id_col, text_col), judge, f"`{id_col}` {kind}, " + ", ".join(f"{x} double" for x in FIGURES) + ", rejected boolean")


def drop_repetitive(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that the rules don't reject; one scan, no shuffle."""

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        f = _all_figures(texts(batch.column(text_col)))
        return batch.filter(pa.array(~(f > LIMITS).any(axis=1)))

    return docs.mapInArrow(lambda it: (keep(b) for b in it if b.num_rows), docs.schema)
