"""SentencePiece (BPE type) encoding and decoding by a table over prefixes.

The encoding of a prefix has a unique last token; it is all that is stored for the prefix.  An
Aho-Corasick automaton reports the tokens that end at each place.  Token t, of length l, is the last
one at place i exactly when the last token p at place i - l and t are compatible: merging the text of p
and t gives p, t again.  That test follows the merges that made p and t back from the seam and
fails if a merge across the seam would have come first.  The ids are read off the table backwards.

A text is first cut where no token can reach across (before white space, around line feeds and
other characters without a token); equal pieces of text, mostly words, are encoded once for each task's
cache.  Characters without a token become their bytes' tokens, or the unknown token in a model
without these.  Ids equal those of the library for models with the identity normaliser, which is
checked when a model is loaded.

Null texts give null ids, empty ones no ids; null ids stay null, repeated rows are encoded each, other columns are left out, an empty
table gives an empty one.  A text's length isn't bounded: it is encoded piece by piece, a piece without a cut in time in proportion to
its length.  Decoding gives the text back, unless it holds the
white space mark itself (it comes back as a space) or the model has no byte tokens.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
#: Words in each of the cache's two generations.
CACHE = 250_000
SLICE_CHARS = 1 << 20


def _fields(data: bytes):
    """(number, value) of a protocol buffer message; fixed-size values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, data[at : at + n]
        at += n


class Words(dict):
    """Encoded words as packed ids.  A full generation becomes the old one, whose words come back when met again."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, word: str) -> bytes:
        packed = self.old.get(word)
        if packed is None:
            packed = np.array(self.encode(word), np.int32).tobytes()
        if len(word) < 64:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[word] = packed
        return packed


class Model:
    """A model's pieces, in merge order inside: characters first, then pieces by falling score."""

    def __init__(self, path: str):
        pieces, scores, kinds = [], [], []
        self.dummy, spec, norm = True, {}, {}
        with open(path, "rb") as f:
            for number, value in _fields(f.read()):
                if number == 1:
                    one = dict(_fields(value))
                    pieces.append(one.get(1, b"").decode())
                    scores.append(float(np.frombuffer(one.get(2, bytes(4)), "<f4")[0]))
                    kinds.append(one.get(3, NORMAL))
                elif number == 2:
                    spec = dict(_fields(value))
                elif number == 3:
                    norm = dict(_fields(value))
        if spec.get(3, 1) != 2:
            raise ValueError("not a BPE model")
        if norm.get(2) or norm.get(4, 1) or not norm.get(5, 1) or USER in kinds:
            raise ValueError("only the identity normaliser, without user-defined pieces")
        self.dummy = bool(norm.get(3, 1))
        self.pieces, self.kinds = pieces, kinds
        self.unknown = kinds.index(UNKNOWN)
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == BYTE}
        real = [i for i, k in enumerate(kinds) if k == NORMAL]
        # Rank of a piece: characters come before everything, then higher scores, then lower ids.
        order = sorted(real, key=lambda i: (len(pieces[i]) > 1, -scores[i] if len(pieces[i]) > 1 else 0, i))
        self.ids = order
        rank = {pieces[i]: r for r, i in enumerate(order)}
        self.base = sum(len(pieces[i]) == 1 for i in order)
        self.span = len(order) + 1
        self.length = [len(pieces[i]) for i in order]
        self.merged: dict[int, int] = {}
        for p, r in rank.items():
            for k in range(1, len(p)):
                a, b = rank.get(p[:k]), rank.get(p[k:])
                if a is not None and b is not None:
                    self.merged[a * self.span + b] = r
        self.left, self.right = list(range(len(order))), list(range(len(order)))
        self.words = ahocorasick.Automaton()
        for p, r in rank.items():
            if len(p) > 1:
                made = self._merge([rank.get(c, -1) for c in p])
                if made is None or made[0] != r:
                    continue  # no order of merges ends in this piece
                self.left[r], self.right[r] = made[1], made[2]
            self.words.add_word(p, r)
        self.words.make_automaton()
        self.known = {p for p in rank if len(p) == 1}
        crossing = any(MARK in p.lstrip(MARK) for p in rank)
        line = not any("\n" in p for p in rank)
        mark = "" if crossing else MARK
        feed = "\n" if line else ""
        body = f"[^{mark}{feed}]" if mark or feed else "."
        self.cut = re.compile(f"{MARK}*{body}+|{MARK}+|\n" if not crossing else f"{body}+|\n", re.S)
        self.raw = [b""] * len(pieces)
        for i, (p, k) in enumerate(zip(pieces, kinds)):
            self.raw[i] = bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() if k in (NORMAL, UNUSED) else " ⁇ ".encode() if k == UNKNOWN else b""
        self.pairs: dict[int, bool] = {}
        self.cache: Words | None = None

    def __getstate__(self):
        return self.__dict__ | {"pairs": {}, "cache": None}

    def _merge(self, parts: list[int]) -> tuple[int, int, int] | None:
        """Plain merging of ranks; the result and its last merge, if one piece is left."""
        if -1 in parts:
            return None
        last = (parts[0], parts[0])
        while len(parts) > 1:
            best = min(((m, k) for k in range(len(parts) - 1) if (m := self.merged.get(parts[k] * self.span + parts[k + 1])) is not None), default=None)
            if best is None:
                return None
            m, k = best
            last = (parts[k], parts[k + 1])
            parts[k : k + 2] = [m]
        return parts[0], *last

    def compatible(self, a: int, b: int) -> bool:
        """Whether a and b side by side stay as they are."""
        merged, span, base = self.merged, self.span, self.base
        limit = span
        while True:
            m = merged.get(a * span + b)
            if m is not None and m < limit:
                return False
            # The later merge of the two sides is undone; what it made bounds the merges that may come first.
            if a > b and a >= base or b < base:
                if a < base:
                    return True
                limit, a = a, self.right[a]
            else:
                limit, b = b + 1, self.left[b]

    def encode_word(self, word: str) -> list[int]:
        """Ids of a piece of text that no token reaches out of."""
        n = len(word)
        last = [-2] * (n + 1)  # -2: nothing ends here, -1: a character without a token
        if not self.known.issuperset(word):
            for i, c in enumerate(word):
                if c not in self.known:
                    last[i + 1] = -1
        length, pairs, span = self.length, self.pairs, self.span
        for end, t in self.words.iter(word):
            end += 1
            if last[end] != -2:
                continue
            start = end - length[t]
            if start:
                p = last[start]
                if p == -2:
                    continue
                if p != -1:
                    key = p * span + t
                    ok = pairs.get(key)
                    if ok is None:
                        if len(pairs) > 2_000_000:
                            pairs.clear()
                        ok = pairs[key] = self.compatible(p, t)
                    if not ok:
                        continue
            last[end] = t
        out, i = [], n
        while i:
            t = last[i]
            if t == -1:
                i -= 1
                raw = word[i].encode("utf-8", "surrogatepass")
                out.extend([self.byte[b] for b in reversed(raw)] if self.byte else [self.unknown])
            else:
                out.append(self.ids[t])
                i -= length[t]
        out.reverse()
        return out

    def packed(self, text: str) -> bytes:
        """The text's ids as 32-bit integers side by side."""
        if not text:
            return b""
        if self.cache is None:
            self.cache = Words(self.encode_word)
        words = self.cut.findall((MARK if self.dummy else "") + text.replace(" ", MARK))
        return b"".join(map(self.cache.__getitem__, words))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy and text.startswith(" ") else text


def _flat(packed: list[bytes], nulls: list[bool]) -> pa.Array:
    offsets = np.zeros(len(packed) + 1, np.int32)
    np.cumsum([len(x) // 4 for x in packed], out=offsets[1:])
    flat = np.frombuffer(b"".join(packed), np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array(nulls) if any(nulls) else None)


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, ``ids``, ``tokens`` (their number) and ``exact`` (decoding gives the text)."""
    shared = docs.sparkSession.sparkContext.broadcast(Model(model_path))

    def run(batches):
        model = shared.value
        for batch in batches:
            values = batch.column(1).to_pylist()
            for a, b in slices([v or "" for v in values], SLICE_CHARS):
                part = values[a:b]
                ids = [model.packed(v or "") for v in part]
                exact = [None if v is None else model.decode(np.frombuffer(x, np.int32).tolist()) == v for v, x in zip(part, ids)]
                nulls = [v is None for v in part]
                yield pa.record_batch(
                    [batch.column(0).slice(a, b - a), _flat(ids, nulls), pa.array([None if z else len(x) // 4 for x, z in zip(ids, nulls)], pa.int32()), pa.array(exact, pa.bool_())],
                    [id_col, "ids", "tokens", "exact"],
                )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, ids array<int>, tokens int, exact boolean")


def decode_ids(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row for each row: id and ``text``; null ids give a null text, ids outside the model nothing."""
    shared = rows.sparkSession.sparkContext.broadcast(Model(model_path))

    def run(batches):
        model = shared.value
        n = len(model.pieces)
        for b in batches:
            values = [None if x is None else model.decode([i for i in x if i is not None and 0 <= i < n]) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(values, pa.string())], [id_col, "text"])

    return rows.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, text string")
