"""Keyed permutations that keep a string's format.

Each character belongs to a class (digit, vowel or consonant of a script, with the case kept
apart); a string's pattern is its classes, and the strings of a pattern are numbered in mixed
radix.  ``Cycle`` runs through 0..N-1 as one keyed cycle: E(D(x) + 1) with E a Feistel cipher on the
range and D its inverse.  Going to the successor is a permutation, so different strings get different
surrogates, and it has no fixed point where N > 1.  Passing over forbidden strings keeps both.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from hashlib import blake2b

VOWELS = {
    "latin": "aeiou", "latin accented": "àáâãäåèéêëìíîïòóôõöøùúûüýÿāēīōūăąęėįőűů",
    "cyrillic": "аеёиоуыэюя", "cyrillic ukrainian": "іїє", "greek": "αεηιουωάέήίόύώ",
}
CONSONANTS = {
    "latin": "bcdfghjklmnpqrstvwxyz", "latin accented": "çñčćďđğģķļľłńņňřśšşťţźžżß",
    "cyrillic": "бвгджзйклмнпрстфхцчшщ", "greek": "βγδζθκλμνξπρστφχψ",
}
CLASSES: dict[str, str] = {"digit": "0123456789"} | {f"{k} vowel": v for k, v in VOWELS.items()} | {f"{k} consonant": v for k, v in CONSONANTS.items()}
OF_CHAR = {c: (name, i) for name, chars in CLASSES.items() for i, c in enumerate(chars)}
#: Scripts without case, by their blocks.
BLOCKS = {"han": (0x4E00, 0x9FFF), "hiragana": (0x3041, 0x3096), "katakana": (0x30A1, 0x30FA), "hangul": (0xAC00, 0xD7A3), "arabic": (0x0621, 0x064A), "hebrew": (0x05D0, 0x05EA), "devanagari": (0x0905, 0x0939), "thai": (0x0E01, 0x0E2E)}
ROUNDS = 6


class Cycle:
    """One keyed cycle through 0..n-1."""

    def __init__(self, key: bytes, name: str, n: int):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.key = blake2b(name.encode(), key=key[:64], digest_size=32).digest()

    def _f(self, r: int, x: int) -> int:
        size = max(1, (self.half + 7) // 8)
        out = b""
        while len(out) < size:
            out += blake2b(bytes([r]) + len(out).to_bytes(4) + x.to_bytes(size), key=self.key).digest()
        return int.from_bytes(out[:size]) & self.mask

    def _encrypt(self, x: int) -> int:
        while True:
            a, b = x >> self.half, x & self.mask
            for r in range(ROUNDS):
                a, b = b, a ^ self._f(r, b)
            if (x := a << self.half | b) < self.n:
                return x

    def _decrypt(self, x: int) -> int:
        while True:
            a, b = x >> self.half, x & self.mask
            for r in reversed(range(ROUNDS)):
                a, b = b ^ self._f(r, a), a
            if (x := a << self.half | b) < self.n:
                return x

    def after(self, x: int) -> int:
        return self._encrypt((self._decrypt(x) + 1) % self.n)


@lru_cache(1 << 14)
def cycle(key: bytes, name: str, n: int) -> Cycle:
    return Cycle(key, name, n)


def _class(c: str) -> tuple[str, int, int] | None:
    """(class, position, members) of a lower-case character, None of one that stays."""
    if (hit := OF_CHAR.get(c)) is not None:
        return hit[0], hit[1], len(CLASSES[hit[0]])
    for name, (low, high) in BLOCKS.items():
        if low <= ord(c) <= high:
            return name, ord(c) - low, high - low + 1
    return None


def _char(name: str, at: int) -> str:
    return CLASSES[name][at] if name in CLASSES else chr(BLOCKS[name][0] + at)


def permute(key: bytes, kind: str, text: str, alphabets: list[str | None] | None = None, allowed: Callable[[str], bool] = lambda _: True, tail: int = 0) -> str:
    """The surrogate of ``text`` among the strings of its pattern that are ``allowed``.

    ``alphabets`` gives the characters possible at each place, None where the character stays; by
    default every letter and digit but the last ``tail`` characters moves within its class.  Upper case letters come back in upper
    case.  ``text`` itself must be allowed, or the result is only a permutation of the others.
    """
    low = [c.lower() if len(c.lower()) == 1 else c for c in text]
    if alphabets is None:
        slots = [_class(c) if i < len(low) - tail else None for i, c in enumerate(low)]
        name = kind + "|" + "|".join(s[0] if s else "=" + c for s, c in zip(slots, low))
    else:
        slots = [(a, a.index(c), len(a)) if a and c in a else None for a, c in zip(alphabets, low)]
        name = kind + "|" + "|".join("#" + s[0] if s else "=" + c for s, c in zip(slots, low))
    n, x = 1, 0
    for s in slots:
        if s:
            x = x * s[2] + s[1]
            n *= s[2]
    if n == 1:
        return text
    ring, start = cycle(key, name, n), x
    while True:
        x = ring.after(x)
        rest, out = x, []
        for s, c, old in zip(reversed(slots), reversed(low), reversed(text)):
            if s:
                rest, at = divmod(rest, s[2])
                c = s[0][at] if alphabets is not None else _char(s[0], at)
                up = c.upper()
                out.append(up if old != old.lower() and len(up) == 1 else c)
            else:
                out.append(old)
        result = "".join(reversed(out))
        if x == start or allowed(result.lower()):
            return result
