"""Vectorised work on many texts at once: code points, classes and hashes of pieces."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Code point put between two texts; it is no character.
END = 0x110000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def groups(texts: list[str | None], size: int) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts): slices with about ``size`` characters; null is the empty text."""
    held, n, start = [], 0, 0
    for k, t in enumerate(texts):
        t = t or ""
        held.append(t)
        n += len(t) + 1
        if n >= size:
            yield start, held
            held, n, start = [], 0, k + 1
    if held:
        yield start, held


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of the texts, each followed by ``END``, and each text's start."""
    points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4").copy()
    length = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    start = np.cumsum(length) - length
    points[start + length - 1] = END
    return points, start


class Hasher:
    """Hashes of pieces of an array of code points: equal pieces have equal hashes anywhere."""

    def __init__(self, points: np.ndarray):
        size = 1 << max(20, int(len(points)).bit_length())
        self.up, self.down = _powers(size)
        self.total = np.empty(len(points) + 1, np.uint64)
        self.total[0] = 0
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * self.up[: len(points)], out=self.total[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.total[end] - self.total[start]) * self.down[start]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


@lru_cache(maxsize=1)
def word_table() -> np.ndarray:
    """For each code point: 0 if it is no letter or digit, else the one its case variants share."""
    out = np.zeros(END + 1, np.uint32)
    for c in range(END):
        ch = chr(c)
        if ch.isalnum():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    out[ord("ς")] = ord("σ")
    return out


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """For each code point: 0 other, 1 letter, 2 number, 3 white space, 4 ``END``."""
    import regex

    out = np.zeros(END + 1, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, END)]))
    for k, pattern in ((1, r"\p{L}"), (2, r"\p{N}"), (3, r"\p{White_Space}")):
        out[[ord(c) for c in regex.findall(pattern, every)]] = k
    out[END] = 4
    return out
