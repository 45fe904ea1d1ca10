"""Words of many texts at once, as arrays of 64-bit hashes.

A word is a longest run of Unicode letters and digits of the lower-cased text. Texts are joined into
one code-point array; word boundaries and word hashes come from a few vector operations, so the cost
per character is that of array arithmetic and no Python object exists per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Characters handled at once; a longer text is handled alone and whole.
CHUNK = 1 << 20


@lru_cache(maxsize=1)
def word_table() -> np.ndarray:
    """For each code point, whether it belongs to a word."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        ones = np.ones(size, np.uint64)
        up, down = ones * _BASE, ones * _INVERSE
        up[0] = down[0] = 1
        tables = np.cumprod(up), np.cumprod(down)
        if size > 4 * CHUNK:
            return tables
        _powers = tables
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a hash over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of a list of texts: ``hashes``, ``starts`` and ``ends`` (in ``text``), ``offsets`` (first word of each text)."""

    def __init__(self, texts: list[str]):
        lowered = [t.lower() for t in texts]
        self.text = "\n".join(lowered)
        codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = np.zeros(len(codes) + 2, bool)
        inside[1:-1] = word_table()[codes]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[0::2], edges[1::2]
        up, down = _power_tables(len(codes) + 1)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes + np.uint64(1)) * up[: len(codes)], out=sums[1:])
        raw = (sums[self.ends] - sums[self.starts]) * down[self.starts]
        self.hashes = mix(raw + (self.ends - self.starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        firsts = np.cumsum([0, *(len(t) + 1 for t in lowered)])
        self.offsets = np.searchsorted(self.starts, firsts)

    def word(self, i: int) -> str:
        return self.text[self.starts[i] : self.ends[i]]

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def in_chunks(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows whose last value is a text, in lists of about ``CHUNK`` characters."""
    held, size = [], 0
    for row in rows:
        n = len(row[-1])
        if held and size + n > CHUNK:
            yield held
            held, size = [], 0
        held.append(row)
        size += n
    if held:
        yield held
