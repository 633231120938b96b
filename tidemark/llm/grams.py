"""Words, lines and word windows of many texts at once, as arrays of 64-bit hashes."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Words in a shingle or window.
SHINGLE = 5
#: Odd multipliers of the hashes.
BASE, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
UPPER, LETTER, ALNUM, SPACE = 1, 2, 4, 8
_CHUNK = 1_000_000


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: flags of character classes, and the random value that stands for it in hashes."""
    n = sys.maxunicode + 1
    flags = np.zeros(n, np.uint8)
    for i in range(0x30000):
        c = chr(i)
        if c.isalnum():
            flags[i] = ALNUM | (LETTER if c.isalpha() else 0) | (UPPER if c.isupper() else 0)
        elif c.isspace():
            flags[i] = SPACE
    with np.errstate(over="ignore"):
        return flags, mixed(np.arange(1, n + 1, dtype=np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: list[str], most: int = 4096, characters: int = 0) -> Iterator[tuple[int, list[str]]]:
    """(first index, texts) in pieces of some `characters` (_CHUNK); a longer text is a piece of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and (size + len(t) > (characters or _CHUNK) or i - start >= most):
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t) + 1
    if texts:
        yield start, texts[start:]


class Texts:
    """The characters of some texts, one after another, each text ended by a newline."""

    def __init__(self, texts: list[str]):
        self.n = len(texts)
        joined = "".join(t + "\n" for t in texts)
        self.codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, self.n)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.flags = _tables()[0][self.codes]

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each span, none empty; equal spans have equal hashes wherever they stand.

        Each character is mixed with its place in the span and the results are summed. (A polynomial in
        the place, modulo a power of two, gives long texts of a regular kind equal hashes.)
        """
        out = np.zeros(len(starts), np.uint64)
        sizes = ends - starts
        upto = np.cumsum(sizes)
        first = 0
        while first < len(starts):
            # Pieces of some _CHUNK characters; a longer span is a piece of its own.
            last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + _CHUNK, "right")))
            n = sizes[first:last]
            heads = np.cumsum(n) - n
            place = np.arange(int(n.sum())) - np.repeat(heads, n)
            with np.errstate(over="ignore"):
                x = _tables()[1][self.codes[np.repeat(starts[first:last], n) + place]] + place.astype(np.uint64) * STEP
                x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                x ^= x >> np.uint64(32)
                out[first:last] = mixed(np.add.reduceat(x, heads) + n.astype(np.uint64))
            first = last
        return out

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of True."""
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs without white space, less signs on both sides; runs of signs stay whole."""
        starts, ends = self.spans((self.flags & SPACE) == 0)
        plain = np.append(np.flatnonzero(self.flags & ALNUM), len(self.flags))
        first, behind = np.searchsorted(plain, starts), np.searchsorted(plain, ends)
        has = behind > first
        return np.where(has, plain[first], starts), np.where(has, plain[behind - 1] + 1, ends)

    def text_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, positions, "right")

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """How many True each text has."""
        return np.add.reduceat(mask.astype(np.int64), self.starts) if self.n else np.zeros(0, np.int64)


def windows(words: np.ndarray, text: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words within a text, and the index of each run's first word."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for i in range(size):
            h = h * STEP + words[i : i + n]
        first = np.flatnonzero(text[:n] == text[size - 1 :])
        return mixed(h[first]), first


class Lowered(Texts):
    """Texts with A-Z in lower case; words are the runs of characters other than `gaps`."""

    def __init__(self, texts: list[str], gaps: str):
        super().__init__(texts)
        self.codes = np.where((self.codes >= 65) & (self.codes <= 90), self.codes + np.uint32(32), self.codes)
        self.gap = np.zeros(len(self.codes), bool)
        for low, high in gap_ranges(gaps):
            self.gap |= (self.codes >= low) & (self.codes <= high)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return self.spans(~self.gap)

    def strings(self, starts: np.ndarray, ends: np.ndarray) -> list[str]:
        whole = self.codes.tobytes().decode("utf-32-le", "surrogatepass")  # a character for each code
        return [whole[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


@lru_cache(maxsize=8)
def gap_ranges(gaps: str) -> list[tuple[int, int]]:
    """The code points of `gaps` as ranges."""
    found: list[list[int]] = []
    for c in sorted(map(ord, gaps)):
        if found and found[-1][1] == c - 1:
            found[-1][1] = c
        else:
            found.append([c, c])
    return [(a, b) for a, b in found]
