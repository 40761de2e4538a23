"""Words of a text as numbers, and sets of word n-grams."""

from __future__ import annotations

import functools
import re

import numpy as np

#: A word: letters, digits and underscores, of the lower-case text.
WORD = re.compile(r"\w+")
#: Characters that are hashed at a time; a longer word is a piece of its own.
PIECE = 1 << 18
#: The base of a word's polynomial, modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


@functools.cache
def characters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point, whether words have it, and a number of 64 bits."""
    inside = np.fromiter((chr(k).isalnum() for k in range(0x110000)), bool, 0x110000)
    inside[ord("_")] = True
    return inside, mix(np.arange(1, 0x110001, dtype=np.uint64))


@functools.lru_cache(maxsize=4)
def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts, one after the other, and how many each text has.

    A word is a polynomial of its characters' numbers. One running sum over all characters
    gives those of all words: the sum up to a word's end less that to its start, over the power there.
    """
    lower = [(t or "").lower() for t in texts]
    points = np.frombuffer("\n".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside, number = characters()
    edge = np.flatnonzero(np.diff(inside[points], prepend=False, append=False))
    start, stop = edge[::2], edge[1::2]
    counts = np.diff(np.searchsorted(start, np.cumsum([len(t) + 1 for t in lower])), prepend=0)
    out, k = np.empty(len(start), np.uint64), 0
    while k < len(start):
        low = start[k]
        end = max(k + 1, int(np.searchsorted(stop, low + PIECE, "right")))
        a, b = start[k:end] - low, stop[k:end] - low
        n = int(b[-1])
        size = PIECE if n < PIECE else n + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(number[points[low : low + n]] * powers(BASE, size)[:n], out=sums[1:])
        out[k:end] = mix((sums[b] - sums[a]) * powers(INVERSE, size)[a])
        k = end
    return out, counts


def word_hashes(text: str | None) -> np.ndarray:
    """One 64-bit hash a word."""
    return words_of([text])[0]


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` words, in order; of all words if there are fewer; none of none."""
    n = min(n, len(words))
    if not n:
        return words
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k]
    return mix(out)
