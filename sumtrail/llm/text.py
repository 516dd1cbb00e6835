"""Words of texts as NumPy arrays, for use inside tasks.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab,
form feed and carriage return. All of these are ASCII, so words can be found in
UTF-8 bytes without decoding.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator, Sequence
from contextlib import suppress
from functools import lru_cache
from hashlib import blake2b

import numpy as np

U64 = np.uint64
# Texts are taken together until they have this many bytes, so that memory in a
# task depends on this and on the longest text, not on the number of rows.
CHUNK_BYTES = 1 << 20
# Longer words are hashed by BLAKE2 instead of a polynomial.
LONG_WORD = 512
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit integers (the finalizer of SplitMix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


@lru_cache(maxsize=2)
def _byte_values(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))
    if lower:
        values[65:91] = values[97:123]
    return values


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_NOT_ALNUM = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def release() -> None:
    """Give back memory that is free; a worker that waits for its next task would keep it."""
    with suppress(OSError, AttributeError):  # only the GNU C library has this
        ctypes.CDLL(None).malloc_trim(0)


def chunks(texts: Iterable[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """The UTF-8 bytes of consecutive texts (None as empty), and the index of the first."""
    first, size, out = 0, 0, []
    for i, text in enumerate(texts):
        data = text.encode() if isinstance(text, str) else b""
        if out and size + len(data) > limit:
            yield first, out
            first, size, out = i, 0, []
        out.append(data)
        size += len(data) + 1
    if out:
        yield first, out


class Words:
    """The words of some texts.

    ``start`` and ``end`` are byte positions in ``data``, ``hash`` is a 64-bit hash of
    each word, and the words of text ``i`` are ``first[i]`` to ``first[i + 1]``.
    """

    def __init__(self, texts: Sequence[bytes], lower: bool, alnum: bool = False) -> None:
        """With ``alnum`` any ASCII character but a letter or digit separates words."""
        self.data = b" ".join(texts)
        raw = np.frombuffer(self.data, dtype=np.uint8)
        space = np.ones(len(raw) + 2, dtype=bool)
        space[1:-1] = (_NOT_ALNUM if alnum else _SPACE)[raw]
        change = np.flatnonzero(space[1:] != space[:-1])
        self.start, self.end = change[0::2], change[1::2]
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        begins = np.concatenate(([0], np.cumsum(lengths)))
        self.first = np.searchsorted(self.start, begins)
        self.hash = self._hashes(raw, lower)

    def _hashes(self, raw: np.ndarray, lower: bool) -> np.ndarray:
        out = np.empty(len(self.start), dtype=U64)
        values = _byte_values(lower)
        power = _powers(_BASE, CHUNK_BYTES + LONG_WORD + 1)
        inverse = _powers(pow(_BASE, -1, 1 << 64), CHUNK_BYTES + LONG_WORD + 1)
        i = 0
        while i < len(out):
            origin = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, origin + CHUNK_BYTES, side="right")))
            s, e = self.start[i:j] - origin, self.end[i:j] - origin
            if e[-1] <= CHUNK_BYTES:
                prefix = np.zeros(int(e[-1]) + 1, dtype=U64)
                np.cumsum(values[raw[origin : origin + e[-1]]] * power[: e[-1]], out=prefix[1:])
                out[i:j] = mix((prefix[e] - prefix[s]) * inverse[s] + (e - s).astype(U64))
            i = j
        for k in np.flatnonzero(self.end - self.start > LONG_WORD):
            word = self.data[self.start[k] : self.end[k]]
            word = word.lower() if lower else word  # bytes.lower() changes A-Z only
            out[k] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return out

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Position and Rabin-Karp hash of every ``size`` consecutive words of one text."""
        return windows(self.hash, self.first, size)


def windows(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=U64)
    total = np.zeros(n, dtype=U64)
    for k in range(size):  # Horner's rule, all windows at once
        total *= U64(_BASE)
        total += words[k : k + n]
    inside = np.ones(n, dtype=bool)
    for back in range(1, size):  # windows that run past the end of their text
        at = first[1:-1] - back
        inside[at[(at >= 0) & (at < n)]] = False
    position = np.flatnonzero(inside)
    # A text with fewer words than the window has no window, even if others surround it.
    return position, mix(total[position])


def text_of(position: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The text that each word position belongs to."""
    return np.searchsorted(first, position, side="right") - 1
