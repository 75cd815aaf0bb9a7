"""Vectorised words, word hashes and hashes of word sequences over batches of texts.

A word is ``[^\\x20\\x09-\\x0D]+``. Texts are handled as UTF-8 bytes: the separators are ASCII, so
splitting bytes and splitting characters give the same words, and lower-casing A-Z touches no other byte.
Hashes are polynomial over bytes (or over word hashes) modulo 2^64 with a final mix.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .common import _offsets

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            for name, b in (("up", self.base), ("down", self.inverse)):
                a = np.full(size, b, np.uint64)
                a[0] = 1
                setattr(self, name, np.cumprod(a, dtype=np.uint64))
        return self.up, self.down


_POWERS = tuple(_Powers(b) for b in BASES)


@dataclass
class Words:
    """Words of a run of texts: byte ranges in ``data``, and the first word of each text (with the total at the end)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


_SEPARATOR = re.compile(rb"[\x20\x09-\x0D]")
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def parts(text: bytes, size: int, overlap: int):
    """(part, words at its end that are the next one's too) of a long text: about ``size`` bytes that end with a word, and
    the ``overlap`` words after them, so that each run of overlap + 1 words lies whole in the part of its first word."""
    text, at = text.rstrip(), 0
    if not text:
        yield text, 0
    while at < len(text):
        found = _SEPARATOR.search(text, at + size)
        cut = found.start() if found else len(text)
        end, more = cut, 0
        for m in _WORD.finditer(text, cut):
            if more == overlap:
                break
            end, more = m.end(), more + 1
        yield text[at:end], more
        at = cut


def split(texts: pa.Array, lower: bool, separators: np.ndarray = _SPACE) -> Words:
    """The words of every text: maximal runs of bytes that ``separators`` (256 booleans, ASCII only) doesn't mark."""
    offsets = _offsets(texts).astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if lower:
        data = _LOWER[data]
    inside = ~separators[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[n - 1 :] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def word_hashes(w: Words, which: int = 0) -> np.ndarray:
    """A 64-bit hash of every word."""
    up, down = _POWERS[which].get(len(w.data) + 1)
    total = np.zeros(len(w.data) + 1, np.uint64)
    np.cumsum(_BYTES[w.data] * up[: len(w.data)], dtype=np.uint64, out=total[1:])
    return mix((total[w.ends] - total[w.starts]) * down[w.starts] + (w.ends - w.starts).astype(np.uint64) * U(0x9E3779B97F4A7C15))


def sequence_hashes(h: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of every ``k`` consecutive values of ``h`` (n - k + 1 of them, none if there are fewer)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _POWERS[which].get(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], dtype=np.uint64, out=total[1:])
    return mix((total[k:] - total[:n]) * down[:n])
