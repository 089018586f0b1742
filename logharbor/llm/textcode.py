"""Whole batches of texts as arrays: words, lines and their hashes, without a loop per word.

Texts are joined into one byte array.  A word's hash is a polynomial over random 64-bit
values of its bytes, taken from prefix sums, and then mixed; equal words have equal hashes
in every batch and on every machine.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True

_powers: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of 64-bit hashes, in place where it can."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def _values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U(_BASE))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64, remembered by the worker."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        size = 1 << max(10, (n - 1).bit_length())
        held = np.ones(size, dtype=U)
        held[1:] = U(base)
        np.multiply.accumulate(held, out=held)
        _powers[base] = held
    return held[:n]


class Texts:
    """A batch of texts: bytes, words (start, end, text number, hash)."""

    def __init__(self, texts: list[str]):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.n = len(raw)
        # a closing space keeps words of neighbouring texts apart
        self.bytes = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
        lengths = np.array([len(r) for r in raw], dtype=np.int64)
        self.lengths = lengths
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) if raw else lengths
        space = _SPACE[self.bytes]
        edge = np.diff(space.astype(np.int8))
        first = np.flatnonzero(edge == -1) + 1
        if len(space) and not space[0]:
            first = np.concatenate([[0], first])
        self.word_start = first
        self.word_end = np.flatnonzero(edge == 1) + 1
        self.word_text = np.searchsorted(self.starts, self.word_start, side="right") - 1
        self.words_of = np.bincount(self.word_text, minlength=self.n).astype(np.int64)
        self.first_word = np.concatenate([[0], np.cumsum(self.words_of)])

    def range_hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes of each range."""
        n = len(self.bytes)
        sums = np.zeros(n + 1, dtype=U)
        np.cumsum(_values()[self.bytes] * powers(_BASE, n), out=sums[1:])
        h = (sums[end] - sums[start]) * powers(_INVERSE, n + 1)[start]
        return mix(h ^ (end - start).astype(U))

    def word_hashes(self) -> np.ndarray:
        return self.range_hashes(self.word_start, self.word_end)

    def shingles(self, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """(text number, hash) of every run of ``width`` words; a shorter text is one run.

        Sorted by text; repeats inside a text are kept.
        """
        words = self.word_hashes()
        if not len(words):
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=U)
        padded = np.concatenate([words, np.zeros(width, dtype=U)])
        h = padded[: len(words)].copy()
        for j in range(1, width):
            h = (h ^ (h >> U(29))) * U(0xD6E8FEB86659FD93) + padded[j : j + len(words)]
        h = mix(h)
        last = self.first_word[1:][self.word_text] - width
        number = np.arange(len(words))
        keep = number <= last
        short = np.flatnonzero((self.words_of > 0) & (self.words_of < width))
        for t in short.tolist():
            own = words[self.first_word[t] : self.first_word[t + 1]]
            one = U(len(own))
            with np.errstate(over="ignore"):
                for w in own:
                    one = (one ^ (one >> U(29))) * U(0xD6E8FEB86659FD93) + w
            h[self.first_word[t]] = mix(np.array([one], dtype=U))[0]
            keep[self.first_word[t]] = True
        return self.word_text[keep], h[keep]


def distinct_by_text(text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, hash) pairs, sorted by text and hash."""
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
    return text[new], h[new]
