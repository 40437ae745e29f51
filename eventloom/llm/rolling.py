"""Hashes of words and of word windows over Arrow text buffers, in whole-array steps.

A word's hash starts from its length and takes its bytes eight at a time, with a
mixing step after each eight; words of more than LONG bytes are hashed by
BLAKE2b. A window's hash is a chain over the hashes of its words, made by
doubling: a stretch of 2n words comes from its two halves. Neither is a
polynomial, so no pattern of letters or words cancels out. Equal stretches get
equal hashes on every machine.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

#: Bytes of a word above which it is hashed by itself.
LONG = 64
#: Words of a step: few enough for its arrays to stay in the processor's cache.
AT_ONCE = 1 << 13

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32
#: What is left of the last eight bytes of a word, by how many of them belong to it.
TAIL = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)
#: Odd numbers that tell a hash on its left side from one on its right.
LEFT, RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the whole number, one to one."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of two stretches one after the other."""
    out = left * LEFT
    out += np.uint64(1)
    out = mix(out)
    out += right * RIGHT
    return mix(out)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each text starts and the last ends; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def word_hashes(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of all texts, and the number of the first word of each text (one more at the end)."""
    data, offsets = buffers(column)
    if lower:
        data = TO_LOWER[data]
    solid = ~BLANK[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.r_[False, solid[:-1]] if len(data) else solid
    starts = np.flatnonzero(solid & (~before | cut[:-1]))
    after = np.r_[solid[1:], False] if len(data) else solid
    sizes = np.flatnonzero(solid & (~after | cut[1:])) + 1 - starts
    padded = np.r_[data, np.zeros(8, np.uint8)]
    # The eight bytes from each position on.
    eights = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    out = np.empty(len(starts), np.uint64)
    for i in range(0, len(starts), AT_ONCE):
        out[i : i + AT_ONCE] = _short_words(eights, starts[i : i + AT_ONCE], sizes[i : i + AT_ONCE])
    for i in np.flatnonzero(sizes > LONG):
        word = data[starts[i] : starts[i] + sizes[i]].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return out, np.searchsorted(starts, offsets)


def _short_words(eights: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of words of at most LONG bytes; those of longer ones are to be replaced."""
    out = mix(sizes.astype(np.uint64) * LEFT)
    left = np.flatnonzero(sizes <= LONG)
    at = 0
    while len(left):
        piece = eights[starts[left] + at] & TAIL[np.minimum(sizes[left] - at, 8)]
        out[left] = mix((out[left] ^ piece) * RIGHT + LEFT)
        at += 8
        left = left[sizes[left] > at]
    return out


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of every window of ``size`` words; windows across two texts are the caller's to leave out."""
    n = max(0, len(words) - size + 1)
    out = np.empty(n, np.uint64)
    for i in range(0, n, AT_ONCE):
        out[i : i + AT_ONCE] = _windows(words[i : i + AT_ONCE + size - 1], size)
    return out


def _windows(words: np.ndarray, size: int) -> np.ndarray:
    n = len(words) - size + 1
    out, done, stretch, covers = None, 0, words, 1
    while True:
        if size & covers:  # the stretches of 1, 2, 4, ... words that make up the size, from left to right
            part = stretch[done : done + n]
            out = part if out is None else joined(out, part)
            done += covers
        if done == size:
            return mix(out + np.uint64(size))
        stretch = joined(stretch[:-covers], stretch[covers:])
        covers *= 2


def whole_windows(firsts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of the first ``n`` window starts have all their words in one text."""
    # The last size - 1 words of each text start no window.
    begin, end = np.maximum(firsts[1:] - size + 1, firsts[:-1]), firsts[1:]
    total = int(firsts[-1]) + 1
    return np.cumsum(np.bincount(begin, minlength=total) - np.bincount(end, minlength=total))[:n] == 0
