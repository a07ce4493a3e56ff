"""Word shingles as sorted 64-bit hash sets, for use inside tasks."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from xxhash import xxh3_64_intdigest

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def word_hashes(text: str, seed: int = 0) -> np.ndarray:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z in lower case."""
    found = text.encode().lower().split()  # of bytes, both only know ASCII
    return np.fromiter((xxh3_64_intdigest(word, seed) for word in found), np.uint64, len(found))


# Bytes that are hashed at once, and the length from which a word is hashed by itself.
BLOCK = 1 << 16


@lru_cache(maxsize=1)
def _byte_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A value for each byte, whether it is a blank, and the powers of an odd number and of its inverse."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)
    blank = np.zeros(256, bool)
    blank[[0x20, *range(0x09, 0x0E)]] = True
    inverse = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
    powers = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(BLOCK - 1, base)])) for base in (_MULTIPLIER, inverse)]
    return values, blank, *powers


def _block_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words of fewer than ``BLOCK`` bytes: a polynomial of each word's bytes, by running sums."""
    values, is_blank, powers, inverses = _byte_tables()
    found = np.frombuffer(data, np.uint8)
    edges = np.ones(len(found) + 2, bool)
    np.take(is_blank, found, out=edges[1:-1])
    # a word lies between a blank and the next one
    turns = np.flatnonzero(edges[1:] != edges[:-1])
    begin, end = turns[::2], turns[1::2]
    total = np.zeros(len(found) + 1, np.uint64)
    np.cumsum(values[found] * powers[: len(found)], out=total[1:])
    return mix((total[end] - total[begin]) * inverses[begin] + (end - begin).astype(np.uint64))


def block_word_hashes(text: str) -> np.ndarray:
    """Hashes of the words as ``word_hashes`` finds them, a block of bytes at a time; other values than those of ``word_hashes``."""
    data = text.encode().lower()
    if len(data) < BLOCK:
        return _block_hashes(data)
    blank, out, at = _byte_tables()[1], [], 0
    while len(data) - at >= BLOCK:
        blanks = np.flatnonzero(blank[np.frombuffer(data, np.uint8, BLOCK, at)])
        if len(blanks):
            end = at + int(blanks[-1]) + 1
            out.append(_block_hashes(data[at:end]))
        else:
            gap = _GAP.search(data, at + BLOCK)
            end = gap.start() if gap else len(data)
            out.append(np.array([xxh3_64_intdigest(data[at:end])], np.uint64))
        at = end
    return np.concatenate([*out, _block_hashes(data[at:])])


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the whole value."""
    values = (values ^ (values >> np.uint64(32))) * _MIX
    values = (values ^ (values >> np.uint64(32))) * _MIX
    return values ^ (values >> np.uint64(32))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """One hash for each window of ``width`` words, in order."""
    count = len(words) - width + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for k in range(width):
        total = total * _MULTIPLIER + words[k : k + count]
    return mix(total)


def block_shingle_set(text: str | None, width: int) -> np.ndarray:
    """``shingle_set`` with the hashes of ``block_word_hashes``, which are found faster."""
    words = block_word_hashes(text or "")
    if not len(words):
        return words
    if len(words) < width:
        return mix(window_hashes(words, len(words)) + np.uint64(len(words)))
    values = np.sort(window_hashes(words, width))
    return values[np.concatenate([[True], values[1:] != values[:-1]])]


def shingle_set(text: str | None, width: int, seed: int = 0) -> np.ndarray:
    """The sorted distinct shingles of a text; with fewer words than ``width`` the whole sequence is the only one."""
    words = word_hashes(text or "", seed)
    if not len(words):
        return words
    if len(words) < width:
        # the length keeps short sequences apart from windows
        return mix(window_hashes(words, len(words)) + np.uint64(len(words)))
    return np.unique(window_hashes(words, width))


def overlap(left: np.ndarray, right: np.ndarray) -> int:
    """How many values two sorted sets share."""
    if len(left) > len(right):
        left, right = right, left
    if not len(left):
        return 0
    at = np.searchsorted(right, left)
    at[at == len(right)] = 0
    return int((right[at] == left).sum())
