"""Word and shingle hashing of whole texts with numpy, for use inside Arrow tasks.

A word is a maximal run of characters other than space and U+0009 to U+000D; A-Z are
lower-cased.  All separators are single ASCII bytes, so the work is done on UTF-8 bytes,
in chunks cut at separators: memory follows the longest word, not the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_CHUNK = 1 << 19
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_WORD = (~_SPACE).astype(np.uint8)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, at least ``n`` of each."""
    if _powers.get("up", np.zeros(0)).size < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.full(max(n, 2 * _CHUNK), np.uint64(base), dtype=np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def join_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (null: empty), each followed by a newline, and the n + 1 start offsets."""
    parts = [x or b"" for x in texts.cast(pa.large_binary()).to_pylist()]
    starts = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(x) + 1 for x in parts], out=starts[1:])
    return np.frombuffer(b"\n".join([*parts, b""]), dtype=np.uint8), starts


def hash_runs(buf: np.ndarray, kind: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start offset and 64-bit hash of every maximal run of bytes of one kind (kind 0 separates).

    ``kind`` and ``fold`` are tables by byte; ``fold`` is applied before hashing.
    """
    starts, hashes, lo = [], [], 0
    while lo < buf.size:
        hi = min(buf.size, lo + _CHUNK)
        while hi < buf.size and not _SPACE[buf[hi - 1]]:
            stop = np.flatnonzero(_SPACE[buf[hi:hi + 4096]])
            hi = min(buf.size, hi + (int(stop[0]) + 1 if stop.size else 4096))
        part = fold[buf[lo:hi]]
        up, down = _power_table(part.size)
        kinds = np.zeros(part.size + 2, dtype=np.uint8)
        kinds[1:-1] = kind[buf[lo:hi]]
        edge = np.flatnonzero(kinds[1:] != kinds[:-1])
        inside = np.flatnonzero(kinds[edge + 1])  # the last edge ends the last run
        begin, end = edge[inside], edge[inside + 1]
        total = np.zeros(part.size + 1, dtype=np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:part.size], out=total[1:])
        starts.append(begin + lo)
        hashes.append(mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64)))
        lo = hi
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def hash_words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start offset and 64-bit hash of every word of ``buf``."""
    return hash_runs(buf, _WORD, _LOWER)


def words_of_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, and the n + 1 bounds of each text's words."""
    buf, text_starts = join_texts(texts)
    starts, hashes = hash_words(buf)
    return hashes, np.searchsorted(starts, text_starts)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words; with 1 to k - 1 words the whole sequence counts as one run."""
    if not words.size:
        return words
    n = min(k, words.size)
    up, _ = _power_table(n)
    out = np.zeros(words.size - n + 1, dtype=np.uint64)
    for j in range(n):
        out += words[j:words.size - n + 1 + j] * up[j]
    return mix(out + np.uint64(n))
