"""Word shingles as sorted arrays of 64-bit hashes, for Arrow functions."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash

#: Words in a shingle.
WIDTH = 5
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_S = np.uint64(32)


class WordHashes(dict):
    """word -> 64-bit hash; forgets all when it has grown to ``most`` words."""

    most = 1 << 18

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _S)) * _MIX
    x = (x ^ (x >> _S)) * _MIX
    return x ^ (x >> _S)


def shingle_set(text: bytes, memo: WordHashes, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles of a UTF-8 text, A-Z lower-cased; one for a text of fewer words, none without words."""
    words = text.lower().split()  # bytes: ASCII letters and white space only
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, n)
    if n < width:
        out = np.full(1, n, np.uint64)
        for x in h:
            out = mixed(out * _MUL + x)
        return out
    out = h[: n - width + 1]
    for j in range(1, width):
        out = mixed(out) * _MUL + h[j : n - width + 1 + j]
    return np.unique(mixed(out))


def utf8(column: pa.Array | pa.ChunkedArray) -> Iterable[bytes]:
    """The texts of a string column as UTF-8, null as empty, one at a time."""
    for x in column.cast(pa.large_binary()):
        yield x.as_py() or b""
