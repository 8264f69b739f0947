"""Words and word-window hashes of whole texts, for use inside Arrow batches.

A word is a maximal run of bytes other than the six ASCII white-space characters, which is what
``bytes.split()`` yields. Texts are handled as UTF-8 bytes, so nothing is decoded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: Words whose hash a worker remembers; past that it forgets them all and starts again.
REMEMBERED = 150_000

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


_CODES = _Codes()


def texts(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string column."""
    return column.cast(pa.binary()).to_pylist()


def word_codes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter(map(_CODES.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits."""
    values = (values ^ (values >> np.uint64(30))) * _MIX
    values = (values ^ (values >> np.uint64(27))) * _MIX2
    return values ^ (values >> np.uint64(31))


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` consecutive words; empty for shorter texts.

    Hashes of runs whose lengths are powers of two are joined, so the work is logarithmic in the width.
    """
    count = len(codes) - width + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total, done, power, run, rest = None, 0, codes, 1, width
    factor = _STEP
    with np.errstate(over="ignore"):
        while True:
            if rest & 1:
                part = power[done:done + count]
                total = part.copy() if total is None else total * factor + part
                done += run
            rest >>= 1
            if not rest:
                return mixed(total)
            power = power[:-run] * factor + power[run:]
            factor = factor * factor
            run *= 2


def shingle_set(words: list[bytes], width: int) -> np.ndarray:
    """The sorted distinct window hashes; those of the whole sequence when it is shorter than a window."""
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(word_codes(words), min(width, len(words))))
