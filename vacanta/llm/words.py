r"""Words of whole texts as 64-bit hashes, computed on Arrow buffers with numpy.

A word is a run of bytes outside `[\x20\x09-\x0D]`, A-Z lower-cased. No Python object is made per word: a
text column is read as one byte buffer, word limits come from a table of white space, and each word is hashed
by a polynomial over random 64-bit values of its bytes, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
# Everything in ASCII but letters and digits, for words without punctuation.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.RandomState(20_261)
_BYTE = _RANDOM.randint(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_WINDOW_BASE = np.uint64(0xD1B54A32D192ED03)
# Bytes of text handled at once: the arrays of a chunk stay within the processor's cache.
CHUNK = 1 << 20

_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        size = max(n, 2 * len(have), CHUNK)
        steps = np.full(size, _BASE if kind == "up" else _INVERSE, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 4 * CHUNK:  # the powers of one huge text are not kept
            _powers[kind] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word (bijective)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


@dataclass
class Words:
    """Words of the rows `row` to `row + rows`: hashes, and for each row the index of its first word (one more at the end)."""

    row: int
    rows: int
    hashes: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary()) if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def words_of(column: pa.Array, chunk: int = CHUNK, apart: np.ndarray = _SPACE) -> Iterator[Words]:
    """Words of a text column, chunk by chunk (whole rows, about `chunk` bytes each). Null texts have no words.

    `apart` marks the bytes that stand between words.
    """
    values = weights(apart)
    for row, limits, text in lowered(column, chunk):
        yield Words(row, len(limits) - 1, *_hash(text, limits, apart, values))


def weights(apart: np.ndarray) -> np.ndarray:
    """Weight of every byte in a word's hash: none for those between words."""
    return np.where(apart, np.uint64(0), _BYTE)


def lowered(column: pa.Array, chunk: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row of a chunk, the limits of its texts, and their bytes with A-Z lower-cased. Null texts are empty."""
    offsets, data = _buffer(column)
    row, rows = 0, len(column)
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + chunk, side="right")) - 1)
        end = min(end, rows)
        yield row, offsets[row : end + 1] - offsets[row], _LOWER[data[offsets[row] : offsets[end]]]
        row = end


def located(text: np.ndarray, limits: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of every word of texts that lie one after the other, and for each text the index of its first word."""
    space = apart[text]
    opens = np.ones(len(text), bool)
    opens[1:] = space[:-1]
    opens[limits[:-1][limits[:-1] < len(text)]] = True
    starts = np.flatnonzero(opens & ~space)
    return starts, np.searchsorted(starts, limits)


def hashed(text: np.ndarray, starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Hashes of the words; `values` are the weights of the bytes, 0 for those between words."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    # A word's bytes run from its start to the next start; what stands between weighs nothing.
    sums = np.add.reduceat(values[text] * _power("down", len(text)), starts)
    return mix(sums * _power("up", len(text))[starts])


def _hash(text: np.ndarray, limits: np.ndarray, apart: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(text):
        return np.zeros(0, np.uint64), np.zeros(len(limits), np.int64)
    starts, first = located(text, limits, apart)
    return hashed(text, starts, values), first


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin fingerprint of every window of `k` consecutive words, limits of rows not regarded."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= _WINDOW_BASE
        out += hashes[j : j + n]
    return mix(out)


def hash_word(word: str) -> int:
    """The hash of one word, signed as Spark stores it."""
    (w,) = words_of(pa.array([word]))
    return int(w.hashes[:1].view(np.int64)[0]) if len(w.hashes) else 0
