"""Texts of Arrow batches as numpy arrays: words, hashes of words, of shingles and of sets of them.

Words are runs of bytes other than the six ASCII white-space bytes, so no decoding is needed. All
hashes are 64 bits wide and the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20  # text handled at a time; one longer text is a block of its own
_SPACES = b" \t\n\x0b\x0c\r"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads any difference over all bits."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _series(n: int, seed: int) -> np.ndarray:
    """`n` numbers of a fixed pseudo-random sequence."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15))


def _alphabet(between: bytes, fold_case: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes separate words, and a number for each byte of a word."""
    separates = np.zeros(256, bool)
    separates[list(between)] = True
    values = np.where(separates, np.uint64(0), _series(256, 1 << 20))
    if fold_case:
        values[65:91] = values[97:123]
    return separates, values


def to_planes(numbers: np.ndarray, kind: str = "<u4") -> bytes:
    """Numbers by planes of bytes, so that the high planes of small numbers, or of hashes with the same first bits, compress."""
    numbers = numbers.astype(kind, copy=False)
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T).tobytes()


def from_planes(packed: bytes, kind: str = "<i4") -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


_NOT_ALNUM = bytes(b for b in range(128) if not chr(b).isalnum())
PLAIN = _alphabet(_SPACES, False)
FOLDED = _alphabet(_SPACES, True)  # A-Z count as a-z
LETTERS = _alphabet(_NOT_ALNUM, True)  # ASCII punctuation separates words too
_BASE = 0x5851F42D4C957F2D | 1
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        grown = np.full(1 << max(8, int(n - 1).bit_length()), _BASE, np.uint64)
        grown[0] = 1
        _POWERS = np.cumprod(grown, dtype=np.uint64)
    return _POWERS


class Words:
    """The words of a block of texts: where they start and end, and the words of text d as first[d]:first[d + 1]."""

    def __init__(self, buffer: np.ndarray, offsets: np.ndarray, alphabet: tuple[np.ndarray, np.ndarray] = PLAIN):
        space = alphabet[0][buffer]
        before = np.ones(len(buffer), bool)
        before[1:] = space[:-1]
        inside = offsets[:-1][offsets[:-1] < offsets[1:]]
        before[inside] = True
        self.buffer, self.offsets = buffer, offsets
        self.starts = np.flatnonzero(~space & before)
        self.first = np.searchsorted(self.starts, offsets)
        limits = np.append(self.starts[1:], len(buffer))
        self.spans = limits - self.starts
        self.hash = np.zeros(0, np.uint64)
        if len(self.starts):
            lead = self.starts[0]
            place = np.arange(lead, len(buffer), dtype=np.int64) - np.repeat(self.starts, self.spans)
            part = alphabet[1][buffer[lead:]] * _powers(int(self.spans.max()))[place]
            self.hash = mix(np.add.reduceat(part, self.starts - lead))

        self._values = alphabet[1]

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def heads(self, k: int) -> np.ndarray:
        """Hashes of the first k bytes of each word, or of all if it has fewer."""
        total, inside = np.zeros(len(self.starts), np.uint64), np.ones(len(self.starts), bool)
        for j in range(k):
            inside = inside & (self.spans > j)
            value = self._values[self.buffer[np.where(inside, self.starts + j, 0)]]
            inside = inside & (value != 0)
            total += np.where(inside, value, 0) * _powers(k)[j]
        return mix(total)


_FACTORS = _series(64, 1 << 30) | np.uint64(1)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k words, by start."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += words[j : j + n] * _FACTORS[j]
    return mix(total)


def whole(words: np.ndarray) -> np.ndarray:
    """The hash of a text with fewer words than a shingle, as an array of one."""
    total = np.sum(words * _FACTORS[: len(words)], dtype=np.uint64) + np.uint64(len(words)) * _FACTORS[63]
    return mix(np.array([total], np.uint64))


def sequences(words: Words) -> np.ndarray:
    """One hash per text of its words in their order; 0 for a text without words."""
    counts = words.counts()
    place = np.arange(len(words.hash), dtype=np.uint64) - np.repeat(words.first[:-1], counts).astype(np.uint64)
    value = mix(words.hash + (place + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    out, some = np.zeros(len(counts), np.uint64), counts > 0
    if some.any():
        out[some] = mix(np.add.reduceat(value, words.first[:-1][some]))
    return out


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows of a batch, the bytes of their texts, and where each text starts. NULL counts as empty."""
    texts = batch.column(column)
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        high = min(high, len(texts))
        yield slice(low, high), data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high
