"""Words, word hashes and shingle sets of texts, as NumPy arrays inside a task; slices of its batches."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from xxhash import xxh3_64_intdigest

U64 = np.uint64
#: Odd multiplier of the rolling hashes and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
SHINGLE = 5
#: Bytes of the texts that a task turns into Python objects at once, unless a single one is longer.
SLICE_BYTES = 1 << 20


def slices(batch: pa.RecordBatch, column: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive parts, each ending with the row that brings its values of a string or binary ``column``
    to ``size`` bytes.  Spark's batches go by rows, so with long texts a whole batch and its results are large."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    first = total = 0
    for end, n in enumerate(lengths.tolist(), 1):
        total += n
        if total >= size:
            yield batch.slice(first, end - first)
            first, total = end, 0
    if first < batch.num_rows or not batch.num_rows:
        yield batch.slice(first)


def split(text: str | None) -> list[bytes]:
    """Words are runs of anything but space and the control characters 9 to 13."""
    return text.encode().split() if text else []


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), dtype=U64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Powers:
    """Powers of an odd base and of its inverse, extended on demand."""

    def __init__(self, base: int, inverse: int):
        self.base, self.inverse = base, inverse
        self.up = self.down = np.ones(1, dtype=U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            steps = np.ones(n, dtype=U64)
            steps[1:] = U64(self.base)
            self.up = np.cumprod(steps, dtype=U64)
            steps[1:] = U64(self.inverse)
            self.down = np.cumprod(steps, dtype=U64)
        return self.up, self.down


_POWERS = Powers(BASE, BASE_INVERSE)


def windows(h: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of every run of ``length`` consecutive entries of ``h``."""
    n = len(h) - length + 1
    if n <= 0:
        return np.empty(0, dtype=U64)
    up, down = _POWERS.upto(len(h))
    sums = np.zeros(len(h) + 1, dtype=U64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mix((sums[length:] - sums[:n]) * down[:n])


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles of the text with A-Z lower-cased;
    with fewer words the whole sequence is one shingle; without words the set is empty."""
    h = hashes(text.encode().lower().split()) if text else np.empty(0, dtype=U64)
    if not len(h):
        return h
    if len(h) < SHINGLE:
        return mix(windows(h, len(h)) + U64(len(h)))
    return np.unique(windows(h, SHINGLE))
