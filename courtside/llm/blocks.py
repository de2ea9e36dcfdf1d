"""Texts of Arrow batches as byte arrays: words and word hashes for numpy code inside Spark tasks.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. These bytes never occur inside a multi-byte UTF-8 character, so the
words are the same as those of the character pattern ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

_RANDOM = np.random.Generator(np.random.PCG64(20240607))
#: One random odd number per byte value; separators weigh nothing.
BYTE_WEIGHT = np.where(SEPARATOR, 0, _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)).astype(np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def text_blocks(batches: Iterable[pa.RecordBatch], text: str, max_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``max_bytes`` of text each; a longer text forms a slice of its own."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        total = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(total, total[at] + max_bytes, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (null: empty) and the offsets of the rows, the last one included."""
    filled = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = np.frombuffer(filled.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(filled) else np.zeros(0, np.uint8)
    return data, (offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64))


def find_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of every word, and for every row (and the end) the number of its first word."""
    inside = ~SEPARATOR[data]
    filled = offsets[:-1] < offsets[1:]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    first, last = offsets[:-1][filled], offsets[1:][filled] - 1
    opens[first] = inside[first]
    closes[last] = inside[last]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """``base`` to the powers 0 to n - 1, modulo 2^64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of every word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    used = data[starts[0] :]
    begin = starts - starts[0]
    position = np.arange(len(used)) - np.repeat(begin, np.diff(begin, append=len(used)))
    longest = int((ends - starts).max())
    weight = BYTE_WEIGHT[used]
    weight *= powers(longest + 1)[np.minimum(position, longest)]
    return mixed(np.add.reduceat(weight, begin))
