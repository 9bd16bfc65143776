"""Numpy kernels over Arrow string batches: whole texts to 64-bit word hashes without Python loops."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_P = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_WORD = np.zeros(256, bool)
for _r in (range(48, 58), range(65, 91), range(97, 123), range(128, 256)):
    _WORD[_r.start : _r.stop] = True
_WORD[95] = True
_SPLIT_BYTES = 1 << 20


@cache
def _heap() -> ctypes.CDLL | None:
    """The C library, if it can give free pages back; Arrow then takes its memory there too, so that one call frees both."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.malloc_trim
    except (OSError, AttributeError):
        return None
    pa.set_memory_pool(pa.system_memory_pool())
    return libc


def give_back() -> None:
    """Return free pages to the system. Workers are kept between tasks and stages, and idle ones would hold their peak."""
    if heap := _heap():
        heap.malloc_trim(0)


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`work`, and then, when its own variables are gone, what it has freed goes back to the system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads entropy over all 64 bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(col: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each followed by one newline, and the offset of each text; null reads as empty."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if lower:
        col = pc.utf8_lower(col)
    col = pc.binary_join_element_wise(col, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of letters, digits, underscores and non-ASCII bytes."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    is_word = _WORD[data]
    edge = np.flatnonzero(is_word[1:] != is_word[:-1]) + 1
    if is_word[0]:
        edge = np.concatenate(([0], edge))
    if is_word[-1]:
        edge = np.concatenate((edge, [len(data)]))
    return edge[0::2], edge[1::2]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, from differences of one wrapping prefix sum."""
    out = np.zeros(len(start), np.uint64)
    if not len(start):
        return out
    lo = 0
    while lo < len(start):  # blocks bound the memory and keep the exponents small
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + (1 << 20), "right")))
        a, b = int(start[lo]), int(end[hi - 1])
        n = b - a
        power = np.empty(n + 1, np.uint64)
        power[0] = 1
        power[1:] = _P
        np.multiply.accumulate(power, out=power)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * power[:n], out=prefix[1:])
        s, e = start[lo:hi] - a, end[lo:hi] - a
        inverse = np.empty(n + 1, np.uint64)
        inverse[0] = 1
        inverse[1:] = _INV
        np.multiply.accumulate(inverse, out=inverse)
        # dividing by the power at its start makes equal spans equal wherever they lie
        out[lo:hi] = (prefix[e] - prefix[s]) * inverse[s]
        lo = hi
    return mix(out)


def doc_words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, and the offset of each text's first word."""
    data, off = text_bytes(col)
    start, end = word_spans(data)
    return span_hashes(data, start, end), np.searchsorted(start, off)


def split_batches(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = _SPLIT_BYTES) -> Iterator[pa.RecordBatch]:
    """Re-cut batches so that each holds at most about `most` bytes of text, or one row."""
    _heap()
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        run = np.cumsum(sizes)
        lo = 0
        while lo < len(sizes):
            hi = max(lo + 1, int(np.searchsorted(run, (run[lo - 1] if lo else 0) + most, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
        del batch
        give_back()


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values (1-D or 2-D) over [offsets[i], offsets[i+1]); empty segments give 0."""
    shape = (len(offsets) - 1, *values.shape[1:])
    out = np.zeros(shape, values.dtype)
    full = offsets[1:] > offsets[:-1]
    if len(values) and full.any():
        out[full] = np.add.reduceat(values, offsets[:-1][full], axis=0)
    return out
