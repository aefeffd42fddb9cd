"""Vectorised word scanning inside Spark tasks.

The functions here work on one Arrow batch: they find the words of every text in
the UTF-8 buffer with whole-array operations and give each word a 64-bit hash.
Spark deals the batches out (``mapInArrow``); nothing here sees more than one
slice of at most ``MAX_BYTES`` text bytes (or one single longer text).

Word hashes are 64 bits wide: two different words among ``d`` distinct ones share
a hash with probability about ``d**2 / 2**65``.
"""

from __future__ import annotations

import ctypes
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Executors need numpy and pyarrow only: the functions travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_BYTES = 1 << 20
_K1, _K2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
_K3 = 0x94D049BB133111EB
_BASE = 0x100000001B3 * 2 + 0x5851F42D4C957F2D


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(_K2)
    x ^= x >> np.uint64(27)
    x *= np.uint64(_K3)
    x ^= x >> np.uint64(31)
    return x


def separators(kind: str) -> np.ndarray:
    """``space``: words are runs of anything but [\\x20\\x09-\\x0D].
    ``alnum``: words are runs of [0-9a-z] (after lower-casing A-Z) and non-ASCII."""
    sep = np.zeros(256, dtype=bool)
    if kind == "space":
        sep[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
        return sep
    sep[:128] = True
    for lo, hi in (("0", "9"), ("a", "z"), ("A", "Z")):
        sep[ord(lo):ord(hi) + 1] = False
    return sep


def lower_table(lower: bool) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    return table


def byte_values() -> np.ndarray:
    """One fixed odd 64-bit value per byte."""
    return mix64((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_K1)) | np.uint64(1)


def text_slices(batch: pa.RecordBatch, col: str, max_bytes: int = MAX_BYTES):
    """Cut a batch into pieces of at most ``max_bytes`` text bytes (one row at least).
    A null text counts as empty."""
    texts = batch.column(batch.schema.get_field_index(col))
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    ends = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + max_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to
    give_back()


def give_back() -> None:
    """Return freed memory to the system: workers wait for further tasks, with all they hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def utf8_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=width)[texts.offset:texts.offset + len(texts) + 1]
    offsets = offsets.astype(np.int64)
    if buffers[2] is None or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint8), offsets - offsets[0]
    data = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def word_hashes(texts: pa.Array, kind: str = "space", lower: bool = True):
    """(hashes, first, starts, ends): a hash per word, the index of each text's first
    word (one more entry at the end), and the words' byte ranges."""
    data, offsets = utf8_buffer(texts)
    n = len(offsets) - 1
    inside = ~separators(kind)[data]
    if not inside.any():
        empty = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=np.uint64), np.zeros(n + 1, dtype=np.int64), empty, empty
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(stops) + 1
    first = np.searchsorted(starts, offsets)
    lead = starts[0]
    spans = np.diff(np.append(starts, len(data)))
    pos = np.arange(lead, len(data)) - np.repeat(starts, spans)
    powers = np.full(int(spans.max()), _BASE, dtype=np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    values = byte_values()[lower_table(lower)]
    values[separators(kind)] = 0
    terms = values[data[lead:]] * powers[pos]
    hashes = np.add.reduceat(terms, starts - lead)
    hashes ^= (ends - starts).astype(np.uint64) * np.uint64(_K1)
    return mix64(hashes), first, starts, ends


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for every run of ``k`` consecutive words (order matters)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    acc = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        acc = (acc ^ words[i:i + n]) * np.uint64(_K1)
        acc ^= acc >> np.uint64(29)
    return mix64(acc)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct ``k``-word shingles of one text; a shorter, non-empty text is
    one shingle made of all its words; a text without words has none."""
    if len(words) == 0:
        return np.zeros(0, dtype=np.uint64)
    grams = gram_hashes(words, min(k, len(words)))
    grams.sort()
    if len(grams) > 1:
        grams = grams[np.concatenate(([True], grams[1:] != grams[:-1]))]
    return grams
