"""Words of a text column as numpy arrays: byte offsets and 64-bit hashes, one pass for many documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SPACE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LONG_WORD = 64
KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets and bytes of a string column; null is the empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return at, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def runs(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with about ``limit`` bytes of text each, so that the work arrays stay small.

    Yields the slice, its row offsets (from 0) and its bytes. A longer text is
    a slice of its own and never cut. Memory of earlier batches is given back,
    so that a worker that waits for its next task holds little.
    """
    pa.default_memory_pool().release_unused()
    at, data = texts(batch.column(batch.schema.get_field_index(column)))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        last = min(last, batch.num_rows)
        yield batch.slice(first, last - first), at[first:last + 1] - at[first], data[at[first]:at[last]]
        first = last
    pa.default_memory_pool().release_unused()


def pieces(raw: bytes, gap: re.Pattern[bytes], size: int = 1 << 20) -> Iterator[bytes]:
    """A long text in pieces of about ``size`` bytes, cut where ``gap`` matches, so that no word is cut."""
    at = 0
    while at < len(raw):
        found = gap.search(raw, at + size)
        end = found.start() if found else len(raw)
        yield raw[at:end]
        at = end


def split(at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal stretches of bytes of one kind other than 0, inside each row.

    Returns their starts, their ends and, per row, the index of its first stretch.
    """
    if not len(kind):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    edge = np.empty(len(kind) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[0] = edge[-1] = True
    edge[at] = True
    cuts = np.flatnonzero(edge)
    held = kind[cuts[:-1]] != 0
    starts, ends = cuts[:-1][held], cuts[1:][held]
    return starts, ends, np.searchsorted(starts, at)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each stretch of bytes; eight bytes a step, long ones one by one."""
    size = ends - starts
    h = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    if not len(size):
        return h
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    live = np.flatnonzero(size <= LONG_WORD)
    step = 0
    while len(live):
        left = np.minimum(size[live] - step, 8)
        h[live] = mix(h[live] ^ (eight[starts[live] + step] & KEEP[left]))
        step += 8
        live = live[size[live] > step]
    raw = data.tobytes() if (size > LONG_WORD).any() else b""
    for k in np.flatnonzero(size > LONG_WORD):
        h[k] = xxhash.xxh3_64_intdigest(raw[starts[k]:ends[k]])
    return h


def words(at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (no white space inside, A-Z lower-cased) and, per row, its first word."""
    low = LOWER[data]
    starts, ends, first = split(at, (~SPACE[low]).astype(np.uint8))
    return hashes(low, starts, ends), first


def shingles(word: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words of one document; a shorter document is one run; no words, none."""
    n = min(n, len(word))
    if not n:
        return word
    out = np.full(len(word) - n + 1, np.uint64(n))
    for k in range(n):
        out = mix(out ^ word[k:len(word) - n + 1 + k])
    return out
