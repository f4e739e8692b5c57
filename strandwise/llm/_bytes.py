"""Vectorised work on the UTF-8 bytes of Arrow string columns.

All helpers take whole texts. ``chunks`` bounds how many documents are held in temporary arrays at
once; a document of more than ``PART`` bytes is a chunk of its own, worked on part by part with what
carries over, so that temporary arrays stay bounded for texts of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
CHUNK_BYTES = 1 << 20
PART = 4 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that separate words: space and 0x09-0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes outside ASCII letters, digits and multi-byte characters.
NOT_ALNUM = np.ones(256, dtype=bool)
NOT_ALNUM[48:58] = NOT_ALNUM[65:91] = NOT_ALNUM[97:123] = NOT_ALNUM[128:] = False

_ODD = U64(0x9E3779B97F4A7C15)
_ODD_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche on unsigned 64-bit values."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        steps = np.full(size, _ODD), np.full(size, _ODD_INVERSE)
        for s in steps:
            s[0] = 1
            np.multiply.accumulate(s, out=s)
        _powers = steps
    return _powers[0][:n], _powers[1][:n]


def chunks(batch: pa.RecordBatch, column: str, limit: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for runs of rows of about ``limit`` bytes of text (``CHUNK_BYTES``, if none); null counts as empty."""
    limit = limit or CHUNK_BYTES
    text = batch.column(batch.schema.get_field_index(column))
    if text.null_count:
        text = text.fill_null("")
    text = text.cast(pa.large_binary()) if not pa.types.is_large_binary(text.type) else text
    n = len(text)
    if not n:
        return
    at = np.frombuffer(text.buffers()[1], np.int64, n + 1, text.offset * 8)
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        end = int(np.searchsorted(at, at[start] + limit, "right")) - 1
        end = min(max(end, start + 1), n)
        yield batch.slice(start, end - start), data[at[start] : at[end]], at[start : end + 1] - at[start]
        start = end


def parts(size: int) -> Iterator[tuple[int, int]]:
    """[begin, end) of the parts of ``size`` bytes."""
    for begin in range(0, max(size, 1), PART):
        yield begin, min(size, begin + PART)


def cut_parts(data: np.ndarray, separators: np.ndarray = SPACE, anywhere: bool = False) -> Iterator[tuple[int, int]]:
    """[begin, end) of parts that end at a separator, of about ``PART`` bytes at most.

    Where none comes in time, the part is all up to the next one, or of ``PART`` bytes with ``anywhere``.
    """
    begin, window = 0, PART if anywhere else PART + 1  # a word of ``PART`` bytes and the separator after it are found
    while begin < len(data):
        end = min(len(data), begin + window)
        if end < len(data) or end - begin > PART:
            found = np.flatnonzero(separators[data[begin:end]])
            if len(found):
                end = begin + int(found[-1]) + 1
            elif not anywhere:
                while end < len(data) and not separators[data[end - 1]]:
                    more = np.flatnonzero(separators[data[end : end + PART]])
                    end = end + int(more[0]) + 1 if len(more) else min(len(data), end + PART)
        yield begin, end
        begin = end


class Words:
    """Words of a chunk: begin, end (byte positions), doc (row of the chunk), per-row bounds."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> None:
        inside = ~separators[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.zeros(len(data) + 1, bool)
        before[1:] = inside
        here = np.zeros(len(data) + 1, bool)
        here[:-1] = inside
        self.begin = np.flatnonzero(here & (~before | edge))
        self.end = np.flatnonzero(before & (~here | edge))
        self.bounds = np.searchsorted(self.begin, offsets)
        self.per_doc = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.per_doc)
        self._data = data

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes, equal on every machine."""
        data = self._data
        up, down = _power_tables(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[:-1], out=sums[1:])
        h = (sums[self.end] - sums[self.begin]) * down[self.begin]
        return mix(h ^ (self.end - self.begin).astype(np.uint64) * _ODD)


class Hashes:
    """64-bit hashes of a chunk's words (``h``), with doc, bounds and per_doc as in ``Words``; a word of more than ``PART`` bytes has one of its own kind."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> None:
        if len(data) <= PART:
            words = Words(data, offsets, separators)
            self.h, self.doc, self.bounds, self.per_doc = words.hashes(), words.doc, words.bounds, words.per_doc
            return
        found = []
        for begin, end in cut_parts(data, separators):
            own = data[begin:end]
            word = own[~separators[own]]
            if len(word) > PART:  # a part of this one word
                found.append(np.array([xxhash.xxh64_intdigest(word.tobytes())], np.uint64))
            else:
                found.append(Words(own, np.array([0, end - begin]), separators).hashes())
        self.h = np.concatenate(found)
        self.doc, self.bounds, self.per_doc = np.zeros(len(self.h), np.int64), np.array([0, len(self.h)]), np.array([len(self.h)])


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def sums_by_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i+1]], 0 for empty runs."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
