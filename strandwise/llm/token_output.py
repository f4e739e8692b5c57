"""Token-id output: packed id matrices with cumulative segment lengths and position resets.

Each partition tokenises its documents, splits those longer than the row length without loss, and
packs the pieces best-fit decreasing; the bin for a piece is found in a segment tree over
remaining capacities. A full buffer of pieces is packed and written at once, so ids are never
shuffled and memory is bounded by ``buffer`` ids.

A written row holds: row_id, used, input_ids (row_length little-endian unsigned 32-bit ids as
bytes, padded with the pad id), cu_seqlens (cumulative segment lengths from 0), position_ids (the
same shape, restarting at 0 in each segment), and for each segment doc_id, piece and start.

Defined results: null text is empty, a document of just the end id; every id of every document is
in exactly one segment; repeated rows are packed once each; other columns are ignored; an empty
table gives an empty output.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import new_path
from ._tokens import pieces, tokenizer


class CapacityTree:
    """Segment tree over remaining capacities; leaf c counts the open bins with capacity c."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, bin_: int, room: int) -> None:
        self.bins[room].append(bin_)
        node = self.size + room
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(bin, its capacity) with the smallest capacity of at least ``least``."""
        node = self.size + least
        while not self.count[node]:
            while node & 1:  # a right child: what is larger lies further up
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.size:
            node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.size
        while node:
            self.count[node] -= 1
            node >>= 1
        return self.bins[room].pop(), room


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items of each bin, in order of insertion."""
    tree, bins = CapacityTree(capacity), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take(sizes[i])
        if found is None:
            bin_, room = len(bins), capacity
            bins.append([])
        else:
            bin_, room = found
        bins[bin_].append(i)
        if room > sizes[i]:
            tree.put(bin_, room - sizes[i])
    return bins


_ROW = "row_id long, used int, input_ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<long>, pieces array<int>, starts array<long>"


def _rows(batches: Iterable[pa.RecordBatch], path: str, end_id: int, pad_id: int, length: int, buffer: int) -> Iterator[pa.RecordBatch]:
    own = tokenizer(path)
    base = TaskContext.get().partitionId() << 32
    held: list[tuple[int | None, int, int, np.ndarray]] = []
    size = made = 0
    counting = np.arange(length, dtype=np.uint16 if length <= 1 << 16 else np.uint32)

    def out() -> Iterator[pa.RecordBatch]:
        nonlocal made, size
        rows: list[tuple] = []
        for items in best_fit_decreasing([len(x[3]) for x in held], length):
            ids = np.full(length, pad_id, "<u4")
            at = np.zeros(length, "<u4")
            ends = [0]
            for i in items:
                piece = held[i][3]
                ids[ends[-1] : ends[-1] + len(piece)] = piece
                at[ends[-1] : ends[-1] + len(piece)] = counting[: len(piece)]
                ends.append(ends[-1] + len(piece))
            rows.append((base + made, ends[-1], ids.tobytes(), at.tobytes(), ends, *([held[i][k] for i in items] for k in range(3))))
            made += 1
            if len(rows) == 512:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)
        held.clear()
        size = 0

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for number, (start, ids) in enumerate(pieces(own.ids(text.as_py()), end_id, length)):
                held.append((doc_id, number, start, ids))
                size += len(ids) + 64
            if size >= buffer:
                yield from out()
    if held:
        yield from out()


_TYPES = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()))
_NAMES = ("row_id", "used", "input_ids", "position_ids", "cu_seqlens", "doc_ids", "pieces", "starts")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)


def write_token_rows(docs: DataFrame, tokenizer_path: str, end_id: int, length: int = 1024, pad_id: int = 0, doc_id: str = "doc_id", text: str = "text", path: str | None = None, buffer: int = 8 << 20) -> DataFrame:
    """Write the packed rows as Parquet under ``path`` (the shared folder if none) and return them, read again."""
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    made = own.mapInArrow(lambda it: _rows(it, tokenizer_path, end_id, pad_id, length, buffer), _ROW)
    path = path or new_path(spark, "token-rows")
    made.write.parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
        out: list[tuple] = []
        for row, ids, at, ends, docs, numbers, starts in zip(*(columns[n] for n in ("row_id", "input_ids", "position_ids", "cu_seqlens", "doc_ids", "pieces", "starts")), strict=True):
            ids, at, ends = ids.as_py(), at.as_py(), ends.as_py()
            for k, (d, p, s) in enumerate(zip(docs.as_py(), numbers.as_py(), starts.as_py(), strict=True)):
                a, b = ends[k], ends[k + 1]
                positions = np.frombuffer(at, "<u4")[a:b]
                out.append((d, p, s, b - a, zlib.crc32(ids[4 * a : 4 * b]), row.as_py(), a, bool((positions == np.arange(b - a)).all())))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "row_id", "offset", "positions_reset"])


def segment_digests(rows: DataFrame) -> DataFrame:
    """One row per segment of written rows: doc_id, piece, start, length, ids_crc32, row_id, offset, positions_reset."""
    own = rows.select("row_id", "input_ids", "position_ids", "cu_seqlens", "doc_ids", "pieces", "starts")
    return own.mapInArrow(_digest, "doc_id long, piece int, start long, length long, ids_crc32 long, row_id long, offset long, positions_reset boolean")
