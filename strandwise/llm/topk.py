"""Exact top-k search by distributed histogram selection.

Quantised vectors are written once as blocks of rows; queries are blocks too, with the interval where
each one's kth highest score must lie. A round pairs blocks of candidates with blocks of queries (the
query set against all rows, tile by tile, as tasks of one job), counts scores in histograms over the
intervals, adds the histograms up and narrows the intervals, until each is one value. A tile tells only
its bins from the top down to its own kth score, for the kth score of all can't be below that. Then
candidates at or above that value are kept, ties going to the smaller id. Vectors, queries and intervals
stay in the shared folder; the driver sees one number, and a round more only means narrower intervals.

Scores are exact integers: components become floor(scale * x); products run in floating point only
while every partial sum stays within its exact range, else in 64-bit integers, and where these
might not do, in integers of any size.

Defined results: vectors that are null or hold null or non-finite components take no part, as
queries or candidates; empty vectors score 0; vectors of different lengths are compared only with
their own length; a query is not its own candidate (by id); rows that repeat an id are candidates
each, and of a repeated query id the smallest vector is the query; fewer candidates than k give them
all; a component or a score that doesn't fit 63 or 64 bits is an error. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._bytes import U64
from ._runtime import lean, written

_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_SLACK = 1 + 1e-9
#: Histograms that a task holds at a time; older ones are handed on.
HELD = 32


def quantised(rows: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    x = F.col("v")
    clean = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    usable = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = lambda c: F.when(F.abs(c * scale) < 2.0**62, F.floor(c * F.lit(float(scale)))).otherwise(F.raise_error(F.lit("a component doesn't fit 63 bits")).cast("long"))
    return clean.where(F.col("vec_id").isNotNull() & usable).select("vec_id", F.transform("v", whole).alias("v"))


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(x.astype(np.float64)).sum(axis=1)) * _SLACK


def _narrow(x: np.ndarray) -> bytes:
    """The numbers in as few bytes as hold all of them."""
    most = max(-int(x.min(initial=0)) - 1, int(x.max(initial=0)))
    return x.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8").tobytes()


def _wide(data: bytes, n: int, size: int) -> np.ndarray:
    each = len(data) // max(1, n * size)
    return np.frombuffer(data, f"<i{each}").reshape(n, size) if each else np.zeros((n, size), np.int64)


def _blocks(batches: Iterable[pa.RecordBatch], block: int, most: float | None) -> Iterator[pa.RecordBatch]:
    """Rows packed by vector length: block, size, ids, data, norm (the largest); for queries (``most`` given) also low, high, open."""
    number = TaskContext.get().partitionId() << 32
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def out(size: int) -> Iterator[pa.RecordBatch]:
        nonlocal number
        parts = held.pop(size)
        ids, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        for k in range(0, len(ids), block):
            own, norms = x[k : k + block], _norms(x[k : k + block])
            row = [[number], [size], [ids[k : k + block].tobytes()], [_narrow(own)], [float(norms.max(initial=0))]]
            names = ["block", "size", "ids", "data", "norm"]
            if most is not None:
                bound = norms * most + 1
                high = np.where(bound < 2.0**62, bound, 0).astype(np.int64)
                far = bound >= 2.0**62
                row += [[np.where(far, _LEAST, -high).tobytes()], [np.where(far, _MOST, high).tobytes()], [True]]
                names += ["low", "high", "open"]
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, _TYPES, strict=False)], names=names)

    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        lists = batch.column(1)
        sizes = np.asarray(lists.value_lengths())
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            held.setdefault(size, []).append((ids[own], flat[starts[own][:, None] + np.arange(size)].astype(np.int64).reshape(len(own), size)))
            if sum(len(p[0]) for p in held[size]) >= block:
                yield from out(size)
    for size in list(held):
        yield from out(size)


_BLOCK = "block long, size int, ids binary, data binary, norm double"
_QUERIES = f"{_BLOCK}, low binary, high binary, open boolean"
_TYPES = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.float64(), pa.binary(), pa.binary(), pa.bool_())


def _dots(q: np.ndarray, x: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Scores; those of a query with itself (``own``) needn't fit."""
    most = float(_norms(q).max(initial=0)) * float(_norms(x).max(initial=0))  # no partial sum exceeds this
    if most >= 2.0**62:
        exact = q.astype(object) @ x.T.astype(object)
        exact[own] = 0
        if exact.size and not _LEAST <= exact.min() <= exact.max() <= _MOST:
            raise OverflowError("a score doesn't fit 64 bits")
        return exact.astype(np.int64)
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    return (q.astype(kind) @ x.T.astype(kind)).astype(np.int64)


def _tiles(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(the pair's row, query ids, candidate ids, scores, whether they are of different ids) of pairs of blocks of equal vector length."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = {n: batch.column(i)[k].as_py() for i, n in enumerate(batch.schema.names)}
            if row["size"] == row["q_size"]:
                ids, q_ids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["q_ids"], np.int64)
                own = q_ids[:, None] == ids[None, :]
                yield row, q_ids, ids, _dots(_wide(row["q_data"], len(q_ids), row["size"]), _wide(row["data"], len(ids), row["size"]), own), ~own


def _widths(low: np.ndarray, high: np.ndarray, bins: int) -> np.ndarray:
    return (high.view(np.uint64) - low.view(np.uint64)) // U64(bins) + U64(1)


def _histogram(batches: Iterable[pa.RecordBatch], k: int, bins: int) -> Iterator[pa.RecordBatch]:
    """block, q, bin, n: counts of scores in ``bins`` bins from each query's low on, those above its high in one more, from the top down to the kth score seen here."""
    held: dict[int, np.ndarray] = {}

    def out(block: int) -> pa.RecordBatch:
        counts = held.pop(block)
        above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts  # in higher bins
        q, bin_ = np.nonzero((counts > 0) & (above < k))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(q), block)), pa.array(q.astype(np.int32)), pa.array(bin_.astype(np.int32)), pa.array(counts[q, bin_].astype(np.int64))], names=["block", "q", "bin", "n"])

    for row, _, _, scores, other in _tiles(batches):
        low, high = np.frombuffer(row["low"], np.int64), np.frombuffer(row["high"], np.int64)
        width = _widths(low, high, bins)
        slot = np.minimum((scores.view(np.uint64) - low.view(np.uint64)[:, None]) // width[:, None], U64(bins)).astype(np.int64)
        slot += np.arange(len(low))[:, None] * (bins + 1)
        slot = slot[(scores >= low[:, None]) & other]
        counts = np.bincount(slot, minlength=len(low) * (bins + 1)).reshape(len(low), bins + 1)
        if row["q_block"] in held:
            held[row["q_block"]] += counts
        else:
            if len(held) == HELD:
                yield out(next(iter(held)))
            held[row["q_block"]] = counts
    for block in list(held):
        yield out(block)


def _narrowed(batches: Iterable[pa.RecordBatch], k: int, bins: int) -> Iterator[pa.RecordBatch]:
    """Blocks of queries with their intervals cut to the bin of the kth score; fewer than k candidates leave the lowest value."""
    for batch in batches:
        for row in batch.to_pylist():
            low, high = np.frombuffer(row["low"], np.int64), np.frombuffer(row["high"], np.int64)
            if row["open"]:
                counts = np.zeros((len(low), bins + 1), np.int64)
                for found in row["counts"] or []:
                    counts[found["q"], found["bin"]] = found["n"]
                enough = np.cumsum(counts[:, ::-1], axis=1) >= k  # from the top bin down
                some = enough.any(axis=1)
                slot = np.where(some, bins - np.argmax(enough, axis=1), 0).astype(np.uint64)
                width, span = _widths(low, high, bins), high.view(np.uint64) - low.view(np.uint64)
                first = slot * width
                last = np.minimum(span, first + (width - U64(1)))
                low, high = (low.view(np.uint64) + first).view(np.int64), (low.view(np.uint64) + last).view(np.int64)
                low, high = np.where(some, low, _LEAST), np.where(some, high, _LEAST)
            values = [row[n] for n in ("block", "size", "ids", "data", "norm")] + [low.tobytes(), high.tobytes(), bool((low < high).any())]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _TYPES, strict=True)], names=["block", "size", "ids", "data", "norm", "low", "high", "open"])


def _winners(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Candidates above the kth score, and of those equal to it the k smallest ids of each tile."""
    for row, q_ids, ids, scores, other in _tiles(batches):
        order = np.argsort(ids, kind="stable")
        ids, scores, other = ids[order], scores[:, order], other[:, order]
        level = np.frombuffer(row["low"], np.int64)[:, None]
        ties = (scores == level) & other
        ties &= np.cumsum(ties, axis=1) <= k
        q, c = np.nonzero(((scores > level) & other) | ties)
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[q]), pa.array(ids[c]), pa.array(scores[q, c])], names=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, vec_id: str = "vec_id", vector: str = "embedding", bins: int = 256, query_block: int = 1024, block: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every row where ``is_query`` (on vec_id) holds."""
    usable = quantised(vectors, vec_id, vector, scale)
    candidates = written(usable.mapInArrow(lambda it: lean(_blocks(it, block, None)), _BLOCK), "vectors").select("size", "ids", "data", "norm")
    most = candidates.agg(F.max("norm")).head()[0] or 0.0
    own = usable.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    parts = max(1, -(-usable.where(is_query).count() // query_block))
    queries = written(own.repartition(parts, "vec_id").mapInArrow(lambda it: lean(_blocks(it, query_block, most)), _QUERIES), "queries")

    def tiles(columns: list[str], of: DataFrame) -> DataFrame:
        return candidates.drop("norm").crossJoin(of.select(*[F.col(c).alias(f"q_{c}") for c in ("block", "size", "ids", "data")], *columns))  # blocks of the query set against blocks of all rows

    while not queries.where("open").isEmpty():
        counts = tiles(["low", "high"], queries.where("open")).mapInArrow(lambda it: lean(_histogram(it, k, bins)), "block long, q int, bin int, n long")
        counts = counts.groupBy("block", "q", "bin").agg(F.sum("n").alias("n")).groupBy("block").agg(F.collect_list(F.struct("q", "bin", "n")).alias("counts"))  # query_block * (bins + 1) at most
        queries = written(queries.join(counts, "block", "left").mapInArrow(lambda it: lean(_narrowed(it, k, bins)), _QUERIES), "queries")
    found = tiles(["low"], queries).mapInArrow(lambda it: lean(_winners(it, k)), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
