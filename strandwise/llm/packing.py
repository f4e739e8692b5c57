"""Best-fit packing by hierarchical residual merging.

Every partition packs its own pieces best-fit into sequences as it tokenises them. Nearly full
sequences are final; the pieces of all others go on to a tree of merge rounds: each round deals those
of several partitions to one and packs them best-fit; nearly full results are final, the pieces of the
others go on again, and the last round's results are all final.
A merge round doesn't see pieces but their run lengths, how many of each size each partition sends: at
most ``capacity`` rows a partition, however many pieces go on. It answers with intervals: which of a
partition's pieces of a size (by rank) go to which sequences. Pieces find theirs by joins.

Defined results: null text is empty, a document of just the end id; only pieces longer than the
capacity are cut; repeated rows are packed once each, told apart by nothing but their place; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import lean, written
from ._tokens import crc32, pieces, tokenizer


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: (bin, offset) of each item, and the fill of each bin. Ties go by position."""
    place, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    fill: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            bin_ = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            bin_, room = len(fill), capacity
            fill.append(0)
        place[i], offset[i] = bin_, fill[bin_]
        fill[bin_] += size
        room -= size
        if room:
            by_room[room].append(bin_)
            rooms |= 1 << room
    return place, offset, np.array(fill, np.int64)


def best_fit_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, list[tuple[int, int, int, int]]]]:
    """Best-fit decreasing over ``counts`` items of each size, as runs of like bins: (bins, fill, contents).

    An item of contents, (size, each, first, offset), says that bin k of the run holds ``each`` items of a size from
    rank first + k * each on, one after the other from ``offset``. There are at most a few runs a size.
    """
    by_room: dict[int, list[tuple[int, list[tuple[int, int, int, int]]]]] = {}

    def put(room: int, bins: int, contents: list[tuple[int, int, int, int]]) -> None:
        if bins:
            by_room.setdefault(room, []).append((bins, contents))

    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            room = min((r for r in by_room if r >= size), default=capacity)
            each = room // size  # the bin just used is the tightest until it is full
            if room in by_room:
                bins, contents = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
            else:
                bins, contents = max(1, left // each), []
            # as many bins as can be filled with items of this size, else one bin with what is left
            used, each = (min(bins, left // each), each) if left >= each else (1, left)
            put(room - each * size, used, [*contents, (size, each, rank, capacity - room)])
            put(room, bins - used, [(s, e, first + used * e, at) for s, e, first, at in contents])
            left, rank = left - used * each, rank + used * each
    return [(bins, capacity - room, contents) for room, runs in by_room.items() for bins, contents in runs]


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, at long, rank long, goes_on boolean"
_MOVED = "part long, size long, low long, high long, goes_on boolean, node long, shift long, bin long, each long, at long"


def _pack_documents(batches: Iterable[pa.RecordBatch], path: str, end_id: int, capacity: int, slack: int, buffer: int) -> Iterator[pa.RecordBatch]:
    own = tokenizer(path)
    base = TaskContext.get().partitionId() << 32
    rows: list[tuple[int | None, int, int, int, int]] = []
    bins, sent = 0, np.zeros(capacity + 1, np.int64)

    def out() -> pa.RecordBatch:
        nonlocal bins
        columns = list(zip(*rows, strict=True))
        sizes = np.array(columns[3], np.int64)
        place, offset, fill = best_fit(sizes, capacity)
        on = fill[place] < capacity - slack
        rank = np.zeros(len(sizes), np.int64)  # among the pieces of its size that this partition sends on
        by = np.flatnonzero(on)[np.argsort(sizes[on], kind="stable")]
        size, first, number = np.unique(sizes[by], return_index=True, return_counts=True)
        rank[by] = np.arange(len(by)) - np.repeat(first - sent[size], number)
        sent[size] += number
        arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
        batch = pa.RecordBatch.from_arrays([*arrays, pa.array(base + bins + place), pa.array(offset), pa.array(rank), pa.array(on)], names=["doc_id", "piece", "start", "length", "ids_crc32", "bin", "at", "rank", "goes_on"])
        bins += len(fill)
        rows.clear()
        return batch

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for number, (start, ids) in enumerate(pieces(own.ids(text.as_py()), end_id, capacity)):
                rows.append((doc_id, number, start, len(ids), crc32(ids)))
            if len(rows) >= buffer:
                yield out()
    if rows:
        yield out()


def _merge(batches: Iterable[pa.RecordBatch], level: int, last: bool, capacity: int, slack: int) -> Iterator[pa.RecordBatch]:
    """Of runs (part, size, n): where each part's pieces of a size go, by intervals of their ranks."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    runs = pa.Table.from_batches(held).sort_by([("size", "ascending"), ("part", "ascending")]).to_pylist()
    node = (level << 24) + TaskContext.get().partitionId()
    counts: Counter[int] = Counter()
    for r in runs:
        r["first"] = counts[r["size"]]
        counts[r["size"]] += r["n"]
    made: dict[int, list[tuple[int, int, bool, int, int, int, int]]] = defaultdict(list)  # by size, over the ranks of all parts
    bin_, going = node << 32, Counter()
    for bins, fill, contents in best_fit_runs(counts, capacity):
        on = not last and fill < capacity - slack
        for size, each, first, at in contents:
            made[size].append((first, first + bins * each, on, going[size] - first if on else -first, bin_, each, at))
            if on:
                going[size] += bins * each
        bin_ += 0 if on else bins
    out = []
    for size, intervals in made.items():
        intervals.sort()
        own, k = [r for r in runs if r["size"] == size], 0
        for low, high, on, shift, to, each, at in intervals:
            while k < len(own):
                r = own[k]
                a, b = max(low, r["first"]), min(high, r["first"] + r["n"])
                if a < b:
                    out.append((r["part"], size, a - r["first"], b - r["first"], on, node, shift + r["first"], to, each, at))
                if r["first"] + r["n"] > high:
                    break
                k += 1
    names = ["part", "size", "low", "high", "goes_on", "node", "shift", "bin", "each", "at"]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if n == "goes_on" else pa.int64()) for n, c in zip(names, zip(*out, strict=True), strict=True)], names=names)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 1024, doc_id: str = "doc_id", text: str = "text", slack: int = 8, fan_in: int = 8, buffer: int = 50_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.

    ``slack``: room below which a sequence is final; ``fan_in``: partitions whose pieces meet in one of
    the next round; ``buffer``: pieces that a partition packs at a time (bounds its memory).
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    placed = written(own.mapInArrow(lambda it: lean(_pack_documents(it, tokenizer_path, end_id, capacity, slack, buffer)), _PIECE), "pieces")
    piece = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ready = placed.where("not goes_on").select(*piece, F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    open_ = placed.where("goes_on").select(*piece, F.expr("shiftright(bin, 32)").alias("part"), "rank", F.lit(None).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    runs = open_.groupBy("part", F.col("length").alias("size")).agg(F.count("*").alias("n"))
    parts = placed.agg(F.countDistinct(F.expr("shiftright(bin, 32)"))).head()[0]
    level = 0
    while parts > 1 or (parts and not level):
        level += 1
        parts = -(-parts // fan_in)
        dealt = runs.repartition(parts, F.pmod(F.xxhash64("part"), F.lit(parts)))
        merged = written(dealt.mapInArrow(lambda it, level=level, last=parts == 1: lean(_merge(it, level, last, capacity, slack)), _MOVED), f"merge{level}")
        moved = merged.select(*[F.col(c).alias(f"to_{c}") for c in merged.columns])
        on = (F.col("part") == F.col("to_part")) & (F.col("length") == F.col("to_size")) & (F.col("rank") >= F.col("to_low")) & (F.col("rank") < F.col("to_high"))
        place = F.col("rank") + F.col("to_shift")  # among those that go on, or that fill the sequences from to_bin on
        final = ~F.col("to_goes_on")
        open_ = open_.join(moved, on, "left").select(
            *piece,
            # placed ones have parts of their own, which match no run
            F.when(F.col("to_goes_on"), F.col("to_node")).otherwise(-1 - F.col("rank")).alias("part"),
            F.when(F.col("to_goes_on"), place).otherwise(F.col("rank")).alias("rank"),
            F.when(final, F.col("to_bin") + F.expr("(rank + to_shift) div to_each")).otherwise(F.col("sequence_id")).alias("sequence_id"),
            F.when(final, F.col("to_at") + F.pmod(place, F.col("to_each")) * F.col("length")).otherwise(F.col("offset")).alias("offset"),
        )
        runs = merged.where("goes_on").groupBy(F.col("node").alias("part"), "size").agg(F.sum(F.col("high") - F.col("low")).alias("n"))
    return ready.unionByName(open_.select(ready.columns))
