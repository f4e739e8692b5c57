"""k-mers of reads: windows, counts on both strands, inverted index."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.functions.sequence import canonical, gc_count, is_own_reverse_complement, packed_kmer, reverse_complement

#: k up to which a k-mer's base-4 number and three marks fit 64 bits.
MAX_PACKED_K = 30
#: Windows whose numbers a task holds before it counts them.
HELD_WINDOWS = 1 << 22
_BASES = np.full(256, 4, np.uint8)
_BASES[np.frombuffer(b"ACGT", np.uint8)] = range(4)
_TURN = str.maketrans("ACGTacgt", "TGCAtgca")
#: What each of the eight combinations of marks (1: the reverse complement is the smaller, 2: last window, 4: first window) adds.
_MARKS = np.arange(8)
_SUMS = {
    "cnt": _MARKS >= 0,
    "inner": _MARKS & 2 == 0,
    "inner_own": _MARKS & 3 == 0,
    "smaller": np.where(_MARKS & 1, _MARKS & 4, _MARKS & 2) == 0,
    "larger": np.where(_MARKS & 1, _MARKS & 2, _MARKS & 4) == 0,
}


def windows(reads: DataFrame, k: int | Iterable[int], drop_last: bool = False, seq: str = "seq", keep: Iterable[str] = (), with_canonical: bool = False) -> DataFrame:
    """One row per window: the columns ``keep``, k, pos (from 0) and kmer.

    Several k come from one scan. Reads shorter than k (or of just k, if the last window is
    dropped) give no row. ``with_canonical`` adds canonical, cut from the read's reverse
    complement, and last (whether it is the read's last window).
    """
    ks = [k] if isinstance(k, int) else sorted(set(k))
    base = reads.select(*keep, F.col(seq).alias("_s"), *([reverse_complement(F.col(seq)).alias("_r")] if with_canonical else []))
    base = base.withColumn("k", F.lit(ks[0])) if len(ks) == 1 else base.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    ends = F.length("_s") - F.col("k") - (1 if drop_last else 0)
    # positions are exploded, not k-mers: cutting them stays in generated code
    spread = base.where(ends >= 0).select("*", F.explode(F.sequence(F.lit(0), ends)).alias("pos"))
    kmer = F.substring("_s", F.col("pos") + 1, F.col("k"))
    more = []
    if with_canonical:
        end = F.length("_s") - F.col("k") - F.col("pos")
        more = [F.least(kmer, F.substring("_r", end + 1, F.col("k"))).alias("canonical"), (end == 0).alias("last")]
    return spread.select(*keep, "k", "pos", kmer.alias("kmer"), *more)


def _numbers(bases: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Base-4 numbers of the k bases from each place on, and of their reverse complements."""
    own, turned, size = bases.astype(np.uint64), 3 - bases.astype(np.uint64), 1
    out: tuple[np.ndarray, np.ndarray] | None = None
    done = 0
    while True:
        if k & size:  # what is there is followed by these bases
            n = len(bases) - done - size + 1
            if out is None:
                out = own[:n], turned[:n]
            else:
                out = (out[0][:n] << np.uint64(2 * size)) | own[done : done + n], out[1][:n] | (turned[done : done + n] << np.uint64(2 * done))
            done += size
        if done == k:
            return out
        n = max(0, len(own) - size)
        own, turned = (own[:n] << np.uint64(2 * size)) | own[size : size + n], turned[:n] | (turned[size : size + n] << np.uint64(2 * size))
        size *= 2


def window_codes(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, str, int]]]:
    """Windows of a column of sequences: the number of the smaller k-mer of both strands, times 8, with the marks of ``_MARKS``, its row and
    place; and (row, place, smaller k-mer, marks) of those with other characters than A, C, G and T. Null is an empty sequence."""
    values = texts.cast(pa.string()).fill_null("")
    bounds = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int32)
    data = values.buffers()[2] if len(values) else None
    text = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    bases, begin, length = _BASES[text], (bounds[:-1] - bounds[0]).astype(np.int64), np.diff(bounds).astype(np.int64)
    odd = np.concatenate([[0], np.cumsum(bases == 4)])
    is_odd = odd[begin + length] > odd[begin]
    row = np.repeat(np.arange(len(values)), length)
    place = np.arange(len(text)) - begin[row]
    left = length[row] - place  # characters from a place on
    own, turned = _numbers(bases & 3, k) if k <= len(text) else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    at = np.flatnonzero(~is_odd[row[: len(own)]] & (left[: len(own)] >= k))
    own, turned = own[at], turned[at]
    marks = (turned < own) | ((left[at] == k).astype(np.uint8) << 1) | ((place[at] == 0).astype(np.uint8) << 2)
    found = [((np.minimum(own, turned) << np.uint64(3)) | marks.astype(np.uint64), row[at], place[at])]
    others = []
    for n in map(int, np.flatnonzero(is_odd)):
        seq = values[n].as_py()
        for j in range(len(seq) - k + 1):
            kmer = seq[j : j + k]
            other = kmer.translate(_TURN)[::-1]
            mark = (other < kmer) | (2 * (j == len(seq) - k)) | (4 * (j == 0))
            small = min(kmer, other)
            if small.strip("ACGT"):
                others.append((n, j, small, mark))
            else:
                code = int(small.translate(str.maketrans("ACGT", "0123")), 4)
                found.append((np.array([code << 3 | mark], np.uint64), np.array([n]), np.array([j])))
    return *(np.concatenate(x) for x in zip(*found, strict=True)), others


def _counted_windows(batches: Iterable[pa.RecordBatch], ks: list[int], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows (k, code, text, sums) of a column of sequences: the smaller k-mer of both strands as its number, or as text where it
    has other characters than A, C, G and T, with the sums (of ``_SUMS``) over windows that were held together."""
    weights = np.stack([_SUMS[name] for name in names], axis=1).astype(np.int64)

    def rows(k: int, codes: np.ndarray, marks: np.ndarray, counts: np.ndarray, texts: list[str] | None = None) -> pa.RecordBatch:
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
        sums = np.add.reduceat(counts[:, None] * weights[marks], first, axis=0) if len(codes) else np.zeros((0, len(names)), np.int64)
        n = len(first)
        key = [pa.array(codes[first].astype(np.int64)), pa.nulls(n, pa.string())] if texts is None else [pa.nulls(n, pa.int64()), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, k, np.int32)), *key, *[pa.array(sums[:, j]) for j in range(len(names))]], names=["k", "code", "text", *names])

    held: dict[int, list[np.ndarray]] = {k: [] for k in ks}
    others: dict[tuple[int, str, int], int] = {}

    def counted() -> Iterator[pa.RecordBatch]:
        for k in ks:
            if held[k]:
                keys, counts = np.unique(np.concatenate(held[k]), return_counts=True)
                held[k].clear()
                yield rows(k, keys >> np.uint64(3), (keys & np.uint64(7)).astype(np.int64), counts)
        for (k, text, mark), n in others.items():
            yield rows(k, np.zeros(1, np.uint64), np.array([mark]), np.array([n]), [text])
        others.clear()

    size = 0
    for batch in batches:
        for k in ks:
            keys, *_, odd = window_codes(batch.column(0), k)
            held[k].append(keys)
            for _, _, text, mark in odd:
                others[k, text, mark] = others.get((k, text, mark), 0) + 1
            size += len(keys) + len(odd)
        if size >= HELD_WINDOWS:
            yield from counted()
            size = 0
    yield from counted()


def _packed_sums(reads: DataFrame, ks: list[int], names: list[str], tasks: int, seq: str, genome: DataFrame | None = None) -> DataFrame:
    """k, code and text (the smaller of both strands) and sums of its windows, counted in the tasks of ``reads`` first and then, as numbers, in ``tasks`` tasks."""
    if max(ks) > MAX_PACKED_K:
        raise ValueError(f"k-mers of more than {MAX_PACKED_K} bases have no number")

    def windows_of(rows: DataFrame, column: str, names: list[str]) -> DataFrame:
        return rows.select(column).mapInArrow(lambda batches: _counted_windows(batches, ks, names), "k int, code long, text string, " + ", ".join(f"{n} long" for n in names))

    rows, none = windows_of(reads, seq, names), F.lit(0).cast("long")
    if genome is not None:
        there = windows_of(genome, "seq", ["cnt"]).select("k", "code", "text", *[none.alias(n) for n in names], F.col("cnt").alias("in_genome"))
        rows, names = rows.withColumn("in_genome", none).unionByName(there), [*names, "in_genome"]
    found = rows.repartition(tasks, "code", "text").groupBy(*(["k"] if len(ks) > 1 else []), "code", "text").agg(*[F.sum(n).alias(n) for n in names])
    return found.select((F.col("k") if len(ks) > 1 else F.lit(ks[0])).alias("k"), "code", "text", *names)


def coded_kmer(ks: Iterable[int]) -> Column:
    """The k-mer of rows (k, one of ``ks``, code, text): what its number stands for, or its text, where it has none (null or below 0)."""
    ks = sorted(set(ks))
    kmer = packed_kmer(F.col("code"), ks[-1])
    return F.when(F.col("code") >= 0, kmer if len(ks) == 1 else F.substring(kmer, ks[-1] + 1 - F.col("k"), F.col("k"))).otherwise(F.col("text"))


def coded_gc(code: str = "code", text: str | None = "text") -> Column:
    """Number of G and C of a coded k-mer: C is 1 and G is 2, so that the two bits of a base differ."""
    n = F.col(code)
    count = F.bit_count(n.bitwiseXOR(F.shiftright(n, 1)).bitwiseAND(0x1555555555555555))
    return count if text is None else F.coalesce(gc_count(F.col(text)), count)


def coded_counts(reads: DataFrame, ks: Iterable[int], tasks: int, seq: str = "seq") -> DataFrame:
    """What ``count_both_strands`` with ``with_seen`` counts, by k, code and text, with gc_count and inner_own (inner windows that are the smaller k-mer)."""
    rows = _packed_sums(reads, sorted(set(ks)), ["cnt", "inner", "inner_own"], tasks, seq)
    return rows.select("k", "code", "text", coded_gc().alias("gc_count"), "cnt", seen_of().alias("seen"), "inner", "inner_own")


def seen_of() -> Column:
    """How many of the two k-mers stand in the reads other than as a last window."""
    return (F.col("inner_own") > 0).cast("long") + (F.col("inner") > F.col("inner_own")).cast("long")


def count_both_strands(reads: DataFrame, k: int | Iterable[int], seq: str = "seq", with_seen: bool = False, genome: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """k, kmer (the smaller of it and its reverse complement), cnt: occurrences on both strands of all reads.

    A k-mer and its reverse complement have the same count, so one row stands for both; of a
    k-mer that is its own reverse complement both strands' occurrences are the same and count once.
    ``with_seen`` adds what reads hold other than as their last window: seen, how many of the two
    k-mers, and inner, how often either. With ``tasks`` k-mers (k up to ``MAX_PACKED_K``) are counted as numbers, in so many tasks
    whatever size Spark advises for them. ``genome`` (rows of seq) then adds in_genome, what is counted there, and rows of k-mers
    that occur there only, with cnt 0: both are counted in one table, not joined.
    """
    if tasks is not None:
        ks = [k] if isinstance(k, int) else sorted(set(k))
        rows = _packed_sums(reads, ks, ["cnt", *(["inner", "inner_own"] if with_seen else [])], tasks, seq, genome)
        return rows.select("k", coded_kmer(ks).alias("kmer"), "cnt", *([seen_of().alias("seen"), "inner"] if with_seen else []), *(["in_genome"] if genome is not None else []))
    if genome is not None:
        raise ValueError("a genome is counted with the reads in a given number of tasks")
    found = windows(reads, k, seq=seq, with_canonical=True)
    seen = []
    if with_seen:
        as_is = F.col("kmer") == F.col("canonical")
        has = lambda on: F.max(F.when(on & ~F.col("last"), 1).otherwise(0))
        seen = [(has(as_is) + has(~as_is)).alias("seen"), F.count_if(~F.col("last")).alias("inner")]
    return found.groupBy("k", F.col("canonical").alias("kmer")).agg(F.count("*").alias("cnt"), *seen)


def count_strands(reads: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """kmer, cnt for k-mers as they stand in the reads and in their reverse complements, one row each."""
    both = reads.select(F.explode(F.array(F.col(seq), reverse_complement(F.col(seq)))).alias("seq"))
    return windows(both, k).groupBy("kmer").agg(F.count("*").alias("cnt"))


def count_naive(reads: DataFrame, k: int, reverse_complements: bool = True, drop_last: bool = True, halve_always: bool = False, seq: str = "seq", tasks: int | None = None) -> DataFrame:
    """kmer, cnt over windows without each sequence's last one; own reverse complements are halved.

    They are halved only where reverse complements were counted, or always (``halve_always``). With ``tasks``, as in
    ``count_both_strands``, windows of reverse complements are not made: the reads' own ones, turned, stand for them.
    """
    halved = F.when(is_own_reverse_complement(F.col("kmer")), F.expr("cnt div 2")).otherwise(F.col("cnt")).alias("cnt")
    if tasks is not None and reverse_complements and drop_last:
        counted, kmer = _packed_sums(reads, [k], ["smaller", "larger"], tasks, seq).withColumn("kmer", coded_kmer([k])), F.col("kmer")
        row = lambda kmer, cnt: F.struct(kmer.alias("kmer"), cnt.alias("cnt"))
        both, smaller, larger = F.col("smaller") + F.col("larger"), row(kmer, F.col("smaller")), row(reverse_complement(kmer), F.col("larger"))
        rows = F.when(kmer == reverse_complement(kmer), F.array(row(kmer, both))).otherwise(F.array(smaller, larger))
        return counted.select(F.inline(rows)).where("cnt > 0").select("kmer", halved)
    own = reads.select(F.explode(F.array(F.col(seq), reverse_complement(F.col(seq)))).alias("seq")) if reverse_complements else reads.select(F.col(seq).alias("seq"))
    counted = windows(own, k, drop_last).groupBy("kmer").agg(F.count("*").alias("cnt"))
    if not (reverse_complements or halve_always):
        return counted
    return counted.select("kmer", halved)


def inverted_index(reads: DataFrame, k: int, read_id: str = "rid", empty_if_repeated: bool = False, seq: str = "seq", block: int = 4096) -> DataFrame:
    """kmer (smaller of both strands), block, read_ids: the reads with it, in order, a read as often as it has it.

    A k-mer's list is cut into blocks of ``block`` consecutive read ids, so that none grows with the number of reads: a row
    holds no more than ``block`` times the windows of a read. With ``empty_if_repeated`` all lists of a k-mer are empty where
    some read has it more than once.
    """
    own = windows(reads, k, seq=seq, keep=[read_id], with_canonical=True).select(F.col("canonical").alias("kmer"), F.col(read_id).alias("_rid"))
    # one shuffle by k-mer serves the counts by read, the blocks and the window over a k-mer's blocks
    by_kmer = own.repartition("kmer").withColumn("block", F.expr(f"_rid div {block}"))
    # a read's repeats of a k-mer are one row before the lists are made
    by_read = by_kmer.groupBy("kmer", "block", "_rid").agg(F.count("*").alias("_n"))
    ids = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_rid", "_n"))), lambda x: F.array_repeat(x["_rid"], x["_n"].cast("int"))))
    found = by_read.groupBy("kmer", "block").agg(ids.alias("read_ids"), F.max("_n").alias("_n"))
    if not empty_if_repeated:
        return found.drop("_n")
    repeated = F.max("_n").over(Window.partitionBy("kmer")) > 1
    return found.select("kmer", "block", F.when(repeated, F.slice("read_ids", 1, 0)).otherwise(F.col("read_ids")).alias("read_ids"))


def look_up(rows: DataFrame, counts: DataFrame, kmer: Column | str = "kmer", is_canonical: bool = False) -> DataFrame:
    """Rows with the count of their k-mer (0 where it doesn't occur) as cnt and the counts' other columns; both sides have k.

    Rows are shuffled as they are: those that hold the canonical k-mer alone (``is_canonical``) send it once.
    """
    key = F.col(kmer) if isinstance(kmer, str) else kmer
    others = [c for c in counts.columns if c not in ("k", "kmer")]
    counts = counts.select(F.col("k").alias("_k"), F.col("kmer").alias("_kmer"), *others)
    if not is_canonical:
        rows, key = rows.withColumn("_canonical", canonical(key)), F.col("_canonical")
    joined = rows.join(counts, (F.col("k") == F.col("_k")) & (key == F.col("_kmer")), "left")
    return joined.withColumn("cnt", F.coalesce("cnt", F.lit(0))).drop("_k", "_kmer", "_canonical")


def read_lengths(reads: DataFrame, seq: str = "seq") -> DataFrame:
    """len, n: how many reads have each length."""
    return reads.groupBy(F.length(seq).alias("len")).agg(F.count("*").alias("n"))


def distinct_kmers(reads: DataFrame, k: int, drop_last: bool = True, approximate: bool = False, seq: str = "seq") -> DataFrame:
    """kmer of each distinct window; with ``approximate`` one row, n, their estimated number (HyperLogLog++)."""
    found = windows(reads, k, drop_last, seq)
    return found.agg(F.approx_count_distinct("kmer").alias("n")) if approximate else found.select("kmer").distinct()


def read_kmer_table(reads: DataFrame, k: int, read_id: str = "rid", drop_last: bool = True) -> DataFrame:
    """read_id, k, pos, kmer of all reads, each read's last window left out unless asked for."""
    return windows(reads, k, drop_last, keep=[read_id])
