"""Language-model scoring by prediction by partial matching (PPM).

Training counts byte (order + 1)-grams over all training texts, A-Z lower-cased, each text closed by
an end symbol; shorter contexts are their sums. Together they are the byte-context trie. A context
with n observations of u distinct symbols gives a symbol seen c times (c - 1/2) / n and escapes with
u / 2n; after an escape the next shorter context predicts with the symbols already seen excluded
(method D with symbol exclusion), down to a uniform choice of all that remain.

The trie holds every context of the training text and stays distributed, as a table: a row for each
gram of each length (the probability of its last byte after the others) and one for each context (the
factor of an escape from it). As training ends before scoring, a symbol that its longest context has
seen takes one look-up. The most frequent longest grams, at most ``frequent_grams`` of them, are looked
up in a broadcast table, all others by a join; grams that training never saw walk down the trie by a
join with the rows of their shorter grams and contexts. Where a gram is looked up doesn't change its
probability.

The base score is a smoothed unigram model of words. Word counts stay distributed; the most frequent
words, at most ``frequent`` of them, are looked up in a broadcast table, all others by a join.

Defined results: null text is the empty text, which still has its end token; with no training
rows the byte model is uniform over 257 symbols; repeated rows get the same answer and count as
often as they appear; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._bytes import LOWER, U64, Hashes, chunks, parts, signed, sums_by_doc
from ._runtime import lean, written

#: The end symbol; 0xFF is no byte of UTF-8.
END = 0xFF
SYMBOLS = 257


def _joined(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts, each after ``order`` end symbols and closed by one; positions of their first bytes."""
    n = len(offsets) - 1
    out = np.full(len(data) + n * (order + 1), END, np.uint8)
    begin = offsets[:-1] + np.arange(n) * (order + 1) + order
    if n == 1:
        out[order : order + len(data)] = LOWER[data]
        return out, begin
    place = np.arange(len(data)) + np.repeat(begin - offsets[:-1], np.diff(offsets))
    out[place] = LOWER[data]
    return out, begin


def _grams(data: np.ndarray, offsets: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """Longest gram that ends at each position to predict, text by text; of a long text part by part."""
    joined, begin = _joined(data, offsets, order)
    if len(begin) == 1:
        for a, b in parts(len(data) + 1):
            yield _codes(joined[a : b + order], order + 1)
    else:
        yield _codes(joined, order + 1)[_targets(len(joined), begin, offsets) - order]


def _codes(data: np.ndarray, n: int) -> np.ndarray:
    """n-gram ending at each position from n - 1 on, its bytes as one number."""
    code = np.zeros(len(data) - n + 1, np.uint64)
    for k in range(n):
        code <<= U64(8)
        code |= data[k : len(data) - n + 1 + k]
    return code


def _targets(length: int, begin: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions to predict: each text's bytes and its end."""
    sizes = np.diff(offsets) + 1
    shift = begin - np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return np.arange(int(sizes.sum())) + np.repeat(shift, sizes)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _tally(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


class _Counter:
    """Sums counts of keys in bounded memory: what exceeds ``limit`` keys after merging is handed out."""

    def __init__(self, kind: int, limit: int) -> None:
        self.kind, self.limit, self.parts, self.held = kind, limit, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((keys, counts))
        self.held += len(keys)
        if self.held > 2 * self.limit:
            merged = _merge(self.parts)
            self.parts, self.held = [merged], len(merged[0])
            if self.held > self.limit:
                yield from self.out()

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            keys, counts = _merge(self.parts)
            for k in range(0, len(keys), 1 << 16):
                part = slice(k, k + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[part]), self.kind, np.int32)), pa.array(signed(keys[part])), pa.array(counts[part].astype(np.int64))], names=["kind", "key", "n"])
        self.parts, self.held = [], 0


_GRAM, _WORD = 0, 1


def _bounded(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Chunks of a batch; copies of only some of its rows are held at a time."""
    for k in range(0, batch.num_rows, 1000):
        yield from chunks(batch.slice(k, 1000), "text")


def _gather(batches: Iterable[pa.RecordBatch], order: int, limit: int) -> Iterator[pa.RecordBatch]:
    grams, words = _Counter(_GRAM, limit), _Counter(_WORD, limit)
    for batch in batches:
        for _, data, offsets in _bounded(batch):
            for codes in _grams(data, offsets, order):
                yield from grams.add(*_tally(codes))
            yield from words.add(*_tally(Hashes(LOWER[data], offsets).h))
    yield from grams.out()
    yield from words.out()


_EMPTY = U64((1 << 64) - 1)


def _slot(codes: np.ndarray, mask: int) -> np.ndarray:
    h = codes * U64(0x9E3779B97F4A7C15)
    return ((h >> U64(32)).astype(np.int64)) & mask


def _hash_table(codes: np.ndarray, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Open addressing with steps of one: code k has the value first + k."""
    size = 1 << max(3, (4 * max(1, len(codes)) - 1).bit_length())
    keys, values = np.full(size, _EMPTY, np.uint64), np.full(size, -1, np.int32)
    pending, slot = np.arange(len(codes)), _slot(codes, size - 1)
    while len(pending):
        free = keys[slot] == _EMPTY
        keys[slot[free]], values[slot[free]] = codes[pending[free]], first + pending[free]
        lost = keys[slot] != codes[pending]
        pending, slot = pending[lost], (slot[lost] + 1) & (size - 1)
    return keys, values


def _trie(grams: DataFrame, order: int) -> DataFrame:
    """The trie's rows (size, key, n, log): of a gram, the bytes of its context, its own bytes, its count
    and the log10 probability of its last byte; of a context of k bytes, -1 - k, its bytes, its count and
    the log10 factor of an escape."""
    each = [F.struct(F.lit(size).alias("size"), (F.col("key") if size == order else F.expr(f"key & {(1 << 8 * (size + 1)) - 1}L")).alias("key")) for size in range(order + 1)]
    own = grams.select(F.explode(F.array(*each)).alias("gram"), "n").groupBy("gram.size", "gram.key").agg(F.sum("n").alias("n"))
    together = Window.partitionBy("size", "context")
    own = own.withColumn("context", F.expr("shiftrightunsigned(key, 8)"))
    own = own.withColumn("total", F.sum("n").over(together)).withColumn("distinct", F.count("*").over(together))
    own = written(own.withColumn("p", (F.col("n") - 0.5) / F.col("total")), "ppm-grams")
    # what a context has seen, its suffix has seen too
    suffix = own.select((F.col("size") + 1).alias("size"), F.col("key").alias("suffix"), F.col("p").alias("lower")).where(F.col("size") <= order)
    below = own.where("size > 0").withColumn("suffix", F.expr("key & (shiftleft(1L, 8 * size) - 1)")).join(suffix, ["size", "suffix"])
    columns = ["size", "context", "total", "distinct", "lower"]
    below = below.select(columns).unionByName(own.where("size = 0").withColumn("lower", F.lit(1.0 / SYMBOLS)).select(columns))
    contexts = below.groupBy("size", "context").agg(F.first("total").alias("n"), (0.5 * F.first("distinct") / F.first("total") / F.greatest(1.0 - F.sum("lower"), F.lit(1e-12))).alias("escape"))
    rows = own.select("size", "key", "n", F.log10("p").alias("log")).unionByName(contexts.select((-1 - F.col("size")).alias("size"), F.col("context").alias("key"), "n", F.log10("escape").alias("log")))
    return written(rows, "ppm-trie")


def _walked(unseen: DataFrame, trie: DataFrame, order: int) -> DataFrame:
    """(key, log) of longest grams (``key``) that training never saw: escapes down to the first context that has seen the symbol."""
    low = lambda column, size: F.expr(f"{column} & {(1 << 8 * size) - 1}L")
    steps = [F.struct(F.lit(size).alias("size"), low("key", size + 1).alias("part")) for size in range(order)]
    steps += [F.struct(F.lit(-1 - size).alias("size"), low("shiftrightunsigned(key, 8)", size).alias("part")) for size in range(order + 1)]
    rows = trie.select("size", F.col("key").alias("part"), "log")
    found = unseen.select("key", F.inline(F.array(*steps))).join(rows, ["size", "part"]).groupBy("key").agg(
        F.max(F.when(F.col("size") >= 0, F.struct("size", "log"))).alias("direct"),
        F.collect_list(F.when(F.col("size") < 0, F.struct((-1 - F.col("size")).alias("size"), "log"))).alias("escapes"),
    )
    escapes = F.expr("aggregate(filter(escapes, e -> e.size > coalesce(direct.size, -1)), 0D, (sum, e) -> sum + e.log)")
    uniform = F.lit(-math.log10(SYMBOLS))
    found = found.select("key", (escapes + F.coalesce("direct.log", uniform)).alias("log"))
    return unseen.select("key").join(found, "key", "left").select("key", F.coalesce("log", uniform).alias("log"))


class _Table:
    """Place of each key among the given ones."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, self.values = _hash_table(keys.view(np.uint64))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """-1 for a key that isn't held."""
        mask = len(self.keys) - 1
        slot = _slot(keys, mask)
        out = np.full(len(keys), -1, np.int64)
        pending = np.arange(len(keys))
        while len(pending):
            held, value = self.keys[slot], self.values[slot]
            hit = (held == keys[pending]) & (value >= 0)
            out[pending[hit]] = value[hit]
            on = ~hit & (value >= 0)
            pending, slot = pending[on], (slot[on] + 1) & mask
        return out


class GramTable(_Table):
    """log10 probabilities of the frequent grams."""

    def __init__(self, order: int, keys: np.ndarray, logs: np.ndarray) -> None:
        super().__init__(keys)
        self.order, self.logs = order, np.append(logs, 0.0)  # the last one is for grams that aren't held

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """Of each text of a chunk, its end included: the log10 probability of its frequent grams, and the others with their numbers."""
        bounds = np.concatenate([[0], np.cumsum(np.diff(offsets) + 1)])
        total, docs, keys, done = np.zeros(len(offsets) - 1), [], [], 0
        for code in _grams(data, offsets, self.order):
            at = self.find(code)
            total += sums_by_doc(self.logs[at], np.clip(bounds - done, 0, len(code)))
            far = np.flatnonzero(at < 0)
            docs.append(np.searchsorted(bounds, far + done, "right") - 1)
            keys.append(code[far])
            done += len(code)
        doc, key = np.concatenate(docs), np.concatenate(keys)
        by = np.lexsort((key, doc))
        doc, key = doc[by], key[by]
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])) if len(key) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(key)))
        pairs = pa.StructArray.from_arrays([pa.array(signed(key[first])), pa.array(times)], names=["key", "times"])
        return total, pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[first], np.arange(len(offsets))).astype(np.int32)), pairs)


class WordTable(_Table):
    """Counts of the frequent words by hash; total and distinct of all training tokens."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, total: int, distinct: int, end: int) -> None:
        super().__init__(keys)
        self.total, self.distinct, self.end, self.counts = total, distinct, end, np.append(counts, -1)

    def log10(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.total + 0.1 * (self.distinct + 1)))


_SCORED = "doc_id long, row long, n_tokens long, n_known long, base_score double, score double, far array<struct<key: long, times: long>>, rare array<long>"


def _score(batches: Iterable[pa.RecordBatch], grams: GramTable, words: WordTable) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 36
    for batch in batches:
        for rows, data, offsets in _bounded(batch):
            score, far = grams.scores(data, offsets)
            w = Hashes(LOWER[data], offsets)
            hashes = w.h
            count = words.counts[words.find(hashes)]
            known = count >= 0
            logs = np.zeros(len(count))
            logs[known] = words.log10(count[known])
            base = sums_by_doc(logs, w.bounds) + float(words.log10(np.array(words.end)))
            n_known = sums_by_doc(known, w.bounds) + (words.end > 0)
            rare = np.flatnonzero(~known)
            at = np.searchsorted(rare, w.bounds)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(signed(hashes[rare])))
            n = rows.num_rows
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(np.arange(row, row + n)), pa.array(w.per_doc + 1), pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(score), far, lists],
                names=["doc_id", "row", "n_tokens", "n_known", "base_score", "score", "far", "rare"],
            )
            row += n


def _rare_level(vocabulary: DataFrame, frequent: int) -> int:
    """A count that at most ``frequent`` words (or grams) exceed, from the number of words by octave of their count."""
    octaves = vocabulary.groupBy(F.floor(4 * F.log2("n")).alias("o")).agg(F.max("n").alias("most"), F.count("*").alias("words"))
    level, room = 0, frequent
    for r in sorted(octaves.collect(), key=lambda r: -r["o"]):  # 256 rows at most
        room -= r["words"]
        if room < 0:
            level = r["most"]
            break
    return level


def lm_score(docs: DataFrame, is_training: Column, doc_id: str = "doc_id", text: str = "text", order: int = 5, frequent_grams: int = 1 << 20, frequent: int = 1 << 17, limit: int = 1 << 20) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row; ``is_training`` is a condition on doc_id."""
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    training = own.where(is_training).select("text")
    partial = training.mapInArrow(lambda it: lean(_gather(it, order, limit)), "kind int, key long, n long")
    counts = written(partial.groupBy("kind", "key").agg(F.sum("n").alias("n")), "ppm-counts")
    trie = _trie(counts.where(F.col("kind") == _GRAM).select("key", "n"), order)
    longest = trie.where(F.col("size") == order).select("key", "n", "log")
    near = longest.where(F.col("n") > _rare_level(longest, frequent_grams)).toArrow()  # at most ``frequent_grams`` rows
    grams = GramTable(order, near["key"].to_numpy(), near["log"].to_numpy())
    vocabulary = counts.where(F.col("kind") == _WORD).select("key", "n")
    documents = training.count()
    tokens, distinct = vocabulary.agg(F.sum("n"), F.count("*")).head()
    total, distinct = (tokens or 0) + documents, distinct + (documents > 0)
    level = _rare_level(vocabulary, frequent)
    top = vocabulary.where(F.col("n") > level).toArrow()  # at most ``frequent`` rows
    words = WordTable(top["key"].to_numpy(), top["n"].to_numpy(), total, distinct, documents)
    shared = spark.sparkContext.broadcast((grams, words))
    scored = written(own.mapInArrow(lambda it: lean(_score(it, *shared.value)), _SCORED), "lm-scores")
    shared.unpersist()
    rare = scored.select("row", F.explode("rare").alias("key"))
    known = vocabulary.where(F.col("n") <= level)
    log10 = F.log10((F.coalesce(F.col("n"), F.lit(0)) + 0.1) / F.lit(total + 0.1 * (distinct + 1)))
    base = rare.join(known, "key", "left").select("row", log10.alias("base"), F.col("n").isNotNull().cast("long").alias("known"), F.lit(0.0).alias("far"))
    far = scored.select("row", F.inline("far"))
    looked_up = written(far.select("key").distinct().join(longest.select("key", "log"), "key", "left"), "lm-far")
    logs = looked_up.where("log is not null").unionByName(_walked(looked_up.where("log is null"), trie, order))
    score = far.join(logs, "key").select("row", F.lit(0.0).alias("base"), F.lit(0).cast("long").alias("known"), (F.col("times") * F.col("log")).alias("far"))
    tail = base.unionByName(score).groupBy("row").agg(F.sum("base").alias("base"), F.sum("known").alias("known"), F.sum("far").alias("far_score"))
    return scored.drop("rare", "far").join(tail, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("far_score", F.lit(0.0))).alias("score"),
    )
