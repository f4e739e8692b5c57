"""Quality rules: gradient-boosted trees over document statistics, beside plain base rules.

Map tasks take the statistics of whole texts from their bytes (numpy, a chunk of texts at a time).
The trees are fitted on the driver to the statistics (not the texts) of a bounded sample of labelled
documents: histograms of at most 64 bins a statistic, second-order gains, logistic loss. For the
statistics in ``MONOTONE`` a split is taken only if the constraint's side of it gets no lower value,
and both subtrees are held to their side of the split's middle, so that the score never rises with
them. The fitted trees are flattened into node arrays; a leaf is its own child, so a batch of
rows goes through all trees in as many numpy steps as they are deep.

Defined results: null counts as empty text; a text without words has statistics 0 and fails the base
rules; quality above 0 is good, other labels are bad; a document labelled more than once counts with
its least label; null labels and null ids are left out of training; of a training document's rows with
different texts the least text counts; without both labels every document that passes the base rules
is kept. Repeated rows get the same answer, other columns are ignored, an empty table gives an empty
result. Words and lines are told apart by 64-bit hashes within their document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _bytes
from ._bytes import LOWER, SPACE, U64, Hashes, Words, chunks, mix

#: Statistics that the trees see, in order.
STATISTICS = (
    "log_words", "chars_per_word", "symbols_per_word", "dup_line_share", "repeat_word_share", "words_per_line", "upper_share", "digit_share", "stop_share", "bang_share", "odd_share", "distinct_share", "wide_share",
)
#: More of these never makes a document better.
MONOTONE = {"symbols_per_word": -1, "dup_line_share": -1, "repeat_word_share": -1, "bang_share": -1}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_LINE = _table("\n")
_SYMBOL = _table("#*$%&|<>")
_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _table("0123456789")
_STOP = _table(".,;:?")
_BANG = _table("!")
_WIDE = np.arange(256) >= 0xC0  # first bytes of characters beyond ASCII
_REST = (np.arange(256) & 0xC0) == 0x80  # their other bytes
_ODD = (np.arange(256) > 0x20) & (np.arange(256) < 0x7F) & ~(_SYMBOL | _UPPER | _DIGIT | _STOP | _BANG) & ~_table("abcdefghijklmnopqrstuvwxyz'\"-()")
_CLASSES = (_SYMBOL, _UPPER, _DIGIT, _STOP, _BANG, _ODD, _WIDE)


def _class_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows by (characters in words, each of ``_CLASSES``): how many bytes of the kind each document has."""
    tables = (~SPACE & ~_REST, *_CLASSES)
    out = np.zeros((len(offsets) - 1, len(tables)), np.int64)
    if len(offsets) == 2:
        for a, b in _bytes.parts(len(data)):
            seen = np.bincount(data[a:b], minlength=256)
            out[0] += [int(seen[t].sum()) for t in tables]
        return out
    for k, t in enumerate(tables):
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(t[data], out=total[1:])
        out[:, k] = np.diff(total[offsets])
    return out


def _line_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each line that has a word."""
    if len(data) <= _bytes.PART:
        lines = Words(data, offsets, _LINE)
        if not len(lines.begin):
            return np.zeros(0, U64), np.zeros(0, np.int64)
        worded = np.logical_or.reduceat(~SPACE[data], lines.begin)  # up to the next line's begin there are only line ends
        return lines.hashes()[worded], lines.doc[worded]
    found = []
    for a, b in _bytes.cut_parts(data, _LINE):
        own = data[a:b]
        if b - a > _bytes.PART + 1:  # one line
            found.append(Hashes(own, np.array([0, b - a]), _LINE).h if (~SPACE[own]).any() else np.zeros(0, U64))
        else:
            found.append(_line_hashes(own, np.array([0, b - a]))[0])
    h = np.concatenate(found)
    return h, np.zeros(len(h), np.int64)


def _repeats(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each entry's hash occurs again in its document."""
    order = np.lexsort((h, doc))
    same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    again = np.zeros(len(h), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return again


def _firsts(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """How many different hashes each of n documents has."""
    order = np.lexsort((h, doc))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    return np.bincount(doc[order][new], minlength=n)


def statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts as in ``COUNTS``, statistics as in ``STATISTICS``) of a chunk's documents, a row each."""
    n = len(offsets) - 1
    words = Hashes(data, offsets)
    kinds = _class_counts(data, offsets)
    line, line_doc = _line_hashes(data, offsets)
    lines = np.bincount(line_doc, minlength=n)
    dup_lines = lines - _firsts(line, line_doc, n)
    repeated = np.zeros(len(words.h), bool)
    if len(words.h) > 2:
        inside = words.doc[2:] == words.doc[:-2]
        window = mix(words.h[:-2] ^ mix(words.h[1:-1] ^ mix(words.h[2:] + U64(1)) + U64(2)))
        at = np.flatnonzero(inside)
        again = at[_repeats(window[at], words.doc[at])]
        for k in range(3):
            repeated[again + k] = True
    repeat_words = np.bincount(words.doc[repeated], minlength=n)
    distinct = _firsts(words.h, words.doc, n)
    counts = np.stack([words.per_doc, kinds[:, 0], kinds[:, 1], dup_lines, repeat_words], axis=1).astype(np.int64)
    per = np.maximum(words.per_doc, 1).astype(np.float64)
    chars = np.maximum(kinds[:, 0], 1).astype(np.float64)
    found = [
        np.log1p(words.per_doc), kinds[:, 0] / per, kinds[:, 1] / per, dup_lines / np.maximum(lines, 1), repeat_words / per, words.per_doc / np.maximum(lines, 1),
        kinds[:, 2] / chars, kinds[:, 3] / chars, kinds[:, 4] / per, kinds[:, 5] / per, kinds[:, 6] / per, distinct / per, kinds[:, 7] / chars,
    ]
    return counts, np.stack(found, axis=1)


class Trees:
    """Boosted trees as node arrays: go right where the feature exceeds the threshold; a leaf is its own child."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, left: np.ndarray, right: np.ndarray, value: np.ndarray, roots: np.ndarray, depth: int, base: float) -> None:
        self.feature, self.threshold, self.left, self.right, self.value = feature, threshold, left, right, value
        self.roots, self.depth, self.base = roots, depth, base

    @classmethod
    def none(cls) -> Trees:
        """No tree: everything is good."""
        z = np.zeros(0, np.int32)
        return cls(z, np.zeros(0), z, z, np.zeros(0), z, 0, np.inf)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 1.0) -> Trees:
        """``signs``: for each feature 1 if the score may only rise with it, -1 if only fall, else 0. Classes weigh the same."""
        if not len(y) or y.min() == y.max():
            return cls.none()
        y = y.astype(np.float64)
        weight = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
        width = bins + 1
        code = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1)  # code <= b as x <= edges[b]
        grow = _Growth(code, edges, signs, width, depth, ridge, least)
        score = np.zeros(len(y))
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            score += rate * grow.tree(weight * (y - p), weight * p * (1 - p))
        flat = grow.arrays()
        flat[4][:] *= rate
        return cls(*flat, depth, 0.0)

    def margin(self, x: np.ndarray) -> np.ndarray:
        if not len(self.roots):
            return np.full(len(x), self.base)
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] > self.threshold[node], self.right[node], self.left[node])
        return self.base + self.value[node].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of being good."""
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -500, 500)))


class _Growth:
    """Grows trees level by level and collects their nodes."""

    def __init__(self, code: np.ndarray, edges: list[np.ndarray], signs: np.ndarray, width: int, depth: int, ridge: float, least: float) -> None:
        self.code, self.edges, self.signs, self.width, self.depth, self.ridge, self.least = code, edges, signs, width, depth, ridge, least
        self.cell = code + np.arange(code.shape[1]) * width
        self.nodes: list[list[float]] = []  # feature, threshold, left, right, value
        self.roots: list[int] = []

    def _leaf(self, value: float) -> int:
        self.nodes.append([0, 0.0, len(self.nodes), len(self.nodes), value])
        return len(self.nodes) - 1

    def _split(self, rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float) -> tuple[int, int, float, float] | None:
        """(feature, bin, value left, value right) of the best allowed split."""
        cells, size = self.cell[rows].ravel(), self.code.shape[1] * self.width
        shape = (self.code.shape[1], self.width)
        left = [np.cumsum(np.bincount(cells, np.repeat(v[rows], shape[0]), size).reshape(shape), axis=1)[:, :-1] for v in (g, h)]
        total = g[rows].sum(), h[rows].sum()
        right = [t - x for t, x in zip(total, left, strict=True)]
        values = [np.clip(a / (b + self.ridge), low, high) for a, b in (left, right)]
        own = float(np.clip(total[0] / (total[1] + self.ridge), low, high))
        worth = lambda a, b, v: a * v - 0.5 * (b + self.ridge) * v * v
        gain = worth(*left, values[0]) + worth(*right, values[1]) - worth(*total, own)
        gain[(left[1] < self.least) | (right[1] < self.least) | (self.signs[:, None] * (values[1] - values[0]) < 0)] = -np.inf
        f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
        return (int(f), int(b), float(values[0][f, b]), float(values[1][f, b])) if gain[f, b] > 1e-9 else None

    def tree(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Value for each row."""
        rows = np.arange(len(g))
        out = np.zeros(len(g))
        self.roots.append(self._leaf(float(g.sum() / (h.sum() + self.ridge))))
        open_ = [(self.roots[-1], rows, -np.inf, np.inf)]
        for level in range(self.depth + 1):
            again = []
            for node, own, low, high in open_:
                found = self._split(own, g, h, low, high) if level < self.depth else None
                if found is None:
                    out[own] = self.nodes[node][4]
                    continue
                f, b, a, c = found
                sides = self.code[own, f] <= b
                middle = (a + c) / 2
                bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[int(self.signs[f])]
                left, right = self._leaf(a), self._leaf(c)
                self.nodes[node] = [f, float(self.edges[f][min(b, len(self.edges[f]) - 1)]), left, right, 0.0]
                again += [(left, own[sides], *bounds[0]), (right, own[~sides], *bounds[1])]
            open_ = again
        return out

    def arrays(self) -> tuple[np.ndarray, ...]:
        columns = list(zip(*self.nodes, strict=True))
        kinds = np.int32, np.float64, np.int32, np.int32, np.float64
        return *(np.array(c, k) for c, k in zip(columns, kinds, strict=True)), np.array(self.roots, np.int32)


def _sampled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in chunks(batch, "text"):
            found = statistics(data, offsets)[1]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([r.tobytes() for r in found], pa.binary())], names=["doc_id", "label", "found"])


def learn_quality(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", doc_id: str = "doc_id", text: str = "text", sample: int = 4000) -> Trees:
    """Fit to labelled documents where ``usable`` (a condition on doc_id) holds.

    At most ``sample`` documents of each label are used, the first by a hash of their id; that is the
    documented bound on training. Only their statistics (of whole texts) come to the driver.
    """
    own = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("double").alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & usable)
    own = own.groupBy("doc_id").agg((F.min("label") > 0).cast("int").alias("label")).withColumn("place", F.xxhash64("doc_id"))
    # about twice as many as needed, by a bound on the hash, so that the window's tasks stay small whatever the table
    share = {r["label"]: min(1.0, 2 * (sample + 100) / r["count"]) for r in own.groupBy("label").count().collect()}
    bound = F.when(F.col("label") == 1, share.get(1, 1.0)).otherwise(share.get(0, 1.0))
    own = own.where(F.col("place") / 2.0**63 <= 2 * bound - 1)
    order = Window.partitionBy("label").orderBy("place", "doc_id")
    picked = own.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= sample).select("doc_id", "label")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = rows.mapInArrow(_sampled, "doc_id long, label int, found binary").toArrow().to_pandas().sort_values("doc_id", kind="stable")
    x = np.frombuffer(b"".join(rows["found"]), np.float64).reshape(len(rows), len(STATISTICS))
    return Trees.fit(x, rows["label"].to_numpy(), np.array([MONOTONE.get(s, 0) for s in STATISTICS]))


def _judged(batches: Iterable[pa.RecordBatch], trees: Trees) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in chunks(batch, "text"):
            counts, x = statistics(data, offsets)
            yield pa.RecordBatch.from_arrays([rows.column(0), *map(pa.array, counts.T), pa.array(trees.score(x))], names=["doc_id", *COUNTS, "quality"])


def judge_quality(docs: DataFrame, trees: Trees, doc_id: str = "doc_id", text: str = "text", level: float = 0.5) -> DataFrame:
    """doc_id, the counts of ``COUNTS``, base_failed, quality (0 to 1) and kept: not base_failed, and quality at least ``level``."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = own.mapInArrow(lambda it: _judged(it, trees), ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS), "quality double"]))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & (F.col("quality") >= level)).alias("kept"), "quality")
