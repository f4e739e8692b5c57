"""Toxicity by multiple-instance learning: sentences are the instances, documents carry the labels.

A sentence's probability is a logistic function of the hashed words and word stems (leading 4 and
5 bytes) in it; a document's probability is the noisy-or of its sentences. The weights are trained
from document labels alone, on a sample of bounded size, and the same sentence scores then
locate the offending sentences. Scoring reads every text once and needs no shuffle.

Defined results: null or empty text, or text without words, has no sentence and scores 0; labels
above 0 are toxic, others not; a document labelled more than once counts with its highest label;
null labels and null ids are left out of training; of a training document's rows with different
texts the least text counts; without texts of words for both labels every score is 0; a sentence of
more than ``PART`` bytes counts as several. Repeated rows get the same answer, other columns are
ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _bytes
from ._bytes import LOWER, NOT_ALNUM, U64, Words, chunks, cut_parts, mix

BITS = 18
STEMS = 4, 5
#: Sentences end at . ! ? and line ends.
_STOP = np.zeros(256, np.int64)
_STOP[[0x2E, 0x21, 0x3F, 0x0A]] = 1


class Sentences:
    """Hashed features of a chunk's sentences, in order; documents' sentences are consecutive."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        if len(data) > _bytes.PART:
            self._by_parts(data)
            return
        words = Words(LOWER[data], offsets, NOT_ALNUM)
        stops = np.concatenate([[0], np.cumsum(_STOP[data])])
        key = stops[words.begin] + words.doc
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.words = np.append(first, len(key))  # bounds in words
        self.doc = words.doc[first]
        self.begin, self.end = words.begin[first], words.end[self.words[1:] - 1] if len(first) else first
        whole = words.hashes()
        slots = [whole]
        ends = words.end
        for n in STEMS:
            words.end = np.minimum(words.begin + n, ends)
            slots.append(mix(words.hashes() + U64(n)))
        self.slots = (np.stack(slots, axis=1) >> U64(64 - BITS)).astype(np.int32)  # (words, features of a word)

    def _by_parts(self, data: np.ndarray) -> None:
        """Of one long document: parts end where a sentence does, or in a sentence of more than ``PART`` bytes, which then counts as several."""
        found, held = [], 0
        for a, b in cut_parts(data, _STOP > 0, anywhere=True):
            own = Sentences(data[a:b], np.array([0, b - a]))
            found.append((own.words[:-1] + held, own.begin + a, own.end + a, own.slots))
            held += int(own.words[-1])
        starts, self.begin, self.end, self.slots = (np.concatenate(x) for x in zip(*found, strict=True))
        self.words, self.doc = np.append(starts, held), np.zeros(len(starts), np.int64)


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in chunks(batch, "text"):
            s = Sentences(data, offsets)
            of_doc = np.searchsorted(s.doc, np.arange(rows.num_rows + 1))
            slots, lengths = [], []
            for k in range(rows.num_rows):
                bounds = s.words[of_doc[k] : of_doc[k + 1] + 1]
                slots.append(s.slots[bounds[0] : bounds[-1]].tobytes())
                lengths.append(np.diff(bounds).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(slots, pa.binary()), pa.array(lengths, pa.binary())], names=["doc_id", "label", "slots", "lengths"])


class ToxicityModel:
    """One weight for each of 2**BITS slots and a bias: a fixed size, whatever the data."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights.astype(np.float32), bias

    @classmethod
    def train(cls, slots: list[np.ndarray], lengths: list[np.ndarray], labels: np.ndarray, steps: int = 80, rate: float = 0.15, l1: float = 1e-4, least_z: float = 5.0) -> ToxicityModel:
        if len(set(labels.tolist())) < 2:
            return cls(np.zeros(1 << BITS), -60.0)
        per_doc = np.array([len(x) for x in lengths])
        keep = np.flatnonzero(per_doc)
        slots, lengths, labels, per_doc = [slots[k] for k in keep], [lengths[k] for k in keep], labels[keep].astype(np.float64), per_doc[keep]
        if len(set(labels.tolist())) < 2:
            return cls(np.zeros(1 << BITS), -60.0)
        with_label = np.zeros((2, 1 << BITS))  # documents of each label that have the slot
        for x, y in zip(slots, labels.astype(int), strict=True):
            with_label[y, np.unique(x)] += 1
        totals = np.bincount(labels.astype(int), minlength=2)
        share, pooled = with_label / totals[:, None], with_label.sum(axis=0) / totals.sum()
        spread = np.sqrt(pooled * (1 - pooled) * (1 / totals).sum())
        usable = np.abs(share[1] - share[0]) >= np.maximum(least_z * spread, 1e-9)  # else rare words are learnt by heart
        width = 1 + len(STEMS)
        flat = np.concatenate(slots)
        sentence = np.repeat(np.arange(per_doc.sum()), np.concatenate(lengths) * width)
        on = usable[flat]
        pairs = np.unique(sentence[on] * (1 << BITS) + flat[on])  # a slot counts once in a sentence
        flat, sentence = pairs & ((1 << BITS) - 1), (pairs >> BITS).astype(np.int32)
        names, flat = np.unique(flat, return_inverse=True)
        flat = flat.astype(np.int32)
        doc = np.repeat(np.arange(len(labels)), per_doc)
        starts = np.concatenate([[0], np.cumsum(per_doc)[:-1]])
        weight = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum())
        w, b, m, v, mb, vb = np.zeros(len(names)), -6.0, np.zeros(len(names)), np.zeros(len(names)), 0.0, 0.0
        for step in range(1, steps + 1):
            z = b + np.bincount(sentence, w[flat], minlength=len(doc))
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            none = np.exp(np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-12)), starts))
            factor = np.where(labels == 1, -none / np.maximum(1 - none, 1e-9), 1.0) * weight
            g = factor[doc] * p
            gw, gb = np.bincount(flat, g[sentence], minlength=len(names)), g.sum()
            m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
            mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            pace = rate / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            w -= pace * (m / (1 - 0.9**step))
            w = np.sign(w) * np.maximum(np.abs(w) - pace * l1, 0)
            b -= rate / (np.sqrt(vb / (1 - 0.99**step)) + 1e-6) * (mb / (1 - 0.9**step))
        weights = np.zeros(1 << BITS)
        weights[names] = w
        return cls(weights, float(b))

    def sentence_scores(self, s: Sentences) -> np.ndarray:
        n = len(s.words) - 1
        word, feature = np.nonzero(self.weights[s.slots])
        sentence = np.searchsorted(s.words, word, "right") - 1
        pairs = np.unique((sentence << BITS) + s.slots[word, feature])  # a slot counts once in a sentence
        z = np.bincount(pairs >> BITS, self.weights[pairs & ((1 << BITS) - 1)], minlength=n) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def learn_toxicity(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", sample: int = 2000, sample_bytes: int = 32 << 20) -> ToxicityModel:
    """Train from labelled documents where ``usable`` (a condition on doc_id) holds.

    At most ``sample`` documents with label 1 and twice as many others are used, the first by a hash
    of their id, and of either label no more once their texts exceed ``sample_bytes``; that is the
    documented bound on what training reads.
    """
    own = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("double").alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & usable)
    own = own.groupBy("doc_id").agg((F.max("label") > 0).cast("int").alias("label")).withColumn("place", F.xxhash64("doc_id"))
    order = Window.partitionBy("label").orderBy("place", "doc_id")
    picked = own.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= 2 * sample).where((F.col("label") == 0) | (F.col("nth") <= sample))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label", "place").agg(F.min("text").alias("text"))
    before = F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", before).where(F.coalesce("before", F.lit(0)) < sample_bytes).select("doc_id", "label", "text")
    rows = rows.mapInArrow(_features, "doc_id long, label int, slots binary, lengths binary").toArrow().to_pandas()
    rows = rows.sort_values(["doc_id", "label"], kind="stable")
    return ToxicityModel.train([np.frombuffer(x, np.int32) for x in rows["slots"]], [np.frombuffer(x, np.int32) for x in rows["lengths"]], rows["label"].to_numpy())


_FOUND = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def _score(batches: Iterable[pa.RecordBatch], model: ToxicityModel, level: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in chunks(batch, "text"):
            s = Sentences(data, offsets)
            p = model.sentence_scores(s)
            none = np.concatenate([[0.0], np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-12)))])
            bounds = np.searchsorted(s.doc, np.arange(rows.num_rows + 1))
            score = -np.expm1(none[bounds[1:]] - none[bounds[:-1]])
            found: list[list[dict]] = [[] for _ in range(rows.num_rows)]
            for k in np.flatnonzero(p >= level):
                base = offsets[s.doc[k]]
                found[s.doc[k]].append({"begin": int(s.begin[k] - base), "end": int(s.end[k] - base), "score": float(p[k])})
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.clip(score, 0, 1)), pa.array(np.diff(bounds)), pa.array(found, _FOUND)], names=["doc_id", "score", "n_sentences", "offending"])


def score_toxicity(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text", level: float = 0.5) -> DataFrame:
    """doc_id, score, n_sentences, offending: sentences of at least ``level``, by their place in the UTF-8 bytes (first word's begin, last word's end)."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(lambda it: _score(it, model, level), "doc_id long, score double, n_sentences long, offending array<struct<begin: long, end: long, score: double>>")
