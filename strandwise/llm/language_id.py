"""Language identification: family first, then one-versus-one linear SVMs within the family.

Texts become frequencies of hashed byte n-grams of the whole text, A-Z lower-cased. Linear support
vector machines (one-versus-one) choose the language family and then separate the languages of
that family. They are trained on the driver from at most ``sample`` distinct texts of each language,
the first by a hash of the text; scoring reads every text once and needs no shuffle.

Votes between learned languages have no "none of these", so the model also tells what share of a
text's byte 3-grams the predicted language's training texts hold (``known``). Foreign or made-up
text has a low share. ``recognised`` is whether the share, plus an allowance of 1 / sqrt(n) for the
chance in n 3-grams, reaches ``least_known``: half of what 99 % of the training texts have when the
other half of the training texts is asked.

Defined results: null text, or text without a letter, gives ``und`` with score 0, known 0, and isn't
recognised; languages not in the family table are families of their own; with a single learned
language everything with a letter gets it; with none everything is ``und``. Repeated rows get the
same answer, other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._bytes import LOWER, U64, chunks, parts
from ._runtime import lean, trim

FAMILIES = {
    **dict.fromkeys("en de nl sv da no".split(), "germanic"),
    **dict.fromkeys("fr es it pt ro ca".split(), "romance"),
    **dict.fromkeys("ru uk pl cs sk bg sr hr sl".split(), "slavic"),
}
SIZES = 2, 3
BITS = 12
SCALE = 30.0
#: Bytes and hash bits of the grams that tell known from unknown text.
GRAM, GRAM_BITS = 3, 16
_HASH = U64(0x9E3779B97F4A7C15)


def _slots(data: np.ndarray, n: int, bits: int = BITS) -> np.ndarray:
    count = max(0, len(data) - n + 1)
    code = np.full(count, n, np.uint64)
    for k in range(n):
        code <<= U64(8)
        code |= data[k : k + count]
    code *= _HASH
    code >>= U64(64 - bits)
    return code.astype(np.int32)


def _bounds(offsets: np.ndarray, n: int, count: int) -> np.ndarray:
    """Bounds of the n-grams that begin in a document and end in it, as pairs (begin, end)."""
    begin = np.minimum(offsets[:-1], count)
    return np.stack([begin, np.clip(offsets[1:] - n + 1, begin, max(count, 0))])


def _parts(data: np.ndarray, offsets: np.ndarray, n: int, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(slots of n-grams, begin and end of each document's among them) of a chunk, part by part."""
    begin, end = _bounds(offsets, n, len(data) - n + 1)
    for a, b in parts(len(data)):
        slots = _slots(LOWER[data[a : b + n - 1]], n, bits)
        yield slots, np.clip(begin - a, 0, len(slots)), np.clip(end - a, 0, len(slots))


def _counts(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    counts = np.zeros(1 << bits, np.int64)
    for slots, _, _ in _parts(data, np.array([0, len(data)]), n, bits):
        counts += np.bincount(slots, minlength=1 << bits)
    return counts


def _frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row the slots that occur and how often, of the features' n-grams and of the grams that tell known text."""
    for batch in batches:
        for rows, data, offsets in chunks(batch, "text"):
            columns: list[list[bytes]] = [[], [], [], []]
            for k in range(rows.num_rows):
                own = data[offsets[k] : offsets[k + 1]]
                for at, counts in enumerate((sum(_counts(own, n, BITS) for n in SIZES), _counts(own, GRAM, GRAM_BITS))):
                    slot = np.flatnonzero(counts)
                    columns[2 * at].append(slot.astype(np.uint16).tobytes())
                    columns[2 * at + 1].append(counts[slot].astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *(pa.array(c, pa.binary()) for c in columns)], names=["lang", "hash", "slots", "counts", "grams", "times"])


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, epochs: int = 30, seed: int = 7) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by dual coordinate descent; y is -1 or 1, the bias a constant feature."""
    rng = np.random.default_rng(seed)
    each = np.where(y > 0, c * len(y) / (2 * max(1, (y > 0).sum())), c * len(y) / (2 * max(1, (y < 0).sum())))
    alpha, w, b = np.zeros(len(y)), np.zeros(x.shape[1], np.float32), 0.0
    diagonal = 0.5 / each
    norm = np.einsum("ij,ij->i", x, x) + 1 + diagonal
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            g = y[i] * (float(x[i] @ w) + b) - 1 + diagonal[i] * alpha[i]
            new = max(0.0, alpha[i] - g / norm[i])
            if step := (new - alpha[i]) * y[i]:
                alpha[i] = new
                w += np.float32(step) * x[i]
                b += step
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, float(b)


class LanguageModel:
    """Pairs of classes with a weight vector each; ``nodes`` holds the family node and one per family."""

    def __init__(self, languages: list[str], families: Mapping[str, str]) -> None:
        self.languages = languages
        self.families = sorted({families.get(x, x) for x in languages})
        self.members = {f: [x for x in languages if families.get(x, x) == f] for f in self.families}
        self.weights: list[np.ndarray] = []
        self.bias: list[float] = []
        self.pairs: dict[str, list[tuple[int, int, int]]] = {}
        self.seen = np.ones((len(languages), 1 << GRAM_BITS), bool)
        self.least_known = 0.0

    def learn_known(self, lang: np.ndarray, grams: list[np.ndarray], times: list[np.ndarray], share: float = 0.5, but: float = 0.01) -> None:
        """Keep the languages' grams; ``least_known`` is ``share`` of the ``but`` quantile of what texts have, by the grams of every other text."""
        code = {name: k for k, name in enumerate(self.languages)}
        halves = np.zeros((2, len(self.languages), 1 << GRAM_BITS), bool)
        for k, name in enumerate(lang.tolist()):
            halves[k % 2, code[name], grams[k]] = True
        known = [float(times[k][halves[1 - k % 2, code[name]][grams[k]]].sum() / times[k].sum()) for k, name in enumerate(lang.tolist()) if len(grams[k])]
        self.least_known = share * float(np.quantile(known, but)) if known else 0.0
        self.seen = halves.any(axis=0)

    def known(self, data: np.ndarray, offsets: np.ndarray, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(share of each document's grams that its language's training texts hold, whether that is enough)."""
        code = {name: k for k, name in enumerate(self.languages)}
        own = np.array([code.get(name, 0) for name in names], np.int64) << GRAM_BITS
        held, count = np.zeros(len(names)), np.zeros(len(names))
        for slots, begin, end in _parts(data, offsets, GRAM, GRAM_BITS) if self.languages else ():
            place = np.zeros(len(slots) + 1, np.int64)  # which document each gram begins in: each one's begin counts up
            np.add.at(place, begin, 1)
            doc = np.clip(np.cumsum(place[:-1]) - 1, 0, len(names) - 1)
            sums = np.concatenate([[0], np.cumsum(self.seen.ravel()[slots + own[doc]])])
            held += sums[end] - sums[begin]
            count += end - begin
        count = np.maximum(count, 1)
        share = held / count
        return share, share + 1 / np.sqrt(count) >= self.least_known

    @classmethod
    def train(cls, x: np.ndarray, lang: np.ndarray, families: Mapping[str, str] = FAMILIES) -> LanguageModel:
        model = cls(sorted(set(lang.tolist())), families)
        family = np.array([families.get(v, v) for v in lang.tolist()], object)
        for node, classes, label in [("", model.families, family), *((f, m, lang) for f, m in model.members.items())]:
            model.pairs[node] = []
            for i in range(len(classes)):
                for j in range(i + 1, len(classes)):
                    own = np.flatnonzero((label == classes[i]) | (label == classes[j]))
                    w, b = train_svm(x[own], np.where(label[own] == classes[i], 1.0, -1.0))
                    model.pairs[node].append((i, j, len(model.weights)))
                    model.weights.append(w)
                    model.bias.append(b)
        return model

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Margin of each classifier for each document: shape (classifiers, documents)."""
        total = np.zeros((len(self.weights), len(offsets) - 1))
        count = np.zeros(len(offsets) - 1)
        for n in SIZES:
            for slots, begin, end in _parts(data, offsets, n):
                count += end - begin
                for k, w in enumerate(self.weights):
                    sums = np.concatenate([[0.0], np.cumsum(w[slots], dtype=np.float64)])
                    total[k] += sums[end] - sums[begin]
        return total * (SCALE / np.maximum(count, 1)) + np.array(self.bias)[:, None]

    def _choose(self, node: str, classes: int, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, its share of the pairwise probabilities) by document."""
        votes = np.zeros((classes, margins.shape[1]))
        for i, j, k in self.pairs[node]:
            p = 1 / (1 + np.exp(-np.clip(3 * margins[k], -50, 50)))
            votes[i] += p
            votes[j] += 1 - p
        if classes == 1:
            votes += 1
        best = votes.argmax(axis=0)
        return best, votes.max(axis=0) / max(1, classes - 1)

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(offsets) - 1
        if not self.languages:
            return ["und"] * n, np.zeros(n)
        margins = self.margins(data, offsets)
        family, score = self._choose("", len(self.families), margins)
        out = np.empty(n, object)
        for k, name in enumerate(self.families):
            own = np.flatnonzero(family == k)
            member, share = self._choose(name, len(self.members[name]), margins[:, own])
            out[own] = np.array(self.members[name], object)[member]
            score[own] *= share
        return out.tolist(), np.clip(score, 0, 1)


def learn_languages(labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = 500, families: Mapping[str, str] = FAMILIES) -> LanguageModel:
    """Train from ``sample`` distinct texts of each language (all, if it has fewer), the first by their hash.

    ``sample`` is the documented bound on what training reads; it does not depend on the input's size.
    """
    own = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("hash")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    texts = own.groupBy("lang", "hash").agg(F.lit(1).alias("one"))  # of a group of copies one counts
    of = texts.groupBy(F.col("lang").alias("of")).agg(F.count("*").alias("n"))
    # hashes are uniform: the first ``sample`` of a language lie in the share that about twice as many do
    share = (F.col("hash").cast("double") + 2.0**63) / 2.0**64
    likely = texts.join(F.broadcast(of), F.col("lang") == F.col("of")).where(share * F.col("n") <= 2 * sample + 100)  # a row for each language
    order = Window.partitionBy("lang").orderBy("hash")
    picked = likely.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= sample).select("lang", "hash")
    chosen = own.join(F.broadcast(picked), ["lang", "hash"]).groupBy("lang", "hash").agg(F.min("text").alias("text"))  # ``sample`` rows a language
    rows = chosen.mapInArrow(lambda it: lean(_frequencies(it)), "lang string, hash long, slots binary, counts binary, grams binary, times binary").toArrow().sort_by([("lang", "ascending"), ("hash", "ascending")])
    names = np.array(rows["lang"].to_pylist(), object)
    read = lambda column, kind: [np.frombuffer(v.as_py(), kind) for v in rows[column]]
    x = np.zeros((len(names), 1 << BITS), np.float32)
    for k, (slot, count) in enumerate(zip(read("slots", np.uint16), read("counts", np.uint32), strict=True)):
        x[k, slot] = count * (SCALE / max(1, count.sum()))
    model = LanguageModel.train(x, names, families)
    model.learn_known(names, read("grams", np.uint16), read("times", np.uint32))
    del rows, x
    trim()
    return model


_LETTER = regex.compile(r"\p{L}")


def _predict(batches: Iterable[pa.RecordBatch], model: LanguageModel) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in chunks(batch, "text"):
            names, score = model.predict(data, offsets)
            known, enough = model.known(data, offsets, names)
            for k, t in enumerate(rows.column(1)):
                if names[k] == "und" or not (s := t.as_py()) or not _LETTER.search(s):
                    names[k], score[k], known[k], enough[k] = "und", 0.0, 0.0, False
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(known, pa.float64()), pa.array(enough)], names=["doc_id", "lang_pred", "score", "known", "recognised"])


def identify(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, known, recognised of every row."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(lambda it: lean(_predict(it, model)), "doc_id long, lang_pred string, score double, known double, recognised boolean")


def recognised(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The rows, all columns as they are, whose text is recognised."""
    place = docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(place)], names=["doc_id", "text"])
            keep = [x for part in _predict([own], model) for x in part.column(4).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lambda it: lean(run(it)), docs.schema)
