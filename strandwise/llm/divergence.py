"""Source divergence audit: how far the term frequencies of sources differ within a language.

Terms become integers. Map tasks cut whole texts into terms, encode them by a dictionary of their
own (Arrow, exact) and count (language, source, term) over runs of texts, so that only distinct ones
are shuffled. All terms of a language, in UTF-8 order, are cut into chunks of at most ``CHUNK`` terms,
and of at most ``CELLS`` terms by sources, which bounds a task's rows; of these a chunk keeps, as a
sorted array, those in enough documents. The chunks' first terms are the only thing that the driver
holds. A chunk's task finds its counts' ids by ``searchsorted`` in the chunk's array and adds them up
per source by ``bincount``: dense vectors, whose order is that of the terms, so that ties need no strings.

With V kept terms of a language and N their occurrences in a group, a group gives each kept term the
integer p = 1 + floor(SCALE * (count + 2) / (N + 2 * V)); two distributions differ at a term by
floor((p - q)^2 / (p + q)). All of it is exact integer arithmetic (N + 2 * V below 9e15).

Defined results: null text, language and source count as ''; a term is a run of letters A-Z, a-z and
characters beyond ASCII, with only A-Z lower-cased. Every (language, source) that occurs is a
group. Repeated rows count each; ids and other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _bytes
from ._bytes import LOWER, Words, chunks, cut_parts
from ._runtime import lean, trim, written

SCALE = 1_000_000_000
CHUNK = 1 << 14
CELLS = 1 << 21
#: Bytes of text that a map task counts at once.
RUN = 4 << 20
NOT_TERM = np.ones(256, bool)
NOT_TERM[65:91] = NOT_TERM[97:123] = NOT_TERM[128:] = False
_COUNTED = "lang string, source string, term binary, docs long, n long"


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(dictionary of a chunk's terms, code of each occurrence in it, document of each occurrence)."""
    found, docs = [], []
    for a, b in cut_parts(data, NOT_TERM) if len(data) > _bytes.PART else [(0, len(data))]:
        own = LOWER[data[a:b]]
        at = offsets if (a, b) == (0, len(data)) else np.array([0, b - a])
        inside = ~NOT_TERM[own]
        if b - a > _bytes.PART + 1:  # one term
            ends, doc = np.array([np.count_nonzero(inside)]), np.zeros(1, np.int64)
        else:
            words = Words(own, at, NOT_TERM)
            ends, doc = np.cumsum(words.end - words.begin), words.doc
        bounds = np.concatenate([[0], ends]).astype(np.int64)
        found.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(bounds), pa.py_buffer(own[inside])]).dictionary_encode())
        docs.append(doc)
    if len(found) == 1:
        return found[0].dictionary, found[0].indices.to_numpy(), docs[0]
    whole = pa.chunked_array(found).unify_dictionaries()
    return whole.chunk(0).dictionary, np.concatenate([c.indices.to_numpy() for c in whole.chunks]), np.concatenate(docs)


_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("docs", pa.int64()), ("n", pa.int64())])


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of terms by language and source over ``RUN`` bytes of texts, and a row with a null term for each language and source."""
    for batch in batches:
        for rows, data, offsets in chunks(batch, "text", RUN):
            names, code, doc = _terms(data, offsets)
            lang, source = (rows.column(k).dictionary_encode() for k in (0, 1))
            group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            width = max(len(names), 1)
            cell, n = np.unique(group[doc] * width + code, return_counts=True)
            once = np.unique(doc * width + code)
            _, docs = np.unique(group[once // width] * width + once % width, return_counts=True)  # the same cells, in the same order
            seen = np.unique(group)
            at = np.concatenate([cell // width, seen])
            term = pa.concat_arrays([names.take(pa.array(cell % width)), pa.nulls(len(seen), pa.large_binary())])
            zeros = np.zeros(len(seen), np.int64)
            columns = [lang.dictionary.take(pa.array(at // len(source.dictionary))), source.dictionary.take(pa.array(at % len(source.dictionary))), term, pa.array(np.concatenate([docs, zeros])), pa.array(np.concatenate([n, zeros]))]
            yield from pa.table(columns, names=_COUNTS.names).cast(_COUNTS).to_batches(max_chunksize=1 << 14)


def count_terms(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, docs (documents with it), n (occurrences); each group also has a row with a null term."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = docs.select(blank(lang).alias("lang"), blank(source).alias("source"), blank(text).alias("text"))
    return own.mapInArrow(lambda it: lean(_counted(it)), _COUNTED).groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def _cut(batches: Iterable[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """Sorted (lang, term, kept) to rows (lang, first, terms): of at most ``chunk`` consecutive terms of a language the first one, and those that are kept."""
    lang, first, held, seen = None, b"", [], 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([first], pa.binary()), pa.array([held], pa.list_(pa.binary()))], names=["lang", "first", "terms"])

    for batch in batches:
        for of, term, kept in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if seen and (of != lang or seen == chunk):
                yield row()
                held, seen = [], 0
            if not seen:
                lang, first = of, term
            seen += 1
            if kept:
                held.append(term)
    if seen:
        yield row()


def _sorted_chunks(terms: DataFrame, groups: DataFrame, chunk: int) -> DataFrame:
    """lang, first, terms of all chunks; a language without terms has one empty chunk."""
    cut = terms.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(lambda it: lean(_cut(it, chunk)), "lang string, first binary, terms array<binary>")
    none = groups.select("lang").distinct().join(terms.select("lang").distinct(), "lang", "left_anti").select("lang", F.lit(b"").alias("first"), F.array().cast("array<binary>").alias("terms"))
    return cut.unionByName(none)


class Places:
    """The first terms of all chunks, by language: which chunk a term belongs to (the last whose first term isn't after it)."""

    def __init__(self, firsts: list[tuple[str, bytes]]) -> None:
        self.first: dict[str, np.ndarray] = {}
        self.base: dict[str, int] = {}
        ordered = sorted(firsts)
        for lang in dict(ordered):
            self.base[lang] = bisect_left(ordered, (lang, b""))
            own = [t for x, t in ordered if x == lang]
            self.first[lang] = np.array([*own, None], object)[:-1]

    def __call__(self, lang: pa.Array, term: pa.Array) -> np.ndarray:
        out = np.zeros(len(term), np.int32)
        codes = lang.dictionary_encode()
        terms = np.array([*term.to_pylist(), None], object)[:-1]
        for k, name in enumerate(codes.dictionary.to_pylist()):
            at = np.flatnonzero(codes.indices.to_numpy() == k)
            out[at] = self.base[name] + np.searchsorted(self.first[name], terms[at], "right") - 1
        return out


def _placed(batches: Iterable[pa.RecordBatch], places: Places) -> Iterator[pa.RecordBatch]:
    """Rows (lang, term, others) with the number of their chunk in front."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(places(batch.column(0), batch.column(1))), *batch.columns], names=["nth", *batch.schema.names])


_VECTORS = pa.schema([("nth", pa.int32()), ("lang", pa.string()), ("source", pa.string()), ("n", pa.int64()), ("counts", pa.binary())])


def _vectors(rows: pa.Table, chunk: pa.Table) -> pa.Table:
    """Counts of the kept terms of one chunk as a dense vector for each source that has any, and its sum."""
    if not rows.num_rows or not chunk.num_rows:
        return _VECTORS.empty_table()
    terms = np.array([*chunk["terms"][0].as_py(), None], object)
    own = np.array([*rows["term"].to_pylist(), None], object)[:-1]
    at = np.searchsorted(terms[:-1], own)
    kept = np.flatnonzero(terms[at] == own)
    rows, at = rows.select(["source", "n"]).take(pa.array(kept)), at[kept]
    if not len(kept):
        return _VECTORS.empty_table()
    source = rows["source"].combine_chunks().dictionary_encode()
    width, names = len(terms) - 1, source.dictionary
    cell, n = source.indices.to_numpy().astype(np.int64) * width + at, rows["n"].to_numpy()
    low, high = (np.bincount(cell, part.astype(np.float64), len(names) * width).astype(np.int64) for part in (n & 0xFFFFFFF, n >> 28))  # exact: one count a cell
    counts = (low + (high << 28)).reshape(len(names), width)
    same = pa.array(np.zeros(len(names), np.int64))
    return pa.table([chunk["nth"].take(same), chunk["lang"].take(same), names, pa.array(counts.sum(axis=1)), pa.array([c.tobytes() for c in counts], pa.binary())], schema=_VECTORS)


def _shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / total), by long division in three steps so that nothing exceeds 64 bits."""
    out, left = np.divmod(counts + 2, total)
    for _ in range(3):
        digit, left = np.divmod(left * 1000, total)
        out = out * 1000 + digit
    return out + 1


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


_FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.binary()), ("value", pa.int64())])


def _measured(rows: pa.Table, chunk: pa.Table, top: int) -> pa.Table:
    """Of one chunk: for each pair of sources (the first by code point first) the sum, for each source its ``top`` terms."""
    if not chunk.num_rows:
        return _FOUND.empty_table()
    lang, v = chunk["lang"][0].as_py(), chunk["v"][0].as_py()
    groups = chunk["groups"][0].as_py()
    names = [g["source"] for g in groups]
    totals = np.array([g["n"] for g in groups], np.int64)
    terms = pa.array(chunk["terms"][0].as_py(), pa.binary())
    width, size = len(terms), len(names)
    counts = np.zeros((size, width), np.int64)
    place = dict(zip(names, range(size), strict=True))
    for source, vector in zip(rows["source"].to_pylist(), rows["counts"].to_pylist(), strict=True):
        counts[place[source]] = np.frombuffer(vector, np.int64)
    p = _shares(counts, (totals + 2 * v)[:, None])
    q = _shares(counts.sum(axis=0), np.int64(totals.sum() + 2 * v))
    as_items = pa.array([x.encode() for x in names], pa.binary())
    found = [_FOUND.empty_table()]

    def add(source: int, part: str, items: pa.Array, values: np.ndarray) -> None:
        m = len(values)
        same = [pa.array([x], pa.string()).take(pa.array(np.zeros(m, np.int64))) for x in (lang, names[source], part)]
        found.append(pa.table([*same, items, pa.array(values, pa.int64())], schema=_FOUND))

    for k in range(size):
        add(k, "pair", as_items[k + 1 :], _apart(p[k], p[k + 1 :]).sum(axis=1))
        own = np.flatnonzero((counts[k] > 0) & (p[k] > q))
        value = _apart(p[k, own], q[own])
        first = np.lexsort((own, -value))[:top]  # ids are in the order of terms
        add(k, "term", terms.take(pa.array(own[first])), value[first])
    trim()
    return pa.concat_tables(found)


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 10, top: int = 10, chunk: int = CHUNK) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: see the module's text. Of terms the ``top`` ranks of each group."""
    counted = written(count_terms(docs, text, lang, source), "counted")
    groups = counted.where("term is null").select("lang", "source")
    counts = counted.where("term is not null")
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    chunk = max(1, min(chunk, CELLS // most))
    terms = counts.groupBy("lang", "term").agg((F.sum("docs") >= least_docs).alias("kept"))
    cut = written(_sorted_chunks(terms, groups, chunk), "chunks")
    places = Places([(r["lang"], bytes(r["first"])) for r in cut.select("lang", "first").collect()])  # one of each ``chunk`` terms
    numbered = lambda df, kind: df.mapInArrow(lambda it: lean(_placed(it, places)), f"nth int, lang string, {kind}")
    cut = numbered(cut.select("lang", "first", "terms"), "first binary, terms array<binary>").select("nth", "lang", "terms")
    placed = numbered(counts.select("lang", "term", "source", "n"), "term binary, source string, n long")
    vectors = placed.groupBy("nth").cogroup(cut.groupBy("nth")).applyInArrow(_vectors, "nth int, lang string, source string, n long, counts binary")
    vectors = written(vectors, "vectors")
    totals = groups.join(vectors.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left")
    listed = totals.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("groups"))
    sizes = cut.groupBy("lang").agg(F.sum(F.size("terms")).alias("v"))
    told = cut.join(sizes, "lang").join(listed, "lang")
    found = vectors.groupBy("nth").cogroup(told.groupBy("nth")).applyInArrow(lambda a, b: _measured(a, b, top), "lang string, source string, part string, item binary, value long")
    found = written(found, "measured")
    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.col("item").cast("string").alias("item"), "value")
    both = sums.unionByName(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")).withColumn("part", F.lit("pair"))
    terms = found.where("part = 'term'").select("lang", "source", F.col("item").cast("string").alias("item"), "value", "part")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(both).unionByName(ranked(terms).where(F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
