"""Exact deduplication with Patricia-trie owners.

Map tasks first insert their own texts into a compressed radix trie, so that each task sends a
text once, however many copies it has. Those texts are dealt by length and content hash; the
receiving task inserts the full byte strings into one trie per partition, whose terminal nodes
keep the smallest identifier and the number of rows. Identity is decided by the bytes on the
trie's edges, never by the hash alone.

Defined results: null text is the empty text; rows that repeat both id and text all get the same
answer; a null id never owns a text while another id has it; an empty table gives an empty result;
columns other than id and text are ignored, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._runtime import lean


class _Node:
    __slots__ = ("text", "begin", "end", "kids", "owner", "rows")

    def __init__(self, text: bytes, begin: int, end: int) -> None:
        self.text, self.begin, self.end = text, begin, end
        self.kids: dict[int, _Node] | None = None
        self.owner: int | None = None
        self.rows = 0


def _smaller(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None or a < b else b


def _common(a: bytes, i: int, b: bytes, j: int, most: int) -> int:
    """Length of the common prefix of a[i:i+most] and b[j:j+most]."""
    if a[i : i + most] == b[j : j + most]:
        return most
    low, step = 0, 16
    while a[i + low : i + low + step] == b[j + low : j + low + step]:
        low, step = low + step, step * 2
    while step > 1:
        step //= 2
        if a[i + low : i + low + step] == b[j + low : j + low + step]:
            low += step
    return low


class PatriciaTrie:
    """Compressed radix trie over byte strings; terminal nodes hold the smallest id and a row count.

    Edges are slices of inserted texts. When the texts held exceed ``limit`` bytes, the heaviest
    subtree below the root goes to a local temporary file, as do later texts under its prefix;
    ``entries`` reads each such file into a trie of its own, which may spill again.
    """

    COST = 400  # bytes of bookkeeping for a text

    def __init__(self, limit: int = 256 << 20) -> None:
        self.limit, self.held = limit, 0
        self.root = _Node(b"", 0, 0)
        self.spilled: dict[bytes, object] = {}

    def insert(self, text: bytes, owner: int | None, rows: int = 1) -> None:
        if self.spilled:
            for prefix, file in self.spilled.items():
                if text.startswith(prefix):
                    pickle.dump((text, owner, rows), file, -1)
                    return
        node, at, size = self.root, 0, len(text)
        while at < size:
            kids = node.kids
            if kids is None:
                kids = node.kids = {}
            kid = kids.get(text[at])
            if kid is None:
                kid = kids[text[at]] = _Node(text, at, size)
                self.held += size + self.COST
                node, at = kid, size
                break
            length = kid.end - kid.begin
            same = _common(kid.text, kid.begin, text, at, min(length, size - at))
            if same < length:
                upper = _Node(kid.text, kid.begin, kid.begin + same)
                kid.begin += same
                upper.kids = {kid.text[kid.begin]: kid}
                kids[text[at]] = kid = upper
            node, at = kid, at + same
        node.owner = owner if not node.rows else _smaller(node.owner, owner)
        node.rows += rows
        if self.held > self.limit:
            self._spill()

    def _walk(self, node: _Node, prefix: bytes) -> Iterator[tuple[bytes, int | None, int]]:
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            text = prefix + node.text[node.begin : node.end]
            if node.rows:
                yield text, node.owner, node.rows
            if node.kids:
                stack += [(kid, text) for kid in node.kids.values()]

    def _spill(self) -> None:
        node, prefix = self.root, b""
        while node.kids and len(node.kids) == 1 and not node.rows:  # a lone chain holds nothing to part
            node = next(iter(node.kids.values()))
            prefix += node.text[node.begin : node.end]
        if not node.kids:
            self.limit = self.held * 2  # a single text larger than the limit
            return
        weights = {k: sum(len(t) + self.COST for t, _, _ in self._walk(kid, prefix)) for k, kid in node.kids.items()}
        heaviest = max(weights, key=weights.get)
        kid = node.kids.pop(heaviest)
        file = tempfile.TemporaryFile()
        self.spilled[prefix + kid.text[kid.begin : kid.end]] = file
        for entry in self._walk(kid, prefix):
            pickle.dump(entry, file, -1)
        self.held -= weights[heaviest]

    def entries(self) -> Iterator[tuple[bytes, int | None, int]]:
        """Each distinct text once: (text, smallest id, rows)."""
        yield from self._walk(self.root, b"")
        for file in self.spilled.values():
            below = PatriciaTrie(self.limit)
            file.seek(0)
            while True:
                try:
                    below.insert(*pickle.load(file))
                except EOFError:
                    break
            file.close()
            yield from below.entries()
        self.spilled = {}


def _normal(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()  # bytes.lower() changes A-Z only


def _send(batches: Iterable[pa.RecordBatch], sign: int, limit: int) -> Iterator[pa.RecordBatch]:
    def out(trie: PatriciaTrie) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for text, owner, n in trie.entries():
            rows.append((len(text), xxhash.xxh64_intdigest(text) - (1 << 63), text, owner, n))
            held += len(text)
            if held > 4 << 20 or len(rows) >= 4096:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    trie = PatriciaTrie(limit * 2)
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            trie.insert(_normal(text), None if key is None else sign * key)
        if trie.held > limit:
            yield from out(trie)
            trie = PatriciaTrie(limit * 2)
    yield from out(trie)


_SENT = pa.schema([("size", pa.int64()), ("hash", pa.int64()), ("text", pa.binary()), ("owner", pa.int64()), ("n", pa.int64())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SENT, strict=True)], schema=_SENT)


def _own(batches: Iterable[pa.RecordBatch], sign: int, limit: int) -> Iterator[pa.RecordBatch]:
    trie = PatriciaTrie(limit)
    for batch in batches:
        for text, owner, n in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
            trie.insert(text, owner, n)
    rows: list[tuple] = []
    for text, owner, n in trie.entries():
        rows.append((hashlib.sha256(text).hexdigest(), None if owner is None else sign * owner, n))
        if len(rows) >= 8192:
            yield _owned(rows)
            rows = []
    if rows:
        yield _owned(rows)


def _owned(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["sha", "keep_id", "group_size"])


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sha = [hashlib.sha256(_normal(t)).hexdigest() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sha, pa.string())], names=["doc_id", "text_sha256"])


def text_owners(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "min", limit: int = 48 << 20) -> DataFrame:
    """One row per distinct text: sha (of the normalised text), keep_id, group_size.

    ``keep`` says whether the smallest or the largest id owns a text; ``limit`` bounds the bytes
    of text that a map task's trie and a partition's trie hold in memory.
    """
    sign = {"min": 1, "max": -1}[keep]
    sent = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(lambda it: lean(_send(it, sign, limit)), "size long, hash long, text binary, owner long, n long")
    return sent.repartition("size", "hash").mapInArrow(lambda it: lean(_own(it, sign, limit)), "sha string, keep_id long, group_size long")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "min", limit: int = 48 << 20) -> DataFrame:
    """Every row with its owner: doc_id, keep_id, group_size, kept, text_sha256."""
    owners = text_owners(docs, doc_id, text, keep, limit)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_digest, "doc_id long, text_sha256 string")
    kept: Column = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return rows.join(owners, F.col("text_sha256") == F.col("sha")).select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")
