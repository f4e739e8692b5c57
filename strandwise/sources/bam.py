"""BAM, read and written in splits on any storage that Spark reads.

A BAM file is a row of BGZF blocks, each a gzip member whose header begins with the same 16 bytes. To
Spark's text reader these bytes are a line separator: it cuts a file of any size into splits, and each
split's "lines" are whole compressed blocks, of which only those that begin in the split are its own.
A split's task inflates its blocks one after the other and finds the first record that begins in it by
itself: the first place from which a chain of plausible records follows. It emits the records that
lie wholly in the split, and the bytes before the first and after the last one. Only these edges
(shorter than a record as a rule) meet: they are ordered by split, joined between two record starts,
and must be whole records without rest, or the read fails: a wrongly found start would leave a
rest. Reference names are read once from each file's header, which must lie in its first split.

A file whose blocks have other headers (plain gzip members) is one line to the reader and so one task's.

Writing uses the same reader's twin: rows of whole blocks as text, with the format's empty block
as line separator, which is also what has to stand at a file's end.
"""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandwise.functions.sequence import cigar_ops

# Fixed values of the format: the first bytes of a block (gzip with one extra field BC of two bytes), the
# empty block that ends a file, base and operation codes.
BLOCK_START = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff\x06\x00BC\x02\x00"
EMPTY_BLOCK = BLOCK_START + b"\x1b\x00\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
BASES = "=ACMGRSVTWYHKDBN"
OPS = "MIDNSHP=X"
#: Uncompressed bytes in a block when written.
BLOCK = 0xFF00
#: Bytes of records that must follow each other from a place for it to count as a record's start (fewer at a split's end).
CHAIN = 1 << 18
#: Records in a batch.
BATCH = 1 << 13
_CONSUMES_READ = np.array([op in "MIS=X" for op in OPS])
_BYTE_TEXT = np.array([[BASES[b >> 4], BASES[b & 15]] for b in range(256)]).view("U2")[:, 0]
_RECORDS = pa.schema([("qname", pa.string()), ("flag", pa.int32()), ("ref", pa.int32()), ("pos0", pa.int64()), ("cigar", pa.string()), ("seq", pa.string()), ("qual", pa.string()), ("path", pa.string()), ("split", pa.int64()), ("part", pa.int32()), ("edge", pa.binary()), ("starts", pa.bool_())])
_SCHEMA = "qname string, flag int, ref int, pos0 long, cigar string, seq string, qual string, path string, split long, part int, edge binary, starts boolean"
_TEXT = {"lineSep": BLOCK_START.decode("latin-1"), "encoding": "ISO-8859-1"}


class Incomplete(Exception):
    """More bytes are needed."""


def inflate(block: bytes) -> bytes:
    """Contents of a block without its first 16 bytes, or of gzip members of other kinds."""
    if block[:2] == BLOCK_START[:2] and struct.unpack_from("<H", block)[0] + 1 != len(block) + len(BLOCK_START):
        return gzip.decompress(block)
    if len(block) < 10 or struct.unpack_from("<H", block)[0] + 1 != len(block) + len(BLOCK_START):
        raise ValueError("not a whole BGZF block")
    data = zlib.decompress(block[2:-8], -15)
    crc, size = struct.unpack("<II", block[-8:])
    if len(data) != size or zlib.crc32(data) != crc:
        raise ValueError("a BGZF block's contents don't match its checksum")
    return data


def deflate(data: bytes) -> bytes:
    """Whole blocks that hold ``data``."""
    out = []
    for k in range(0, len(data), BLOCK):
        own = data[k : k + BLOCK]
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packer.compress(own) + packer.flush()
        out.append(BLOCK_START + struct.pack("<H", len(BLOCK_START) + 2 + len(body) + 8 - 1) + body + struct.pack("<II", zlib.crc32(own), len(own)))
    return b"".join(out)


def header(data: bytes) -> tuple[list[str], int]:
    """(reference names, place of the first record); ``Incomplete`` where the header goes on."""
    try:
        if data[:4] != b"BAM\1"[: len(data)]:
            raise ValueError("not a BAM file")
        at = 8 + struct.unpack_from("<i", data, 4)[0]
        (count,) = struct.unpack_from("<i", data, at)
        at, names = at + 4, []
        for _ in range(count):
            (n,) = struct.unpack_from("<i", data, at)
            if at + 8 + n > len(data):
                raise Incomplete
            names.append(data[at + 4 : at + 3 + n].decode())
            at += 8 + n
    except struct.error:
        raise Incomplete from None
    return names, at


def plausible(data: bytes, at: int) -> int | None:
    """Where the record at this place would end, if one can begin here; ``Incomplete`` where it can't be told yet."""
    if at + 36 > len(data):
        raise Incomplete
    size, ref, pos, name_size, _, _, ops, flag, length, next_ref, next_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    if min(ref, pos, next_ref, next_pos) < -1 or name_size < 2 or flag >> 12 or length < 0:
        return None
    fixed = 32 + name_size + 4 * ops + (length + 1) // 2 + length
    if size < fixed or size > fixed + (1 << 24):
        return None
    if at + 36 + name_size + 4 * ops > len(data):
        raise Incomplete
    name = data[at + 36 : at + 36 + name_size]
    if name[-1] or any(not 33 <= b <= 126 for b in name[:-1]):
        return None
    packed = np.frombuffer(data, "<u4", ops, at + 36 + name_size)
    kinds = packed & 15
    if (kinds > 8).any() or (ops and length and int((packed >> 4)[_CONSUMES_READ[kinds]].sum()) != length):
        return None
    return at + 4 + size


def first_start(data: bytes, whole: bool) -> int | None:
    """The first place from which plausible records follow for ``CHAIN`` bytes, or to the end; None if there is none.

    ``Incomplete`` where more bytes have to be seen, unless these are all (``whole``).
    """
    for start in range(len(data)):
        at: int | None = start
        seen = 0
        try:
            while at is not None and at - start < CHAIN:
                if at >= len(data):
                    raise Incomplete
                at = plausible(data, at)
                seen += at is not None
            if at is not None:
                return start
        except Incomplete:
            if not whole:
                raise
            if seen:  # all records to the split's end, the last of which may end beyond it
                return start
    return None


def parsed(data: bytes, at: int, end: int) -> tuple[list[tuple], int]:
    """(records that lie in data[at:end], place of the rest)."""
    rows = []
    while end - at >= 4:
        size, ref, pos, name_size, _, _, ops, flag, length = struct.unpack_from("<iiiBBHHHi", data, at) if end - at >= 24 else (struct.unpack_from("<i", data, at)[0], *[0] * 8)
        if size < 32:
            raise ValueError("a BAM record is damaged")
        if at + 4 + size > end:
            break
        here = at + 36
        name = data[here : here + name_size - 1].decode("latin-1")
        here += name_size
        packed = struct.unpack_from(f"<{ops}I", data, here)
        here += 4 * ops
        bases = (length + 1) // 2
        seq = "".join(_BYTE_TEXT[np.frombuffer(data, np.uint8, bases, here)].tolist())[:length]
        qual = data[here + bases : here + bases + length]
        text = "" if qual[:1] == b"\xff" else (np.frombuffer(qual, np.uint8) + 33).tobytes().decode("latin-1")
        rows.append((name, flag, ref, pos, "".join(f"{p >> 4}{OPS[p & 15]}" for p in packed), seq, text))
        at += 4 + size
    return rows, at


def _batch(rows: list[tuple], path: str, split: int) -> pa.RecordBatch:
    n = len(rows)
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
    rest = [[path] * n, [split] * n, [0] * n, [None] * n, [None] * n]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*columns, *rest], _RECORDS, strict=True)], schema=_RECORDS)


def _edge(path: str, split: int, part: int, edge: bytes, starts: bool) -> pa.RecordBatch:
    """The bytes of a split before its first record (part 1) or after its last one (part 2)."""
    return pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in list(_RECORDS)[:7]), pa.array([path]), pa.array([split]), pa.array([part], pa.int32()), pa.array([edge], pa.binary()), pa.array([starts])], schema=_RECORDS)


class _Split:
    """Inflated bytes of one split, worked on as they come."""

    def __init__(self, path: str, start: int) -> None:
        self.path, self.start, self.data, self.found = path, start, bytearray(), False

    def feed(self, block: bytes) -> Iterator[pa.RecordBatch]:
        self.data += inflate(block)
        if len(self.data) >= 4 * BLOCK:
            yield from self._work(False)

    def _begin(self, whole: bool) -> int | None:
        try:
            return header(bytes(self.data))[1] if self.start == 0 else first_start(bytes(self.data), whole)
        except Incomplete:
            if whole and self.start == 0:
                raise ValueError(f"the header of {self.path} must lie in its first split") from None
            raise

    def _work(self, whole: bool) -> Iterator[pa.RecordBatch]:
        at = 0
        if not self.found:
            if not whole and self.start and len(self.data) < 2 * CHAIN:
                return
            try:
                begin = self._begin(whole)
            except Incomplete:
                return
            if begin is None:
                if whole:
                    yield _edge(self.path, self.start, 1, bytes(self.data), False)
                    self.data.clear()
                return
            self.found, at = True, begin
            yield _edge(self.path, self.start, 1, bytes(self.data[:begin]) if self.start else b"", True)
        data = bytes(self.data)
        rows, rest = parsed(data, at, len(data))
        for k in range(0, len(rows), BATCH):
            yield _batch(rows[k : k + BATCH], self.path, self.start)
        del self.data[:rest]

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.data or not self.found:
            yield from self._work(True)
        if self.found:
            yield _edge(self.path, self.start, 2, bytes(self.data), True)


def _of_splits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split = None
    for batch in batches:
        for path, start, block in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if split is None or (path, start) != (split.path, split.start):
                if split is not None:
                    yield from split.close()
                split = _Split(path, start)
            if block:
                yield from split.feed(block)
    if split is not None:
        yield from split.close()


def _of_edges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, pieces in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = b"".join(p["edge"] for p in pieces)
            rows, rest = parsed(data, 0, len(data))
            if rest != len(data):
                raise ValueError(f"the records of {path} don't fit together: it is damaged or cut off, or a split's first record was not found")
            yield _batch(rows, path, 0)


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.options(**_TEXT).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("block"))


def _names(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, ref, rname of the headers in first splits."""
    data: dict[str, bytearray | None] = {}
    for batch in batches:
        for path, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = data.setdefault(path, bytearray())
            if own is None or not block:
                continue
            own += inflate(block)
            try:
                names = header(bytes(own))[0]
            except Incomplete:
                continue
            data[path] = None
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(names), pa.string()), pa.array(np.arange(len(names), dtype=np.int32)), pa.array(names, pa.string())], names=["path", "ref", "rname"])


def read_bam(spark: SparkSession, path: str, save: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """qname, flag, rname, pos0, cigar, ops, seq, qual of a BAM file or folder of them, in splits of ``spark.sql.files.maxPartitionBytes``.

    ``save`` writes the decoded splits to durable storage and reads them again, so that files are inflated once;
    without it their edges are read by a second pass.
    """
    blocks = _blocks(spark, path)
    found = blocks.mapInArrow(_of_splits, _SCHEMA)
    found = save(found, "bam") if save else found
    columns = _SCHEMA.split(", ")[:7]
    names = [c.split()[0] for c in columns]
    edges = found.where("part > 0").select("path", "split", "part", "edge", "starts")
    # an edge belongs to the last record start before it: a split's first part to an earlier split's, its second to its own
    before = F.count_if(F.col("starts") & (F.col("part") == 1)).over(Window.partitionBy("path").orderBy("split", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    run = edges.select("path", "split", "part", "edge", (before - (F.col("starts") & (F.col("part") == 1)).cast("long")).alias("run")).where("octet_length(edge) > 0")
    joined = run.groupBy("path", "run").agg(F.sort_array(F.collect_list(F.struct("split", "part", "edge"))).alias("pieces")).select("path", "pieces")
    rows = found.where("part = 0").select(*names, "path").unionByName(joined.mapInArrow(_of_edges, _SCHEMA).select(*names, "path"))
    refs = blocks.where("split = 0").select("path", "block").mapInArrow(_names, "path string, ref int, rname string")
    named = rows.join(refs, ["path", "ref"], "left").withColumn("rname", F.coalesce("rname", F.lit("*")))
    return named.select("qname", "flag", "rname", "pos0", "cigar", cigar_ops(F.col("cigar")).alias("ops"), "seq", "qual")


def record(name: str, flag: int, ref: int, pos: int, cigar: list[tuple[int, str]], seq: str, qual: str) -> bytes:
    """One record; mapping quality, bin and mate are left at their unknown values."""
    size = sum(n for n, op in cigar if op in "MDN=X")
    packed = struct.pack(f"<{len(cigar)}I", *(n << 4 | OPS.index(op) for n, op in cigar))
    codes = [BASES.find(b) if b in BASES else 15 for b in seq.upper()] + [0] * (len(seq) % 2)
    bases = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
    quals = bytes(ord(q) - 33 for q in qual) if qual else b"\xff" * len(seq)
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 255, _bin(pos, pos + max(size, 1)), len(cigar), flag, len(seq), -1, -1, 0) + name.encode("latin-1") + b"\0" + packed + bases + quals
    return struct.pack("<i", len(body)) + body


def _bin(begin: int, end: int) -> int:
    """Number of the smallest of the nested intervals (of 2^14 to 2^29 bases, eight in each larger one) that holds [begin, end)."""
    for level, shift in enumerate(range(14, 29, 3)):
        if begin >> shift == (end - 1) >> shift:
            return ((1 << (15 - 3 * level)) - 1) // 7 + (begin >> shift)
    return 0


def write_bam(records: DataFrame, path: str, references: list[tuple[str, int]]) -> None:
    """Write rows (qname, flag, rname, pos0, ops, seq, qual) as a folder of BAM files, one a partition, with these references (name, length)."""
    text = "".join(f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in references).encode()
    start = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(references))
    start += b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in references)
    number = {n: k for k, (n, _) in enumerate(references)}

    def raw(data: bytes) -> pa.RecordBatch:
        """As a string column whose bytes are ``data``, whatever they mean as text."""
        own = deflate(data)
        return pa.RecordBatch.from_arrays([pa.StringArray.from_buffers(1, pa.py_buffer(np.array([0, len(own)], np.int32)), pa.py_buffer(own))], names=["value"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield raw(start)
        held = bytearray()
        for batch in batches:
            for r in batch.to_pylist():
                held += record(r["qname"], r["flag"], number.get(r["rname"], -1), r["pos0"], [(x["len"], x["op"]) for x in r["ops"] or []], r["seq"] or "", r["qual"] or "")
                if len(held) >= 16 * BLOCK:
                    yield raw(bytes(held))
                    held.clear()
        if held:
            yield raw(bytes(held))

    rows = records.select("qname", "flag", "rname", "pos0", "ops", "seq", "qual").mapInArrow(run, "value string")
    rows.write.option("lineSep", EMPTY_BLOCK.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)

