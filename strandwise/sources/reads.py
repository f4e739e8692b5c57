"""FASTA and FASTQ."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from strandwise.functions.sequence import reverse_complement


class _Span(InputPartition):
    def __init__(self, path: str, begin: int, end: int) -> None:
        self.path, self.begin, self.end = path, begin, end


class ReadsSource(DataSource):
    """Files cut into byte ranges at record boundaries: option ``path``, ``split`` (bytes, 64 MiB).

    For files that every executor can open; others go through ``read_reads``.
    """

    @classmethod
    def name(cls) -> str:
        return "sequencing-reads"

    def schema(self) -> str:
        return "read_id long, name string, seq string, qual string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ReadsReader(self.options)


class _ReadsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.split = options["path"], int(options.get("split", 64 << 20))

    def partitions(self) -> list[InputPartition]:
        import os

        size = os.path.getsize(self.path)
        return [_Span(self.path, b, min(size, b + self.split)) for b in range(0, max(size, 1), self.split)]

    def read(self, partition: _Span) -> Iterator[tuple]:
        with open(partition.path, "rb") as file:
            first = file.read(1)
            lines = {b"@": 4, b">": 2}.get(first)
            if not first:
                return
            if lines is None:
                raise ValueError("a record begins neither with @ nor with >")
            file.seek(max(0, partition.begin - 1))
            if partition.begin:
                file.readline()  # to the next line's begin
                _to_record(file, lines)
            while file.tell() < partition.end:
                at = file.tell()
                record = [file.readline().rstrip(b"\r\n").decode() for _ in range(lines)]
                if not record[0]:
                    break
                yield at, record[0][1:], record[1].upper(), record[3] if lines == 4 else None


def _to_record(file, lines: int) -> None:  # noqa: ANN001
    """Go on to a line that begins a record: for FASTQ one with @ whose next but one begins with +."""
    while True:
        at = file.tell()
        line = file.readline()
        if not line:
            return
        if lines == 2 and line[:1] == b">":
            file.seek(at)
            return
        if lines == 4 and line[:1] == b"@":
            file.readline()
            if file.readline()[:1] == b"+":
                file.seek(at)
                return
            file.seek(at)
            file.readline()


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """The rows of each split of a file (columns file and block), batch by batch, and whether a batch is its split's first one."""
    last = None
    for batch in batches:
        file, block = batch.column(0).dictionary_encode().indices.to_numpy(), batch.column(1).to_numpy()
        begin = np.concatenate([[0], np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1, [batch.num_rows]]) if batch.num_rows else []
        for a, b in zip(begin[:-1], begin[1:], strict=True):
            key = batch.column(0)[a].as_py(), int(block[a])
            yield batch.slice(a, b - a), key != last
            last = key


_PARTS = "read_id long, per int, part int, head string, seq string, qual string"
_PART_NAMES = [c.split()[0] for c in _PARTS.split(", ")]


def _whole_records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, block, value, first, per, start) of lines: a row (part null) for each record whose lines lie in one split, and the
    other lines one by one, with their part. ``first``: the number of the split's first line in its file; ``start``: records in files before."""

    def rows(read_id: np.ndarray, per: int, part: pa.Array, *columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(read_id), pa.array(np.full(len(read_id), per, np.int32)), part, *columns], names=_PART_NAMES)

    def single(values: pa.Array, line: int, per: int, start: int) -> pa.RecordBatch:
        number = np.arange(line, line + len(values))
        none = pa.nulls(len(values), pa.string())
        return rows(start + number // per, per, pa.array((number % per).astype(np.int32)), values, none, none)

    held, line, per, start = pa.array([], pa.string()), 0, 1, 0
    for batch, is_first in _runs(batches):
        if is_first:
            if len(held):
                yield single(held, line, per, start)
            line, per, start = (batch.column(k)[0].as_py() for k in (3, 4, 5))
            held = pa.array([], pa.string())
        values = pa.concat_arrays([held, batch.column(2).cast(pa.string())])
        skip = min(-line % per, len(values))  # lines of a record that began in the split before
        if skip:
            yield single(values[:skip], line, per, start)
        count = (len(values) - skip) // per
        at = skip + per * np.arange(count)
        if count:
            take = lambda k: values.take(pa.array(at + k))  # noqa: B023, E731
            yield rows(start + (line + at) // per, per, pa.nulls(count, pa.int32()), take(0), take(1), take(3) if per == 4 else pa.nulls(count, pa.string()))
        held, line = values[skip + per * count :], line + skip + per * count
    if len(held):
        yield single(held, line, per, start)


def read_reads(spark: SparkSession, path: str, quality: bool = True) -> DataFrame:
    """read_id, name, seq (upper case), qual of FASTA (two lines a record) or FASTQ (four) files.

    A file's first character says which it is. A wrong header, or asking for quality of a FASTA
    file, is an error. Read by Spark's text reader, which splits files of any size in any storage. A first pass counts
    the lines of each split; with the lines before it a split's task knows where its first record begins and puts its lines
    together itself. Only lines of records over a split's edge meet others by a shuffle. Ids count all records, in the
    order of the files' paths and of the records.
    """
    own = F.col("_metadata")
    text = spark.read.text(path)
    lines = text.select(own["file_path"].alias("file"), own["file_block_start"].alias("block"), "value")
    # a number, not the character: of sums with text in them Spark would sort all lines
    head = F.min_by(F.when(F.col("block") == 0, F.ascii(F.substring("value", 1, 1))), F.when(F.col("block") == 0, F.col("at")))
    splits = lines.withColumn("at", F.monotonically_increasing_id()).groupBy("file", "block").agg(F.count("*").alias("n"), head.alias("line"))
    before = Window.partitionBy("file").orderBy("block")
    whole = before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    splits = splits.select("file", "block", F.coalesce(F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"), F.sum("n").over(whole).alias("lines"), F.max("line").over(whole).alias("head"))
    per = F.when(F.col("head") == ord("@"), 4).when(F.col("head") == ord(">"), 2).otherwise(F.raise_error(F.lit("a record begins neither with @ nor with >")).cast("int"))
    splits = splits.where("head <> 0 or lines > 1").withColumn("per", per)
    files = splits.groupBy("file").agg(F.ceil(F.first("lines") / F.first("per")).cast("long").alias("records"))
    files = files.select(F.col("file").alias("of"), F.coalesce(F.sum("records").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    splits = splits.join(files, F.col("file") == F.col("of")).select(F.col("file").alias("of"), F.col("block").alias("in"), "first", "per", "start")
    # a row for each split, that is for spark.sql.files.maxPartitionBytes of text: small beside what a task reads
    placed = lines.join(F.broadcast(splits), (F.col("file") == F.col("of")) & (F.col("block") == F.col("in"))).select("file", "block", F.regexp_replace("value", "\r$", "").alias("value"), "first", "per", "start")
    found = placed.mapInArrow(_whole_records, _PARTS)
    line = lambda k: F.max(F.when(F.col("part") == k, F.col("head")))
    met = found.where("part is not null").groupBy("read_id").agg(F.max("per").alias("per"), line(0).alias("head"), line(1).alias("seq"), line(3).alias("qual"))
    records = found.where("part is null").select("read_id", "per", "head", "seq", "qual").unionByName(met)
    records = records.where("head <> '' or coalesce(seq, '') <> ''")  # empty lines at the end are none
    mark = F.when(F.col("per") == 4, "@").otherwise(">")
    head = F.when(F.substring("head", 1, 1) == mark, F.col("head")).otherwise(F.raise_error(F.concat(F.lit("not a header: "), F.col("head"))).cast("string"))
    qual = F.col("qual") if quality else F.lit(None).cast("string")
    return records.select("read_id", F.substring(head, F.lit(2), F.length(head)).alias("name"), F.upper("seq").alias("seq"), qual.alias("qual"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """read_id, name, seq (upper case), qual (null) of FASTA files of any size, in any storage.

    Spark's text source splits the files at '>' line begins, so long files are shared out; sequences
    may run over several lines. Ids are unique and in the order of the splits, not consecutive.
    """
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("r")).where("trim(r) <> ''")
    name = F.regexp_replace(F.substring_index("r", "\n", 1), "\r$", "")
    body = F.regexp_replace(F.regexp_replace("r", "^[^\n]*", ""), r"\s", "")
    return records.select(F.monotonically_increasing_id().alias("read_id"), name.alias("name"), F.upper(body).alias("seq"), F.lit(None).cast("string").alias("qual"))


def require_quality(reads: DataFrame) -> DataFrame:
    """Reads all of which have a quality; one without is an error."""
    return reads.withColumn("qual", F.coalesce("qual", F.raise_error(F.lit("FASTA has no quality")).cast("string")))


_CHUNKS = "idx long, begin int, bases string, whole boolean"


def _whole_chunks(batches: Iterable[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """Rows (file, block, value, first) of sequence lines: the chunks that lie in one split, and the beginnings and ends of others.
    ``first``: the place of the split's first base."""

    def rows(text: bytes, place: int, sizes: np.ndarray, whole: bool) -> pa.RecordBatch:
        begin = place + np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        bases = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(bounds), pa.py_buffer(text))
        return pa.RecordBatch.from_arrays([pa.array(begin // chunk), pa.array((begin % chunk).astype(np.int32)), bases, pa.array(np.full(len(sizes), whole))], names=["idx", "begin", "bases", "whole"])

    held, place = b"", 0
    for batch, is_first in _runs(batches):
        if is_first:
            if held:
                yield rows(held, place, np.array([len(held)]), False)
            held, place = b"", batch.column(3)[0].as_py()
        held += "".join(batch.column(2).to_pylist()).encode("latin-1", "replace")
        skip = min(-place % chunk, len(held))  # the rest of a chunk that began before
        if skip:
            yield rows(held[:skip], place, np.array([skip]), False)
        held, place = held[skip:], place + skip
        if count := len(held) // chunk:
            yield rows(held[: count * chunk], place, np.full(count, chunk), True)
            held, place = held[count * chunk :], place + count * chunk
    if held:
        yield rows(held, place, np.array([len(held)]), False)


def read_genome(spark: SparkSession, path: str, chunk: int = 32) -> DataFrame:
    """idx, bases: the one record of a FASTA file, upper case, lines joined, cut into chunks; no record or a second one is an error.

    Of a folder the files in the order of their paths hold the record.

    The file is read in splits. A first pass adds up the bases of each split; the sums before it tell a split's task
    the place of its first base, so that it cuts its chunks itself; only chunks over a split's edge meet by a shuffle.
    """
    if not path:
        raise ValueError("no genome file given")
    own = F.col("_metadata")
    lines = spark.read.text(path).select(own["file_path"].alias("file"), own["file_block_start"].alias("block"), F.col("value").startswith(">").alias("header"), F.upper(F.regexp_replace("value", r"\s", "")).alias("value"))
    is_first = F.col("block") == 0
    begin = F.min_by(F.when(is_first, F.col("header")), F.when(is_first, F.col("at")))
    splits = lines.withColumn("at", F.monotonically_increasing_id()).groupBy("file", "block").agg(F.sum(F.when(~F.col("header"), F.length("value")).otherwise(0)).alias("n"), F.count_if("header").alias("headers"), begin.alias("begins"))
    before = Window.orderBy("file", "block")  # of rows that each stand for a split
    splits = splits.select("file", "block", F.col("file").alias("of"), F.col("block").alias("in"), F.coalesce(F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"), "headers", "begins")
    checked = splits.agg((F.coalesce(F.sum("headers"), F.lit(0)) == 1).alias("one"), F.coalesce(F.min_by("begins", F.struct("file", "block")), F.lit(False)).alias("begins"))
    wrong = F.raise_error(F.lit("a genome file holds exactly one record"))
    failed = checked.where("not (one and begins)").select(wrong.cast("long").alias("idx"), F.lit("").alias("bases"))
    placed = lines.where(~F.col("header")).join(F.broadcast(splits.drop("file", "block")), (F.col("file") == F.col("of")) & (F.col("block") == F.col("in"))).select("file", "block", "value", "first")
    found = placed.mapInArrow(lambda it: _whole_chunks(it, chunk), _CHUNKS)
    met = found.where("not whole").groupBy("idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("begin", "bases"))), lambda x: x["bases"]), "").alias("bases"))
    return found.where("whole").select("idx", "bases").unionByName(met).unionByName(failed)


def record_text(reads: DataFrame) -> DataFrame:
    """One string column: FASTQ where there is a quality, else FASTA."""
    name, seq, qual = F.col("name"), F.col("seq"), F.col("qual")
    fasta = F.concat(F.lit(">"), name, F.lit("\n"), seq)
    fastq = F.concat(F.lit("@"), name, F.lit("\n"), seq, F.lit("\n+\n"), qual)
    return reads.select(F.when(F.coalesce(qual, F.lit("")) != "", fastq).otherwise(fasta).alias("value"))


def write_reads(reads: DataFrame, path: str, order: str | None = None, files: int | None = None, tasks: int | None = None) -> None:
    """Write records as text files, replacing what is there; ``order`` sorts them (all in one file with files=1), in ``tasks`` ranges."""
    rows = reads if "qual" in reads.columns else reads.withColumn("qual", F.lit(None).cast("string"))
    if order:
        rows = rows.repartitionByRange(tasks, order).sortWithinPartitions(order) if tasks else rows.orderBy(order)
    out = record_text(rows)
    (out.coalesce(files) if files else out).write.mode("overwrite").text(path)


def both_strands_text(reads: DataFrame) -> DataFrame:
    """One string for each read: its sequence and its reverse complement, each closed by $."""
    return reads.select(F.concat(F.col("seq"), F.lit("$"), reverse_complement(F.col("seq")), F.lit("$")).alias("value"))
