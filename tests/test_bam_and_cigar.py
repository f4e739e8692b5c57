"""BAM in splits, and the fold of operations against a plain walk."""

import gzip
import random
import re
from pathlib import Path

import pytest
from plain import record_errors
from pyspark.sql import functions as F

from strandwise.functions.sequence import cigar_ops
from strandwise.operators.cigar import with_record_errors
from strandwise.plans import readset
from strandwise.sources import bam, read_bam, write_bam

COLUMNS = ["qname", "flag", "rname", "pos0", "cigar", "seq", "qual"]


@pytest.fixture
def split_size(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")

    def set_to(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield set_to
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def records_of(spark, rows):
    df = spark.createDataFrame(rows, "qname string, flag int, rname string, pos0 long, cigar string, seq string, qual string")
    return df.withColumn("ops", cigar_ops(F.col("cigar")))


def tuples(df):
    return sorted(tuple(r) for r in df.select(COLUMNS).collect())


@pytest.mark.parametrize("size", ["64k", "1m", "1g"])
def test_same_rows_for_all_split_sizes(spark, tmp_path, split_size, size):
    rows = readset.gapped_alignments(spark, "/root/testdata/sf0.01").withColumn("rname", F.lit("genome")).withColumn("ops", cigar_ops(F.col("cigar")))
    rows = rows.withColumn("qual", F.translate("seq", "ACGT", "5:?I")).unionByName(rows.withColumn("qname", F.concat(F.lit("h"), "rid")).withColumn("qual", F.lit("")))
    write_bam(rows.repartition(1), str(tmp_path / "a.bam"), [("other", 5), ("genome", 64000)])
    split_size(size)
    assert bam._blocks(spark, str(tmp_path / "a.bam")).rdd.getNumPartitions() >= {"64k": 10, "1m": 1, "1g": 1}[size]
    assert tuples(read_bam(spark, str(tmp_path / "a.bam"))) == tuples(rows)


def test_records_longer_than_splits(spark, tmp_path, split_size):
    """Reads of 300 kb over splits of 16 kb, with short ones between them; two files, the second without records."""
    rng = random.Random(2)
    text = lambda n: "".join(rng.choices("ACGTN", k=n))
    rows = []
    for k in range(12):
        n = 300_000 if k % 4 == 1 else rng.randint(0, 60)
        rows.append((f"q{k}", (k % 2) * 16, "g" if n else "*", k if n else -1, f"{n}M" if n else "", text(n), "".join(rng.choices("!5~", k=n))))
    write_bam(records_of(spark, rows).coalesce(1), str(tmp_path / "a"), [("g", 1 << 20)])
    write_bam(records_of(spark, []).coalesce(1), str(tmp_path / "b"), [])
    split_size("16k")
    assert tuples(read_bam(spark, str(tmp_path / "a"))) == sorted(rows)
    assert read_bam(spark, str(tmp_path / "b")).count() == 0
    assert tuples(read_bam(spark, f"{tmp_path}/{{a,b}}")) == sorted(rows)


def test_blocks_are_gzip_members(spark, tmp_path):
    write_bam(records_of(spark, [("q", 4, "*", -1, "", "ACG", "")]), str(tmp_path / "a"), [("g", 9)])
    (file,) = [f for f in Path(tmp_path / "a").glob("part-*") if b"q\0" in gzip.open(f).read()]
    raw = file.read_bytes()
    assert raw.endswith(bam.EMPTY_BLOCK) and gzip.decompress(raw)[:4] == b"BAM\1"
    (tmp_path / "plain.bam").write_bytes(gzip.compress(gzip.decompress(raw)))
    assert tuples(read_bam(spark, str(tmp_path / "plain.bam"))) == [("q", 4, "*", -1, "", "ACG", "")]


def test_damaged_files_fail(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"q{k}", 0, "g", k, "50M", "".join(rng.choices("ACGT", k=50)), "I" * 50) for k in range(5000)]
    write_bam(records_of(spark, rows).coalesce(1), str(tmp_path / "a"), [("g", 9999)])
    (file,) = Path(tmp_path / "a").glob("part-*")
    raw = file.read_bytes()
    blocks = [m.start() for m in re.finditer(re.escape(bam.BLOCK_START), raw)]
    (tmp_path / "cut.bam").write_bytes(raw[: blocks[4]])
    (tmp_path / "flipped.bam").write_bytes(raw[: blocks[3] + 40] + bytes([raw[blocks[3] + 40] ^ 1]) + raw[blocks[3] + 41 :])
    (tmp_path / "no.bam").write_bytes(b"no bam at all")
    for name in ("cut", "flipped", "no"):
        with pytest.raises(Exception):  # noqa: B017
            read_bam(spark, str(tmp_path / f"{name}.bam")).collect()


def test_fold_of_operations(spark):
    """Random operations, also senseless ones, on random bases of both strands."""
    rng = random.Random(5)
    text = lambda n: "".join(rng.choices("ACGTACGTN", k=n))
    rows = []
    for k in range(400):
        ops = [(op, rng.choice([0, 1, 1, 2, 3, 7])) for op in rng.choices("MMM=XIIDDSHNP", k=rng.randint(0, 7))]
        n = sum(x for op, x in ops if op in "M=XIS") + rng.choice([0, 0, 0, -1, 2])
        genome = text(max(0, sum(x for op, x in ops if op in "M=XDN") + rng.choice([0, 0, -1, 1])))
        seq = "".join(rng.choice([g, g, g, "A"]) for g in genome)[: max(n, 0)].ljust(max(n, 0), "C")
        rows.append((k, rng.choice([0, 16]), ops, seq, genome))
    rows += [(1000, 16, [], "", ""), (1001, 0, None, "AC", None), (1002, 0, [("M", 2)], None, "AC")]
    df = spark.createDataFrame(rows, "id int, flag int, ops array<struct<op: string, len: int>>, seq string, window string")
    for r in with_record_errors(df).collect():
        want = record_errors(r.seq or "", [(x.op, x.len) for x in r.ops or []], r.window or "", bool(r.flag & 16))
        assert [tuple(e) for e in r.errors] == want, r
    with pytest.raises(Exception, match="unmapped"):
        with_record_errors(df.withColumn("flag", F.lit(4))).collect()


def test_fold_stays_in_the_jvm(spark, sf_dir):
    rows = readset.gapped_alignments(spark, sf_dir).withColumn("ops", cigar_ops(F.col("cigar")))
    plan = with_record_errors(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
