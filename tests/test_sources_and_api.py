import gzip
import random
import struct

import pytest

from strandwise import cli, sources
from strandwise.api import Dataset, Parameters, Toolkit
from strandwise.plans import readset
from strandwise.sources.reads import ReadsSource, both_strands_text
from strandwise.streaming.kmer_stream import stream_counts, stream_reads


def test_fasta_and_fastq(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">r1 x\nacgt\n>r2\nTTTT\n")
    (tmp_path / "a.fq").write_text("@r1\nacgt\n+\n@III\n@r2\nTTTT\n+\nIIII\n")
    a = sources.read_reads(spark, str(tmp_path / "a.fa")).orderBy("read_id").collect()
    assert [(r.name, r.seq, r.qual) for r in a] == [("r1 x", "ACGT", None), ("r2", "TTTT", None)]
    b = sources.read_reads(spark, str(tmp_path / "a.fq"))
    assert [(r.name, r.seq, r.qual) for r in b.orderBy("read_id").collect()] == [("r1", "ACGT", "@III"), ("r2", "TTTT", "IIII")]
    sources.write_reads(b, str(tmp_path / "out"), order="read_id", files=1)
    again = sources.read_reads(spark, str(tmp_path / "out")).orderBy("read_id")
    assert again.collect() == b.orderBy("read_id").collect()
    assert both_strands_text(b).orderBy("value").first()[0] == "ACGT$ACGT$"
    (tmp_path / "bad.fa").write_text("r1\nacgt\n")
    with pytest.raises(Exception, match="neither"):
        sources.read_reads(spark, str(tmp_path / "bad.fa")).collect()


def test_split_source(spark, tmp_path):
    spark.dataSource.register(ReadsSource)
    (tmp_path / "a.fq").write_text("".join(f"@r{i}\nACGT{'A' * (i % 7)}\n+\n@{'I' * (3 + i % 7)}\n" for i in range(200)))
    rows = spark.read.format("sequencing-reads").option("path", str(tmp_path / "a.fq")).option("split", "97").load()
    assert sorted(int(r.name[1:]) for r in rows.collect()) == list(range(200))
    (tmp_path / "a.fa").write_text("".join(f">r{i}\nACGT{'A' * (i % 7)}\n" for i in range(200)))
    rows = spark.read.format("sequencing-reads").option("path", str(tmp_path / "a.fa")).option("split", "61").load()
    assert sorted(int(r.name[1:]) for r in rows.collect()) == list(range(200))


def test_fasta_in_splits(spark, tmp_path):
    (tmp_path / "a.fa").write_text("".join(f">r{i} x\nacgt\n{'A' * (i % 7)}\n" for i in range(500)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = sources.read_fasta(spark, str(tmp_path / "a.fa"))
        assert rows.rdd.getNumPartitions() > 1
        got = rows.orderBy("read_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [(r.name, r.seq) for r in got] == [(f"r{i} x", "ACGT" + "A" * (i % 7)) for i in range(500)]
    assert len({r.read_id for r in got}) == 500


@pytest.mark.parametrize("size", ["61", "1k", "1m"])
def test_reads_and_genomes_in_splits(spark, tmp_path, size):
    """Ids count all records over files and splits; records and chunks over an edge, or over several, are whole."""
    rng = random.Random(1)
    text = lambda n: "".join(rng.choices("ACGTn", k=n))
    reads = [(f"r{i} x", text(rng.choice([0, 3, 9, 200])), None) for i in range(150)]
    marked = [(f"q{i}", s, "".join(rng.choices("@>+I", k=len(s)))) for i, s in enumerate(text(rng.choice([1, 4, 30, 90])) for _ in range(150))]
    (tmp_path / "a.fa").write_text("".join(f">{n}\n{s}\n" for n, s, _ in reads))
    (tmp_path / "b.fq").write_text("".join(f"@{n}\r\n{s}\r\n+\r\n{q}\r\n" for n, s, q in marked))
    genome = text(3000)
    (tmp_path / "g.txt").write_text(">g some\n" + "\n".join(genome[k : k + 70] for k in range(0, 3000, 70)) + "\n\n")
    (tmp_path / "none.txt").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = sources.read_reads(spark, f"{tmp_path}/*.f*")
        plan = rows._jdf.queryExecution().executedPlan().toString()
        got = rows.orderBy("read_id").collect()
        for chunk in (32, 7, 5000):
            found = sources.read_genome(spark, str(tmp_path / "g.txt"), chunk=chunk).orderBy("idx").collect()
            assert [(r.idx, r.bases) for r in found] == [(k, genome.upper()[k * chunk : (k + 1) * chunk]) for k in range(-(-3000 // chunk))]
        with pytest.raises(Exception, match="exactly one record"):
            sources.read_genome(spark, str(tmp_path / "none.txt")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [(r.name, r.seq, r.qual) for r in got] == [(n, s.upper(), q) for n, s, q in reads + marked]
    assert [r.read_id for r in got] == list(range(300))
    assert plan.count("hashpartitioning(read_id") == 1 and "SortMergeJoin" not in plan  # lines at the splits' edges alone


def test_genome(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">g\nacgt\nACGT\nA\n")
    assert [r.bases for r in sources.read_genome(spark, str(tmp_path / "g.fa"), chunk=4).orderBy("idx").collect()] == ["ACGT", "ACGT", "A"]
    (tmp_path / "two.fa").write_text(">g\nacgt\n>h\nA\n")
    with pytest.raises(Exception, match="exactly one record"):
        sources.read_genome(spark, str(tmp_path / "two.fa")).collect()
    with pytest.raises(ValueError):
        sources.read_genome(spark, "")


SAM = "@HD\tVN:1\nr1\t16\tg\t3\t60\t2S3M\t*\t0\t0\tACGTT\tABCDE\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tAAA\t*\nr3\t0\tg\t1\t9\t3M\t*\t0\t0\tAAA\tIII\nr3\t2048\tg\t9\t9\t2H1M\t*\t0\t0\tA\tI\n"


def test_sam(spark, tmp_path):
    (tmp_path / "a.sam").write_text(SAM)
    rows = sources.read_sam(spark, str(tmp_path / "a.sam"))
    assert rows.count() == 4
    totals = sources.read_totals(rows).head()
    assert (totals.total, totals.mapped, totals["unique"]) == (3, 2, 2)
    reads = {r.qname: r for r in sources.reads_with_alignments(rows).collect()}
    assert (reads["r1"].seq, reads["r1"].qual, reads["r1"].begin_pos, reads["r1"].end_pos) == ("AACGT", "EDCBA", 2, 6)
    assert len(reads["r3"].records) == 2


def test_bam(spark, tmp_path):
    name, seq = b"r1\0", bytes([0x12, 0x48])
    body = struct.pack("<iiBBHHHiiii", 0, 2, len(name), 60, 0, 1, 16, 4, -1, -1, 0) + name + struct.pack("<I", 4 << 4) + seq + bytes([1, 2, 3, 4])
    data = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 2) + b"g\0" + struct.pack("<i", 99) + struct.pack("<i", len(body)) + body
    (tmp_path / "a.bam").write_bytes(gzip.compress(data[:20]) + gzip.compress(data[20:]))
    row = sources.read_bam(spark, str(tmp_path / "a.bam")).head()
    assert (row.qname, row.flag, row.rname, row.pos0, row.cigar, row.seq, row.qual) == ("r1", 16, "g", 2, "4M", "ACGT", '"#$%')


def test_small_tables(spark, tmp_path):
    counts = spark.createDataFrame([("ACG", 3), ("TTT", 1)], "kmer string, cnt long")
    sources.store_counts_text(counts, str(tmp_path / "c"))
    assert sorted(sources.load_counts_text(spark, str(tmp_path / "c")).collect()) == sorted(counts.collect())
    points = spark.createDataFrame([(2.0, 5.0), (1.0, 5.0)], "a double, b double")
    rows, ranges = sources.plot_points(points, "a", "b")
    assert [r.x for r in rows.collect()] == [1.0, 2.0] and ranges == {"x": (1.0, 2.0), "y": (4.0, 6.0)}
    sources.write_plot(points, "a", "b", str(tmp_path / "p"))
    (tmp_path / "s.gnu").write_text("set x\nplot '-' with lines\n1 2\n3 4\ne\n")
    assert sorted(tuple(r) for r in sources.read_plot_script(spark, str(tmp_path / "s.gnu")).collect()) == [(1.0, 2.0), (3.0, 4.0)]


@pytest.mark.parametrize(
    "args",
    [["-o", "x"], ["-o", "x", "-d", "-r", "y"], ["-o", "x", "-n", "-r", "y", "-l"], ["-o", "x", "-n", "-r", "y", "-l", "-c", "-a", "NONE"], ["-o", "x", "-n", "-r", "y", "-l", "-a", "NONE"], ["-o", "x", "-e", "-r", "y", "-l"]],
)
def test_command_line_checks(args):
    with pytest.raises(ValueError):
        cli.validated(cli.parser().parse_args(args))


def test_parameters():
    assert Parameters().min_k == 31
    with pytest.raises(ValueError):
        Parameters(algorithm="X")
    with pytest.raises(ValueError):
        Parameters(min_k=0)


def test_toolkit(spark, sf_dir):
    reads = readset.reads(spark, sf_dir)
    tools = Toolkit(Dataset(reads, readset.genome_size(spark, sf_dir)), Parameters(15, "SIMPLE_KMER"))
    kinds = {r["class"] for r in tools.classify_kmers(spark.createDataFrame([("A" * 15,), ("ACGTACGT",)], "kmer string")).collect()}
    assert kinds <= {0, 1, 2}
    sums = tools.kmer_confusion(readset.genome_reads(spark, sf_dir, 15), 15).groupBy().sum("n").head()[0]
    assert sums == 35 * reads.count()
    fixed = tools.correct().join(reads.withColumnRenamed("seq", "was"), "rid").join(readset.placements(spark, sf_dir), "rid")
    changed = fixed.where("seq <> was")
    right = changed.where("(strand = 0 and seq = window) or (strand = 1 and seq = reverse(translate(window, 'ACGT', 'TGCA')))")
    assert fixed.count() == reads.count()
    assert right.count() > 0.9 * changed.count() > 150


def test_stream(spark, sf_dir, tmp_path):
    readset.reads(spark, sf_dir).limit(100).repartition(3).write.parquet(str(tmp_path / "in"))
    q = stream_counts(stream_reads(spark, str(tmp_path / "in")), 15).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(cnt) FROM counts").head()[0] == 100 * 36


@pytest.mark.parametrize("split", ["128m", "1000b", "777b"])
def test_reads_of_several_files_in_splits(spark, tmp_path, split):
    """FASTQ with @ and + in qualities, and FASTA with empty lines at its end: the same rows and ids however files are split."""
    rng, want = random.Random(1), []
    for name in ("a.fq", "b.fq"):
        with open(tmp_path / name, "w") as file:
            for i in range(200):
                seq = "".join(rng.choices("acgt", k=rng.randint(1, 80)))
                qual = "".join(rng.choices("@+I", k=len(seq)))
                file.write(f"@{name}.{i} x\n{seq}\n+\n{qual}\n")
                want.append((len(want), f"{name}.{i} x", seq.upper(), qual))
    (tmp_path / "c.fa").write_bytes(b">a\r\nACg\r\n>b\r\nTT\r\n\r\n")
    want += [(400, "a", "ACG", None), (401, "b", "TT", None)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        assert sorted(map(tuple, sources.read_reads(spark, str(tmp_path)).collect())) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_correction_goes_on_past_any_number_of_rounds():
    """A read with more errors than rounds were once allowed; and one whose fixes would lead in a circle ends."""
    import plain_correction

    rng = random.Random(2)
    genome = "".join(rng.choices("ACGT", k=6000))
    turn = str.maketrans("ACGT", "TGCA")
    k, wrong = 15, list(genome)
    for at in range(20, 5980, 40):
        wrong[at] = rng.choice([b for b in "ACGT" if b != genome[at]])

    class All(dict):
        """Unique where the genome has the k-mer, else untrusted."""

        def __contains__(self, kmer):
            return True

        def __getitem__(self, kmer):
            return 1 if kmer in genome or kmer.translate(turn)[::-1] in genome else 0

    assert sum(a != b for a, b in zip(wrong, genome, strict=True)) > 140
    assert plain_correction.correct_simple("".join(wrong), k, plain_correction.Known(All()), indels=False) == genome
