"""k-mers counted as numbers in a given number of tasks, and reads that are shuffled before they get their bases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from strandwise.functions.sequence import number_kmer, packed_kmer
from strandwise.operators import coverage, evaluate, kmers
from strandwise.plans import queries, readset


def rows(df):
    return sorted(map(repr, df.collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(5)
    found = ["".join(r.choice("ACGT") for _ in range(r.randint(0, 40))) for _ in range(300)]
    found += ["ACGTN" * 5, "acgtACGT" * 3, "éACGTTGCA", "", None, "ACGT", "AACCGGTT"] + found[:50]
    return spark.createDataFrame([(i, x) for i, x in enumerate(found)], "rid long, seq string").repartition(3)


@pytest.mark.parametrize("ks", [[4], [5, 8], [1], [15, 30]])
def test_counts_as_numbers_are_those_of_texts(spark, texts, ks, monkeypatch):
    monkeypatch.setattr(kmers, "HELD_WINDOWS", 100)
    want = kmers.count_both_strands(texts, ks, with_seen=True)
    assert rows(kmers.count_both_strands(texts, ks, with_seen=True, tasks=3).select(want.columns)) == rows(want)
    if len(ks) == 1:
        assert rows(kmers.count_naive(texts, ks[0], tasks=3)) == rows(kmers.count_naive(texts, ks[0]))


@pytest.mark.parametrize("k", [1, 4, 15, 30])
def test_number_as_text(spark, k):
    numbers = spark.range(50).select((F.xxhash64("id").bitwiseAND(4**k - 1)).alias("n"))
    assert numbers.where(packed_kmer(F.col("n"), k) != number_kmer(F.col("n"), k)).isEmpty()


def test_counts_with_genome_are_joined_counts(spark, texts):
    genome = texts.where("rid % 3 = 0")
    both = kmers.count_both_strands(texts, 6, genome=genome, tasks=4)
    want = kmers.count_both_strands(texts, 6).join(kmers.count_both_strands(genome, 6).withColumnRenamed("cnt", "in_genome"), ["k", "kmer"], "full").fillna(0)
    assert rows(both.select("k", "kmer", "cnt", "in_genome")) == rows(want.select("k", "kmer", "cnt", "in_genome"))
    found = coverage.biases_by_counts(both).groupBy("k", "gc_count", "bias").agg(F.sum("weight").alias("n"))
    windows = coverage.biases_with_genome(kmers.windows(genome, 6), kmers.count_both_strands(texts, 6), kmers.count_both_strands(genome, 6))
    assert rows(found) == rows(windows.groupBy("k", "gc_count", "bias").agg(F.count("*").alias("n")))


def test_kmers_of_a_task_dont_grow_with_reads(spark, sf_dir, monkeypatch):
    """F8, F14, F24: more rows are more tasks, whatever size Spark advises, and no sort or join holds k-mers."""
    monkeypatch.setattr(readset, "PER_TASK", 50)
    for name in ("kmer_class_genome", "bias_with_genome", "kmer_count_naive"):
        found = plan(queries.QUERIES[name](spark, sf_dir))
        assert int(re.search(r"hashpartitioning\(code#\d+L, text#\d+, (\d+)\), REPARTITION_BY_NUM", found).group(1)) > 4, name
        assert "SortMergeJoin" not in found and "Sort [" not in found, name


@pytest.mark.parametrize("name", ["bias_interpolated", "evaluation_report", "reads_written_and_read"])
def test_orders_are_shuffled_before_they_get_bases(spark, sf_dir, name):
    """the scan of orders, one task of a small file, does no more than send the keys."""
    if name == "evaluation_report":
        found = plan(queries.QUERIES[name](spark, sf_dir))
    else:
        found = plan(readset.reads(spark, sf_dir))
    sent = re.findall(r"REPARTITION_BY_NUM.*\n[^\n]*Project \[o_orderkey#\d+L AS rid#\d+L\]", found)
    assert sent


def test_lines_are_counted_without_a_sort(spark, tmp_path):
    """the pass that counts lines holds a row for each split, not sorted lines."""
    from strandwise.sources import read_reads

    (tmp_path / "a.fq").write_text("@a\nACGT\n+\n!!!!\n@b\nAC\n+\n!!\n")
    found = read_reads(spark, str(tmp_path / "a.fq"))
    assert not re.search(r"SortAggregate\(key=\[file", plan(found)) and "min_by" in plan(found)
    assert rows(found.select("read_id", "name", "seq")) == ["Row(read_id=0, name='a', seq='ACGT')", "Row(read_id=1, name='b', seq='AC')"]


def test_places_are_counted_with_pairs(spark):
    truth = spark.createDataFrame([(1, 3, 1), (1, 3, 7), (1, 3, 8), (2, 0, 2)], "rid long, pos int, type int")
    said = spark.createDataFrame([(1, 3, 1), (1, 3, 7), (3, 1, 9)], "rid long, pos int, type int")
    positions = spark.createDataFrame([(20,)], "n long")
    own = evaluate.error_confusion(evaluate.paired_errors(truth, said), positions)
    assert rows(own) == rows(evaluate.error_confusion(evaluate.match_errors(truth, said), positions))
    got = {(r.kind, r.truth, r.predicted): r.n for r in own.where("n > 0").collect()}
    assert got[("base", 0, 0)] == 18 and got[("gap", 11, 11)] == 18 and sum(got.values()) == 20 + 21
