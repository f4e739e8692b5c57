"""What is shuffled, and how pairs are aligned: work that grows with all windows or pairs is done once."""

import random
import re

import pytest
from pyspark.sql import functions as F

from strandwise.operators import align, classify, coverage, evaluate, kmers
from strandwise.plans import queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def texts(spark):
    return spark.range(200).select(F.col("id").alias("rid"), F.translate(F.md5(F.col("id").cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT").alias("seq"))


def test_pairs_are_aligned_together_as_alone(monkeypatch):
    r = random.Random(3)
    pairs = [("", ""), ("", "AC"), ("AC", ""), ("é", "A"), ("AC" * 100, "CA" * 99)]
    for _ in range(600):
        x = "".join(r.choice("ACGTNS") for _ in range(r.randint(0, 14)))
        y = list(x)
        for _ in range(r.randint(0, 6)):
            p = r.randint(0, len(y))
            y[p : p + r.randint(0, 1)] = r.choice(["", "A", "C", "X", "GT"])
        pairs.append((x, "".join(y)))
    wanted = [align.align_pair(x, y) for x, y in pairs]
    monkeypatch.setattr(align, "TABLE_CELLS", 1 << 12)
    assert align.align_all(*zip(*pairs, strict=True)) == wanted
    alone = []
    monkeypatch.setattr(align, "align_pair", lambda *pair: alone.append(pair) or [])
    align.align_all(*zip(*pairs, strict=True))
    assert [x for x, *_ in alone] == ["é", "AC" * 100]
    assert align.align_all([], []) == []


def test_inverted_index_is_one_shuffle(spark, texts):
    found = kmers.inverted_index(texts, 11, empty_if_repeated=True)
    assert len(re.findall("Exchange hashpartitioning", plan(found))) == 1


def test_median_of_counted_values(spark, texts):
    model = coverage.CoverageModel(texts, 6400, [5, 7])
    assert re.search(r"HashAggregate\(keys=\[k#\d+, gc_count#\d+, bias#\d+\]", plan(model.medians))


def test_windows_of_the_alignments_themselves(spark):
    corrected = spark.createDataFrame([("a", "ACGT"), ("b", "ACTT")], "name string, seq string")
    records = spark.createDataFrame([("a", 0, 0, "4M", "ACTT", "ACGT"), ("b", 16, 0, "4M", "ACTT", "ACGT")], "qname string, flag int, pos0 int, cigar string, seq string, window string")
    own = evaluate.evaluate_corrections(corrected, records)
    assert sorted(own.collect()) == sorted(evaluate.evaluate_corrections(corrected, records, records.select("qname", "window")).collect())


def test_reads_median_takes_windows_once(spark, texts):
    rows = classify.read_kmers_with_counts(texts, kmers.count_both_strands(texts, 5), 5)
    found = plan(classify.classify_by_read_median(rows))
    assert found.count("Generate explode(sequence(") == 2  # counts, and the reads' windows


def test_canonical_kmers_are_sent_once(spark, sf_dir):
    """Of two spellings of a k-mer only the canonical one goes to the counts."""
    found = plan(queries.kmer_lookup(spark, sf_dir))
    sent = re.search(r"Exchange hashpartitioning\(kmer#\d+, \d+\).*\n[^\n]*Project \[([^\n]*)\]", found).group(1)
    assert "_canonical" not in sent


@pytest.mark.parametrize("query", ["reads_all_correct", "kmer_eval_variants"])
def test_windows_meet_one_table(spark, sf_dir, query):
    """Counts and truth are joined by distinct k-mer; windows, which keep their read's id, meet one table."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = plan(queries.QUERIES[query](spark, sf_dir))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    kmer_joins = re.findall(r"SortMergeJoin \[[^\]]*\], \[[^\]]*\], LeftOuter", found)
    assert sum("kmer" in j or "canonical" in j for j in kmer_joins) == 2
