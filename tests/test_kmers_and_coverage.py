import math
import random
import tracemalloc

import pytest
from plain import cost_table, record_errors
from plain_correction import Known, Missing, correct_simple, fix_kmer, smallest_nonrepetitive
from pyspark.sql import functions as F

from strandwise.operators import align, classify, coverage, kmers
from strandwise.operators.align import align_pair, smooth_multidels
from strandwise.operators.correct import algorithm
from strandwise.operators.evaluate import match_errors, switch_types
from strandwise.operators.metrics import average_f1, information, per_type


def reads(spark, *seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "rid long, seq string")


def counted(df):
    return {r.kmer: r.cnt for r in df.collect()}


def test_short_and_empty_reads(spark):
    df = reads(spark, "AC", "ACG", "ACGT", "", None)
    assert kmers.windows(df, 3).count() == 3
    assert kmers.windows(df, 3, drop_last=True).count() == 1
    assert kmers.count_both_strands(spark.createDataFrame([], "seq string"), 3).count() == 0


def test_both_strands_and_palindromes(spark):
    got = counted(kmers.count_both_strands(reads(spark, "ACGT", "ACGN"), 4))
    assert got["ACGT"] == 1
    naive = counted(kmers.count_naive(reads(spark, "TACGTA"), 4))
    assert naive["ACGT"] == 1
    assert counted(kmers.count_naive(reads(spark, "ACGTA"), 4, reverse_complements=False))["ACGT"] == 1
    assert counted(kmers.count_naive(reads(spark, "ACGTA"), 4, reverse_complements=False, halve_always=True))["ACGT"] == 0


def test_postings_of_a_hot_kmer_are_blocked(spark):
    """Reads of A alone: each row holds a block's reads, all of them together every occurrence."""
    df = spark.range(1000).selectExpr("id AS rid", "repeat('A', 10) AS seq")
    rows = kmers.inverted_index(df, 4, block=64).collect()
    assert len(rows) == 16 and {r.kmer for r in rows} == {"AAAA"}
    assert max(len(r.read_ids) for r in rows) == 64 * 7
    assert [i for r in sorted(rows, key=lambda r: r.block) for i in r.read_ids] == [i for i in range(1000) for _ in range(7)]
    assert all(r.read_ids == [] for r in kmers.inverted_index(df, 4, empty_if_repeated=True, block=64).collect())


def test_biases_of_all_kmers(spark):
    df = reads(spark, "ACGTAC", "GGGTAC")
    counts = kmers.count_both_strands(df, 3)
    expected = spark.createDataFrame([(3, 2.0)], "k int, expectation double")
    got = sorted((r.gc_count, r.bias) for r in coverage.biases_of_all_kmers(counts, expected, 3).collect())
    own = [(r.kmer, r.cnt) for r in counts.collect()]
    turned = str.maketrans("ACGT", "TGCA")
    want = [(sum(b in "GC" for b in x), n / 2.0) for x, n in own for _ in {x, x[::-1].translate(turned)}]
    assert got == sorted(want)
    with pytest.raises(ValueError):
        coverage.biases_of_all_kmers(counts, expected, 16)


def test_inverted_index(spark):
    df = reads(spark, "AAAA", "TTT")
    assert kmers.inverted_index(df, 3).head().read_ids == [0, 0, 1]
    assert kmers.inverted_index(df, 3, empty_if_repeated=True).head().read_ids == []


def biases(spark, values):
    k = len(values) - 1
    return spark.createDataFrame([(k, i, i / k, float(v)) for i, v in enumerate(values)], "k int, gc_count int, gc double, bias double")


@pytest.mark.parametrize(
    ("given", "want"), [([0, 0, 0], [1, 1, 1]), ([0, 2, 0], [2, 2, 2]), ([1, 0, 3], [1, 2, 3]), ([0, 1, 0, 0, 4, 0], [1, 1, 2, 3, 4, 4]), ([1, 2, 3], [1, 2, 3])]
)
def test_filling(spark, given, want):
    got = [r.bias for r in coverage.fill_biases(biases(spark, given)).orderBy("gc_count").collect()]
    assert got == pytest.approx(want)


def test_interpolation_at_the_ends(spark):
    rows = spark.createDataFrame([(2, 0.0), (2, 0.25), (2, 1.0)], "k int, gc double")
    assert [r.bias for r in coverage.bias_at(rows, biases(spark, [1, 3, 5])).orderBy("gc").collect()] == pytest.approx([1, 2, 5])


def test_expected_counts(spark):
    lengths = spark.createDataFrame([(50, 15000), (10, 5)], "len int, n long")
    row = coverage.expected_counts(lengths, 64_000, [15]).head()
    assert row.expectation == pytest.approx(8.204795191827134)
    assert coverage.expected_counts(lengths, 64_000, [15], "CIRCULAR").head().expectation == pytest.approx(8.4375)
    with pytest.raises(Exception, match="longer than the genome"):
        coverage.expected_counts(lengths, 40, [15]).collect()
    with pytest.raises(ValueError):
        coverage.expected_counts(lengths, 40, [15], "ROUND")


def test_classes(spark):
    rows = spark.createDataFrame([(1, 8.0, 1.0, 0), (3, 8.0, 1.0, 0), (4, 8.0, 1.0, 1), (12, 8.0, 1.0, 1), (13, 8.0, 1.0, 2), (5, 8.0, 0.0, 2), (5, 8.0, math.nan, 2)], "n int, e double, b double, want int")
    assert rows.where(classify.kmer_class(F.col("n"), F.col("e"), F.col("b")) != F.col("want")).count() == 0


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ("ACGT", "ACGT", []),
        ("ACGT", "AGGT", [(1, 3)]),
        ("ACCGT", "ACGT", [(1, 5)]),
        ("ACGT", "ACTGT", [(2, 9)]),
        ("ACGT", "ACTTGT", [(2, 10)]),
        ("ANGT", "ACGT", []),
        ("SSGT", "ACGT", []),
        ("", "A", [(0, 6)]),
    ],
)
def test_alignment(a, b, want):
    assert align_pair(a, b) == want


def test_alignment_costs_are_edit_distances():
    rng = random.Random(3)
    for _ in range(50):
        a, b = ("".join(rng.choice("ACGT") for _ in range(rng.randint(1, 9))) for _ in range(2))
        d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j - 1] + (a[i - 1] != b[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
        found = align_pair(a, b)
        assert len(found) <= d[-1][-1]
        if not any(t == 10 for _, t in found):
            assert len(found) == d[-1][-1]


def _edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        k, way = rng.randrange(max(len(out), 1)), rng.random()
        out[k : k + (way > 0.3)] = [rng.choice("ACGT")] * (way < 0.3 or way > 0.6)
    return "".join(out)


@pytest.mark.parametrize("kept", [1 << 20, 1])
@pytest.mark.parametrize("compat", [False, True])
def test_alignment_in_a_band_equals_the_whole_table(monkeypatch, kept, compat):
    """Random and related pairs, with all cells kept or rows computed again."""
    rng = random.Random(9)
    monkeypatch.setattr(align, "KEPT_CELLS", kept)
    for trial in range(250):
        a = "".join(rng.choices("ACGTNS" if trial % 3 == 0 else "ACGT", k=rng.randint(0, 60)))
        b = "".join(rng.choices("ACGT", k=rng.randint(0, 60))) if trial % 2 else _edited(rng, a.replace("N", "A").replace("S", "T"), rng.randint(0, 9))
        with monkeypatch.context() as whole:
            whole.setattr(align, "_Costs", cost_table)
            want = align_pair(a, b, compat)
        assert align_pair(a, b, compat) == want, (a, b)


def test_alignment_of_100_kb_in_little_memory():
    rng = random.Random(4)
    a = "".join(rng.choices("ACGT", k=100_000))
    tracemalloc.start()
    try:
        found = align_pair(a, _edited(rng, a, 300))
        assert tracemalloc.get_traced_memory()[1] < 100e6
    finally:
        tracemalloc.stop()
    assert 200 < len(found) <= 300


def test_records():
    ops = [("M", 2), ("I", 1), ("M", 1)]
    assert record_errors("ACTG", ops, "ACG", False) == [(2, 5, "T")]
    assert record_errors("ACG", [("M", 2), ("D", 1), ("M", 1)], "ACTG", False) == [(1, 9, "C")]
    assert record_errors("ACG", [("M", 2), ("D", 1), ("M", 1)], "ACTG", True) == [(0, 6, "C")]
    assert record_errors("ACG", [("M", 2), ("D", 2), ("M", 1)], "ACTTG", False) == [(1, 10, "C")]
    assert record_errors("TTACG", [("S", 2), ("M", 3)], "AGG", False) == [(3, 3, "C")]
    assert record_errors("TTACG", [("S", 2), ("M", 3)], "AGG", True) == [(1, 2, "G")]
    assert record_errors("ACG", [("M", 3), ("H", 4)], "ACG", False) == [(2, 10, "G")]


def test_smoothing(spark):
    rows = spark.createDataFrame([(1, 3, 6), (1, 3, 7), (1, 3, 2), (1, 4, 8)], "rid int, pos int, type int")
    assert sorted((r.pos, r.type) for r in smooth_multidels(rows).collect()) == [(3, 2), (3, 10), (4, 8)]


def test_matching_keeps_kinds_apart(spark):
    truth = spark.createDataFrame([(1, 3, 1), (1, 5, 6)], "rid int, pos int, type int")
    said = spark.createDataFrame([(1, 3, 7), (1, 5, 7)], "rid int, pos int, type int")
    got = sorted((r.pos, r.kind, r.truth, r.predicted) for r in match_errors(truth, said).collect())
    assert got == [(3, "base", 1, 0), (3, "gap", 11, 7), (5, "gap", 6, 7)]


def confusion(spark, cells):
    return spark.createDataFrame([("kmer", t, p, cells.get((t, p), 0)) for t in range(3) for p in range(3)], "kind string, truth int, predicted int, n long")


def test_metrics(spark):
    table = confusion(spark, {(0, 0): 5, (0, 1): 1, (1, 1): 10, (1, 0): 8})
    rows = {r.type: r for r in per_type(table).collect()}
    assert (rows[0].tp, rows[0].fp, rows[0].fn, rows[0].tn) == (5, 8, 1, 10)
    assert rows[0].gain == pytest.approx(-0.5)
    assert rows[0].accuracy == pytest.approx(13 / 22)
    assert rows[2].f1 is None
    assert average_f1(per_type(table)).head().f1 == pytest.approx((rows[0].f1 + rows[1].f1) / 2)
    perfect = information(confusion(spark, {(0, 0): 4, (1, 1): 4})).head()
    assert perfect.nmi == pytest.approx(1) and perfect.entropy_truth == pytest.approx(1)


def test_switching_twice_is_the_same(spark):
    cells = [("base", t, p, 6 * t + p) for t in range(6) for p in range(6)]
    table = spark.createDataFrame(cells, "kind string, truth int, predicted int, n long")
    twice = switch_types(switch_types(table))
    assert sorted(map(tuple, twice.collect())) == sorted(cells)


def test_corrections_by_hand():
    genome = "ACGTTGCAAGCTTAGCCATG"
    good = {min(x, y) for i in range(len(genome) - 4) for x in [genome[i : i + 5]] for y in [x[::-1].translate(str.maketrans("ACGT", "TGCA"))]}

    class All(dict):
        def __contains__(self, key):
            return True

        def __getitem__(self, key):
            return 1 if len(key) != 5 or key in good else 0

    known = Known(All())
    wrong = genome[:9] + "T" + genome[10:]
    assert correct_simple(wrong, 5, known) == genome
    assert smallest_nonrepetitive(genome, 0, 5, known) == 5
    assert len(fix_kmer(wrong, 5, 5, known)) in (19, 20, 21)
    with pytest.raises(NotImplementedError):
        algorithm("FULL_MSA")
    with pytest.raises(ValueError):
        algorithm("OTHER")
    with pytest.raises(Missing):
        Known({}).need(["ACG"])
