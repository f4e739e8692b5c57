import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandwise.functions import enums, sequence

VECTORS = [("T", "A"), ("G", "C"), ("C", "G"), ("A", "T"), ("N", "N"), ("AT", "AT"), ("CG", "CG"), ("TC", "GA"), ("CA", "TG")]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()[0]


def test_reverse_complement_vectors(spark):
    rows = spark.createDataFrame(VECTORS, "s string, want string")
    assert rows.where(sequence.reverse_complement(F.col("s")) != F.col("want")).count() == 0


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ACGTN", max_size=20), min_size=1, max_size=30))
def test_reverse_complement_twice_is_the_same(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "s string")
    assert rows.where(sequence.reverse_complement(sequence.reverse_complement(F.col("s"))) != F.col("s")).count() == 0


def test_numbers(spark):
    assert one(spark, sequence.kmer_number(F.lit("ACGT"))) == 27
    assert one(spark, sequence.number_kmer(F.lit(27), 4)) == "ACGT"
    assert one(spark, sequence.kmer_number(F.lit("ACN"))) is None
    assert one(spark, sequence.kmer_number(F.lit("T" * 31))) == 4**31 - 1
    assert one(spark, sequence.gc_content(F.lit(""))) is None


def test_edits(spark):
    code = enums.CODE
    before = lambda t, p: one(spark, sequence.undo_error_before(F.lit("ACGT"), F.lit(p), F.lit(code[t])))
    after = lambda t, p: one(spark, sequence.undo_error_after(F.lit("ACGT"), F.lit(p), F.lit(code[t])))
    assert before("SUB_OF_T", 1) == "ATGT"
    assert before("INSERTION", 1) == "AGT"
    assert before("DEL_OF_G", 1) == "AGCGT"
    assert after("DEL_OF_G", 1) == "ACGGT"
    assert before("MULTIDEL", 2) == "AC_GT"
    assert after("MULTIDEL", 2) is None
    assert before("CORRECT", 0) == "ACGT"
    assert before("SUB_OF_A", 9) is None


def test_names_in_natural_order(spark):
    names = ["r10", "10r", "r2", "r10x"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(sequence.natural_key(F.col("n")))
    assert [r.n for r in rows.collect()] == ["10r", "r2", "r10", "r10x"]
    assert one(spark, sequence.normal_name(F.lit("r10/1 extra"))) == "r10"
    assert one(spark, sequence.normal_name(F.lit("r10 extra/1"))) == "r10"


def test_types(spark):
    assert one(spark, enums.substitution_of(F.lit("g"))) == enums.CODE["SUB_OF_G"]
    assert one(spark, enums.deletion_of(F.lit("N"))) is None
    with pytest.raises(Exception, match="not a base"):
        one(spark, enums.deletion_of(F.lit("N"), strict=True))
    assert enums.error_type_table(spark, "gap").count() == 6


def test_sql_functions(spark):
    sequence.register(spark)
    row = spark.sql("SELECT revcomp('TC') a, gc_count('GGA') b, kmer_number('ACGT') c, normal_name('x/1 y') d").head()
    assert tuple(row) == ("GA", 2, 27, "x")
