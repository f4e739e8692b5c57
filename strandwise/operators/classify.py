"""Classes of k-mers: untrusted, unique, repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.functions.enums import REPEAT, UNIQUE, UNTRUSTED

from .coverage import CoverageModel, kmer_bias
from .kmers import look_up, windows


def kmer_class(count: Column, expected: Column, bias: Column) -> Column:
    """Class code from the bias-corrected count; bias 0 or NaN gives REPEAT."""
    corrected = count.cast("double") / F.when((bias != 0) & ~F.isnan(bias), bias)
    return F.when(corrected.isNull(), REPEAT).when((corrected <= 1) | (corrected < 0.5 * expected), UNTRUSTED).when(corrected <= 1.5 * expected, UNIQUE).otherwise(REPEAT)


def class_table(model: CoverageModel) -> DataFrame:
    """k, kmer (smaller of both strands), cnt, inner, class (and in_genome, if counted) of every k-mer of the reads. Others have count 0: UNTRUSTED."""
    rows = kmer_bias(model.counts.join(F.broadcast(model.expected.select("k", "expectation")), "k"), model.biases)
    return rows.select(*model.counts.columns, kmer_class(F.col("cnt"), F.col("expectation"), F.col("bias")).alias("class"))


def classify(rows: DataFrame, model: CoverageModel, kmer: str = "kmer") -> DataFrame:
    """Rows (k, kmer) with cnt and class."""
    table = class_table(model).select("k", "kmer", "class", "cnt")
    return look_up(rows, table, kmer).withColumn("class", F.coalesce("class", F.lit(UNTRUSTED)))


def genome_class(count: Column) -> Column:
    """True class from the count in the genome: absent, once, more than once."""
    return F.when(F.coalesce(count, F.lit(0)) == 0, UNTRUSTED).when(count == 1, UNIQUE).otherwise(REPEAT)


def read_kmers_with_counts(reads: DataFrame, counts: DataFrame, k: int, read_id: str = "rid", seq: str = "seq", drop_last: bool = True) -> DataFrame:
    return look_up(windows(reads, k, drop_last, seq, keep=[read_id]), counts)


def classify_by_read_median(read_kmers: DataFrame, read_id: str = "rid", floor: int = 3) -> DataFrame:
    """Rows (read_id, pos, kmer, cnt) with median (of the read's counts, at least ``floor``) and class against it."""
    by_read = Window.partitionBy(read_id)
    median = F.greatest(F.percentile("cnt", 0.5).over(by_read), F.lit(float(floor)))
    return read_kmers.where(F.col(read_id).isNotNull()).withColumn("median", median).withColumn("class", kmer_class(F.col("cnt"), F.col("median"), F.lit(1.0)))
