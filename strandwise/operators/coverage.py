"""Expected coverage of unique k-mers, and its bias by G/C content."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.functions.enums import GENOME_TYPES
from strandwise.functions.sequence import canonical, gc_count, number_kmer

from .kmers import count_both_strands


def expected_counts(lengths: DataFrame, genome_size: int, ks: Iterable[int], genome_type: str = "LINEAR") -> DataFrame:
    """k, expectation, stdev of a unique k-mer's count under perfectly uniform sequencing.

    ``lengths`` is (len, n). Reads shorter than k add nothing. Reads longer than a linear genome, or
    a chance above 1, are errors.
    """
    if genome_type not in GENOME_TYPES:
        raise ValueError(f"genome_type is one of {GENOME_TYPES}")
    spark = lengths.sparkSession
    g, k, n, size = (x.cast("double") for x in (F.lit(genome_size), F.col("k"), F.col("n"), F.col("len")))
    if genome_type == "LINEAR":
        p = ((size - k) * (g - size) + 1) / ((g - k + 1) * (g - size + 1))
        p = F.when(F.col("len") > genome_size, F.raise_error(F.lit("a read is longer than the genome")).cast("double")).otherwise(p)
    else:
        p = (size - k + 1) / g
    p = F.when(p > 1, F.raise_error(F.lit("a chance exceeds 1")).cast("double")).otherwise(p)
    table = spark.createDataFrame([(x,) for x in sorted(set(ks))], "k int")
    chances = table.join(F.broadcast(lengths), F.col("len") >= F.col("k"), "left").withColumn("p", F.when(F.col("len").isNotNull(), p))
    sums = chances.groupBy("k").agg(F.sum(n * F.col("p")).alias("e"), F.sum(n * F.col("p") * (1 - F.col("p"))).alias("v"))
    return sums.select("k", F.coalesce("e", F.lit(0.0)).alias("expectation"), F.sqrt(F.coalesce("v", F.lit(0.0))).alias("stdev"))


def _gc(rows: DataFrame, kmer: str) -> Column:
    """The k-mer's number of G and C, which rows of coded k-mers hold."""
    return F.col("gc_count") if "gc_count" in rows.columns else gc_count(F.col(kmer))


def observed_bias(count: Column, expected: Column) -> Column:
    """count / expected, or 0 below a fifth of what is expected."""
    return F.when(count >= 0.2 * expected, count / expected).otherwise(0.0)


def biases_without_genome(counts: DataFrame, expected: DataFrame) -> DataFrame:
    """k, gc_count, bias, weight of the reads' k-mers with a bias above 0, from counts with ``seen``.

    A k-mer and its reverse complement have the same count and G/C content: weight (1 or 2) is how
    many of them stand in the reads.
    """
    found = counts.where("seen > 0").join(F.broadcast(expected), "k")
    bias = observed_bias(F.col("cnt").cast("double"), F.col("expectation"))
    # never null: a later join's filter on it would reach below the counts and make them another plan than their other use
    gc = F.coalesce(_gc(counts, "kmer"), F.lit(-1))
    return found.select("k", gc.alias("gc_count"), bias.alias("bias"), F.col("seen").alias("weight")).where("bias > 0")


def biases_with_genome(genome_windows: DataFrame, read_counts: DataFrame, genome_counts: DataFrame) -> DataFrame:
    """k, gc_count, bias for each window (k, kmer) of the genome: count in the reads by count in the genome, where above 0."""
    own = genome_windows.select("k", "kmer", canonical(F.col("kmer")).alias("canonical"))
    reads = read_counts.select("k", F.col("kmer").alias("canonical"), F.col("cnt").alias("in_reads"))
    genome = genome_counts.select("k", F.col("kmer").alias("canonical"), F.col("cnt").alias("in_genome"))
    joined = own.join(reads, ["k", "canonical"]).join(genome, ["k", "canonical"])
    return joined.select("k", gc_count(F.col("kmer")).alias("gc_count"), (F.col("in_reads").cast("double") / F.col("in_genome")).alias("bias")).where("bias > 0")


def biases_by_counts(counts: DataFrame) -> DataFrame:
    """k, gc_count, bias, weight: what ``biases_with_genome`` says of all windows of the genome, from counts with ``in_genome``, a row
    for each k-mer (either strand) that stands for ``weight`` windows."""
    found = counts.where((F.col("in_genome") > 0) & (F.col("cnt") > 0))
    return found.select("k", gc_count(F.col("kmer")).alias("gc_count"), (F.col("cnt").cast("double") / F.col("in_genome")).alias("bias"), F.col("in_genome").alias("weight"))


def biases_of_all_kmers(counts: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """k, gc_count, bias of each of the 4^k k-mers (k up to 15) whose bias is above 0, looked up in the counts of both strands.

    The k-mers are a generated dimension, decoded from their numbers in parallel.
    """
    if not 0 < k <= 15:
        raise ValueError("all k-mers are for k from 1 to 15")
    every = counts.sparkSession.range(4**k).select(number_kmer(F.col("id"), k).alias("kmer")).select("kmer", canonical(F.col("kmer")).alias("_own"))
    own = counts.where(F.col("k") == k).select(F.col("kmer").alias("_kmer"), "cnt")
    found = every.join(own, F.col("_own") == F.col("_kmer"), "left").select(F.lit(k).alias("k"), "kmer", F.coalesce("cnt", F.lit(0)).alias("cnt"))
    found = found.join(F.broadcast(expected), "k")
    return found.select("k", gc_count(F.col("kmer")).alias("gc_count"), observed_bias(F.col("cnt").cast("double"), F.col("expectation")).alias("bias")).where("bias > 0")


def _shifted_medians(biases: DataFrame, weight: Column) -> DataFrame:
    """k, gc_count, bias: the elements one further up each bin's sorted list, read off the counts of its distinct values."""
    by_value = Window.partitionBy("k", "gc_count").orderBy("bias")
    values = biases.groupBy("k", "gc_count", "bias").agg(F.sum(weight).alias("n"))
    values = values.select("k", "gc_count", "bias", F.sum("n").over(by_value).alias("upto"), F.sum("n").over(by_value.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all"))
    half = F.floor(F.col("all") / 2)
    at = lambda rank: F.min(F.when(F.col("upto") >= F.least(rank, F.col("all")), F.col("bias")))
    found = values.groupBy("k", "gc_count").agg(at(half + 1).alias("low"), at(half + 2).alias("high"), (F.max("all") % 2 == 1).alias("odd"))
    return found.select("k", "gc_count", F.when(F.col("odd"), F.col("high")).otherwise((F.col("low") + F.col("high")) / 2).alias("bias"))


def median_biases(biases: DataFrame, ks: Iterable[int], compat: bool = False) -> DataFrame:
    """k, gc_count 0..k, gc, bias: the median of each bin (of ``weight`` times each row, if there is one), 0 where it is empty.

    ``compat`` takes the elements one further up the sorted list, as older results did.
    """
    spark = biases.sparkSession
    bins = spark.createDataFrame([(k, i) for k in sorted(set(ks)) for i in range(k + 1)], "k int, gc_count int")
    weight = F.col("weight") if "weight" in biases.columns else F.lit(1)
    if compat:
        medians = _shifted_medians(biases, weight)
    else:  # a bin's values are few: counts of k-mers over an expectation
        values = biases.groupBy("k", "gc_count", "bias").agg(F.sum(weight).alias("n"))
        medians = values.groupBy("k", "gc_count").agg(F.percentile("bias", 0.5, F.col("n")).alias("bias"))
    return bins.join(medians, ["k", "gc_count"], "left").select("k", "gc_count", (F.col("gc_count").cast("double") / F.col("k")).alias("gc"), F.coalesce("bias", F.lit(0.0)).alias("bias"))


def fill_biases(medians: DataFrame) -> DataFrame:
    """Empty bins (0) filled: the nearest value at the ends, linear in between, 1 where all are empty."""
    known = F.when(F.col("bias") != 0, F.struct("gc_count", "bias"))
    by_k = Window.partitionBy("k").orderBy("gc_count")
    left = F.last(known, ignorenulls=True).over(by_k.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    right = F.first(known, ignorenulls=True).over(by_k.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = medians.withColumn("l", left).withColumn("r", right)
    slope = (F.col("r.bias") - F.col("l.bias")) / F.when(F.col("r.gc_count") != F.col("l.gc_count"), F.col("r.gc_count") - F.col("l.gc_count"))
    between = F.col("l.bias") + slope * (F.col("gc_count") - F.col("l.gc_count"))
    filled = F.when(F.col("bias") != 0, F.col("bias")).otherwise(F.coalesce(between, F.col("l.bias"), F.col("r.bias"), F.lit(1.0)))
    return rows.select("k", "gc_count", "gc", filled.alias("bias"))


def bias_at(values: DataFrame, biases: DataFrame, gc: str = "gc") -> DataFrame:
    """Rows (with k and a G/C share between 0 and 1) with the bias linear between the two nearest bins."""
    low = F.least(F.floor(F.col(gc) * F.col("k") + 1e-12), F.col("k")).cast("int")
    high = F.least(low + 1, F.col("k"))
    table = biases.select("k", "gc_count", "bias")
    a = F.broadcast(table.select(F.col("k").alias("_ka"), F.col("gc_count").alias("_a"), F.col("bias").alias("bias_low")))
    b = F.broadcast(table.select(F.col("k").alias("_kb"), F.col("gc_count").alias("_b"), F.col("bias").alias("bias_high")))
    rows = values.withColumn("_low", low).withColumn("_high", high)
    rows = rows.join(a, (F.col("k") == F.col("_ka")) & (F.col("_low") == F.col("_a")), "left").join(b, (F.col("k") == F.col("_kb")) & (F.col("_high") == F.col("_b")), "left")
    share = F.col(gc) * F.col("k") - F.col("_low")
    return rows.withColumn("bias", F.col("bias_low") + (F.col("bias_high") - F.col("bias_low")) * share).drop("_low", "_high", "_ka", "_a", "_kb", "_b", "bias_low", "bias_high")


def kmer_bias(rows: DataFrame, biases: DataFrame, kmer: str = "kmer") -> DataFrame:
    """Rows (k, kmer) with their bias: a k-mer's G/C share falls on a bin."""
    table = F.broadcast(biases.select(F.col("k").alias("_k"), F.col("gc_count").alias("_gc"), "bias"))
    return rows.join(table, (F.col("k") == F.col("_k")) & (_gc(rows, kmer) == F.col("_gc")), "left").drop("_k", "_gc")


class CoverageModel:
    """Counts, expectations and bias tables of a read set for a set of k, each built from one scan.

    With ``genome`` counts have in_genome; for it and ``tasks`` see ``count_both_strands``. ``counts`` are those of coded k-mers, if made already.
    """

    def __init__(self, reads: DataFrame, genome_size: int, ks: Iterable[int], genome_type: str = "LINEAR", seq: str = "seq", lengths: DataFrame | None = None, with_bias: bool = True, genome: DataFrame | None = None, tasks: int | None = None, counts: DataFrame | None = None) -> None:
        from .kmers import read_lengths

        self.ks = sorted(set(ks))
        self.reads, self.genome_size, self.genome_type, self.seq = reads, genome_size, genome_type, seq
        self.lengths = read_lengths(reads, seq) if lengths is None else lengths
        self.expected = expected_counts(self.lengths, genome_size, self.ks, genome_type)
        # always true, but with it both uses of the counts need all columns and are one plan, whose shuffle Spark then reuses
        if counts is not None:
            self.counts = counts = counts.where("seen >= 0 AND inner >= 0")
            self._add_biases(counts, with_bias)
            return
        counts = count_both_strands(reads, self.ks, seq, with_seen=True, genome=genome, tasks=tasks).where("seen >= 0 AND inner >= 0")
        if genome is not None:
            counts = counts.where("in_genome >= 0")
        self.counts = counts.select("k", "kmer", "cnt", "inner") if genome is None else counts.where("cnt > 0").select("k", "kmer", "cnt", "inner", "in_genome")
        self._add_biases(counts, with_bias)

    def _add_biases(self, counts: DataFrame, with_bias: bool) -> None:
        if with_bias:
            self.raw_biases = biases_without_genome(counts, self.expected)
            self.medians = median_biases(self.raw_biases, self.ks)
            self.biases = fill_biases(self.medians)
        else:
            spark = counts.sparkSession
            self.biases = spark.createDataFrame([(k, i, i / k, 1.0) for k in self.ks for i in range(k + 1)], "k int, gc_count int, gc double, bias double")

    def report(self) -> DataFrame:
        """k, gc, bias in order, for printing or plotting."""
        return self.biases.select("k", "gc", "bias").orderBy("k", "gc")
