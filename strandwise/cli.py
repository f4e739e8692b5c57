"""Command line: correct reads, evaluate corrections and k-mer classes, or run the demo."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.api import Dataset, Parameters, Toolkit
from strandwise.functions.enums import ALGORITHMS
from strandwise.functions.sequence import cigar_ops
from strandwise.operators.cigar import genome_span
from strandwise.plans.readset import cut_windows
from strandwise.plans.storage import cut, ship_package
from strandwise.sources import read_bam, read_genome, read_reads, read_sam, write_plot, write_reads
from strandwise.sources.alignments import without_unmapped


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandwise", description=__doc__)
    p.add_argument("-r", "--reads", help="FASTA or FASTQ file with the reads")
    p.add_argument("-i", "--corrected", help="corrected reads, for -e")
    p.add_argument("-b", "--alignments", help="SAM or BAM file of the reads, for -e")
    p.add_argument("-g", "--genome", help="FASTA file of the genome, for -e")
    p.add_argument("-s", "--size", type=int, default=0, help="genome size")
    p.add_argument("-k", type=int, default=15, help="smallest k-mer size")
    p.add_argument("-o", "--output", required=True, help="output path")
    p.add_argument("-c", "--circular", action="store_true", help="the genome is circular")
    p.add_argument("-l", "--linear", action="store_true", help="the genome is linear")
    p.add_argument("-d", "--demo", action="store_true", help="run the demo")
    p.add_argument("-e", "--evaluate", action="store_true", help="evaluate corrected reads and k-mer classes")
    p.add_argument("-n", "--correct", action="store_true", help="correct reads")
    p.add_argument("-a", "--algorithm", choices=ALGORITHMS, help="correction algorithm, for -n")
    return p


def validated(args: argparse.Namespace) -> argparse.Namespace:
    if args.demo + args.evaluate + args.correct != 1:
        raise ValueError("choose one of demo, evaluate and correct")
    if args.demo:
        if args.reads or args.corrected or args.genome or args.size or args.circular or args.linear or args.algorithm:
            raise ValueError("the demo takes an output path only")
        return args
    if not args.reads:
        raise ValueError("reads are missing")
    if args.circular == args.linear:
        raise ValueError("choose one of circular and linear")
    if args.correct and not args.algorithm:
        raise ValueError("correcting needs an algorithm")
    if args.correct and args.size <= 0:
        raise ValueError("the genome's size is above 0")
    if args.evaluate and not (args.genome and args.corrected):
        raise ValueError("evaluation needs the genome and corrected reads")
    return args


def _identified(reads: DataFrame) -> DataFrame:
    return reads.withColumnRenamed("read_id", "rid")


def _correct(spark: SparkSession, args: argparse.Namespace) -> None:
    reads = _identified(read_reads(spark, args.reads, quality=False))
    tools = Toolkit(Dataset(reads, args.size, "CIRCULAR" if args.circular else "LINEAR"), Parameters(args.k, args.algorithm))
    fixed = tools.correct().join(reads.select("rid", "name"), "rid")
    write_reads(fixed.orderBy("rid"), args.output)
    write_plot(tools.coverage_biases([args.k]), "gc", "bias", f"{args.output}.bias")


def genome_stretches(chunks: DataFrame, k: int, chunk: int = 32) -> DataFrame:
    """idx, seq from genome chunks: each chunk with the k - 1 bases after it."""
    starts = chunks.select("idx", (F.col("idx") * chunk).alias("pos0"))
    return cut_windows(starts, chunks, length=chunk + k - 1, chunk=chunk).select("idx", F.col("window").alias("seq"))


def _evaluate(spark: SparkSession, args: argparse.Namespace) -> None:
    reads = _identified(read_reads(spark, args.reads, quality=False))
    chunks = read_genome(spark, args.genome)
    size = chunks.agg(F.sum(F.length("bases"))).head()[0]
    tools = Toolkit(Dataset(reads, size, "CIRCULAR" if args.circular else "LINEAR"), Parameters(args.k))
    tools.evaluate_kmers(genome_stretches(chunks, args.k)).coalesce(1).write.mode("overwrite").csv(f"{args.output}.kmers", header=True)
    if args.alignments:
        records = read_bam(spark, args.alignments, cut) if args.alignments.endswith(".bam") else read_sam(spark, args.alignments)
        records = without_unmapped(records)
        longest = records.agg(F.max(genome_span(cigar_ops(F.col("cigar"))))).head()[0] or 1
        windows = cut_windows(records.select("qname", "pos0"), chunks, length=longest).select("qname", "window")
        corrected = read_reads(spark, args.corrected, quality=False)
        tools.evaluate_corrections(corrected, records, windows).coalesce(1).write.mode("overwrite").csv(f"{args.output}.corrections", header=True)


def _demo(spark: SparkSession, args: argparse.Namespace) -> None:
    """Counts and biases (k = 21) of a small genome of 18 959 bases that the demo makes up."""
    size, length = 18_959, 100
    genome = F.concat(*[F.translate(F.md5(F.lit(str(i))), "0123456789abcdef", "ACGTACGTACGTACGT") for i in range(-(-(size + 1) // 32))])
    reads = spark.range(size // 4).select(F.col("id").alias("rid"), F.substring(genome, (F.col("id") * 7919 % (size - length + 1)).cast("int") + 1, F.lit(length)).alias("seq"))
    tools = Toolkit(Dataset(reads, size, "LINEAR"), Parameters(21))
    write_plot(tools.coverage_biases([21]), "gc", "bias", args.output)


def main(argv: Sequence[str] | None = None) -> None:
    args = validated(parser().parse_args(argv))
    spark = SparkSession.builder.appName("strandwise").getOrCreate()
    ship_package(spark)
    (_demo if args.demo else _evaluate if args.evaluate else _correct)(spark, args)


if __name__ == "__main__":
    main()
