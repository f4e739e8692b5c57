"""k-mer counts kept up to date over a stream of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.functions.sequence import canonical
from strandwise.operators.kmers import windows


def stream_counts(reads: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """kmer, cnt of a streaming DataFrame of reads; write it in complete or update mode."""
    return windows(reads, k, seq=seq).groupBy(canonical(F.col("kmer")).alias("kmer")).agg(F.count("*").alias("cnt"))


def stream_reads(spark: SparkSession, folder: str, schema: str = "rid long, name string, seq string") -> DataFrame:
    """Reads from Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)
