"""SAM, and what is made of the records of SAM and BAM."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.functions.sequence import cigar_ops, reverse_complement

def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """qname, flag, rname, pos0 (from 0), cigar, ops, seq, qual of SAM text; '*' becomes empty."""
    fields = F.split("value", "\t")
    rows = spark.read.text(path).where("value <> '' and not startswith(value, '@')").select(fields.alias("f"))
    given = lambda k: F.when(F.get("f", F.lit(k)) != "*", F.get("f", F.lit(k))).otherwise("")
    return rows.select(
        F.get("f", F.lit(0)).alias("qname"), F.get("f", F.lit(1)).cast("int").alias("flag"), F.get("f", F.lit(2)).alias("rname"), (F.get("f", F.lit(3)).cast("long") - 1).alias("pos0"), given(5).alias("cigar"), cigar_ops(given(5)).alias("ops"), given(9).alias("seq"), given(10).alias("qual")
    )


def grouped(records: DataFrame) -> DataFrame:
    """qname, records: all records of a name, in the order of flag and place."""
    return records.groupBy("qname").agg(F.sort_array(F.collect_list(F.struct("flag", "pos0", "ops", "seq", "qual"))).alias("records"))


def read_totals(records: DataFrame) -> DataFrame:
    """total, mapped, unique: names; those whose first record is mapped; those with one record."""
    names = records.groupBy("qname").agg(F.count("*").alias("n"), F.min_by("flag", F.struct("flag", "pos0")).alias("flag"))
    return names.agg(F.count("*").alias("total"), F.count_if(F.col("flag").bitwiseAND(4) == 0).alias("mapped"), F.count_if(F.col("n") == 1).alias("unique"))


def reads_with_alignments(records: DataFrame) -> DataFrame:
    """qname, seq and qual in sequencing orientation, begin_pos, end_pos, records; from the first record without hard clips (none is an error)."""
    rows = grouped(records)
    whole = F.get(F.filter("records", lambda r: ~F.exists(r["ops"], lambda x: x["op"] == "H")), F.lit(0))
    rows = rows.withColumn("r", F.coalesce(whole, F.raise_error(F.lit("every record is hard-clipped")).cast(rows.schema["records"].dataType.elementType)))
    turned = F.col("r.flag").bitwiseAND(16) != 0
    return rows.select(
        "qname",
        F.when(turned, reverse_complement(F.col("r.seq"))).otherwise(F.col("r.seq")).alias("seq"),
        F.when(turned, F.reverse("r.qual")).otherwise(F.col("r.qual")).alias("qual"),
        F.col("r.pos0").alias("begin_pos"),
        (F.col("r.pos0") + F.length("r.seq") - 1).alias("end_pos"),
        "records",
    )


def without_unmapped(records: DataFrame) -> DataFrame:
    return records.where(F.col("flag").bitwiseAND(4) == 0)
