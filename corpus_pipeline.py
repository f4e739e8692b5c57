"""The corpus pipeline: language ID, exact dedup, near-dedup, mixing and packing of `documents`.

Each stage works on all rows that its predecessor kept and is written before the next one reads it.
Rows are told apart by their ids; where rows repeat an id or have none, a stage numbers them first, so
that a decision on one row is one on that row only. Columns are passed on as they are, whatever their
names; an empty table goes through as an empty one.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm._runtime import table, written
from strandwise.llm.exact_dedup import exact_dedup
from strandwise.llm.language_id import learn_languages, recognised
from strandwise.llm.mixing import first_words, mix_sources
from strandwise.llm.near_dedup import near_duplicates
from strandwise.llm.packing import pack
from strandwise.llm.queries import fold, vocabulary
from strandwise.llm.rows import fresh, repeated, told_apart, without
from strandwise.plans.storage import ship_package


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``f``, with the package handed to Python workers first, wherever the session was started."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return f(spark, docs, sf_dir)

    return run


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those whose text the predicted language's training texts hardly know: other languages, random letters."""
    return recognised(docs, learn_languages(docs.where(fold("doc_id", 3) != 1)))


@_stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays: that with the largest doc_id, one of them where rows repeat it, one without an id where no row has one."""
    rows, key = told_apart(docs)
    found = written(exact_dedup(rows, doc_id=key, keep="max").select("doc_id", "kept"), "exact")
    return without(rows, found.where(~F.col("kept")).select("doc_id"), key).select(docs.columns)


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the row with the smallest doc_id stays (rows without one come last)."""
    rows, key = told_apart(docs, nulls_first=False)
    return without(rows, near_duplicates(rows, doc_id=key).where(~F.col("kept")).select("doc_id"), key).select(docs.columns)


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents appear as often as the mix takes them; the last copy of one that it takes in part ends with the last word taken."""
    rows, key = told_apart(docs)
    all_, some = fresh(docs, "words in all"), fresh(docs, "words taken")
    taken = mix_sources(rows, doc_id=key).where("taken > 0").select("doc_id", F.ceil(F.col("taken") / F.col("size")).cast("long").alias("copies"), F.col("size").alias(all_), F.col("taken").alias(some))
    found = repeated(rows, taken, key)
    left = F.col(some) - (F.col(found.columns[-1]) - 1) * F.col(all_)
    text = F.when(left < F.col(all_), first_words(F.col("text"), left)).otherwise(F.col("text"))
    return found.withColumn("text", text).select(docs.columns)


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in sequences of at most 1024 tokens."""
    return pack(docs, vocabulary(), end_id=2)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("packing", packing)]

#: Language ID and near-duplicate groups are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
