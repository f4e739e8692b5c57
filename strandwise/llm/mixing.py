"""Mixing sources to target weights, in DataFrame functions only.

Rows get a hash-random key (MD5 of seed and id, or of the text where the id is null). Id, source, size
and key are written once, so that texts are read once. The key's leading hex digits cut each source
into ranges; rows are sorted within (source, range), range totals are added up in a small table of
ranges, and the two together are the distributed prefix sum of sizes over each source's random
order. A source's budget is cut at exactly that many words: whole epochs first, then the rows up to
the budget, the last of them in part.

Defined results: null text has size 0; the null source is a source of its own, last in order; a
source without words has target 0; rows that repeat id and size are taken one after the other;
an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._runtime import written

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word."""
    ends = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")  # cut where a word ends
    return F.array_join(F.slice(ends, 1, n.cast("int")), "")


def key_digits(rows: int, rows_per_range: int = 1000, most: int = 5) -> int:
    """Hex digits of the key that make ranges of about ``rows_per_range`` rows; at most 16**5 ranges."""
    return min(most, max(1, math.ceil(math.log(max(1, rows / rows_per_range), 16))))


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, cap: float) -> DataFrame:
    """Targets by source: input (no_source, source, source_size), output with target added.

    Sources in code-point order, null last, get ``weights`` in turn. Together they share
    ``share`` times all sizes by weight; no target exceeds ``cap`` times its source's size, and
    what is above is shared again by weight. That settles at min(cap, level * weight) for one
    level, found from prefix sums over the sources in order of cap / weight.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy("no_source", "source")
    by_ratio = Window.orderBy("ratio", "no_source", "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    return (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(cap)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum(F.col("source_size").cast("double")).over(everything) * F.lit(float(share)))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
        .withColumn("level", F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
        .withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))))
        .select("no_source", "source", "source_size", "target")
    )


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    seed: str = "mix",
    size: Column | None = None,
) -> DataFrame:
    """Every row with what the mix takes of it: doc_id, source, size, source_size, target, start, taken.

    ``start`` is the row's place in its source's random order. A row's ``taken`` counts repeats.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).isNull().alias("no_source"),
        F.coalesce(F.col(source), F.lit("")).alias("source"),
        (word_count(F.col(text)) if size is None else size).alias("size"),
        F.md5(F.concat(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.md5(F.coalesce(F.col(text), F.lit("")))))).alias("key"),
    )
    rows = written(rows, "mix-rows")
    rows = rows.withColumn("range", F.substring("key", 1, key_digits(rows.count())))
    in_range = Window.partitionBy("no_source", "source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("no_source", "source", "range").agg(F.sum("size").alias("range_size"))
    by_range = Window.partitionBy("no_source", "source").orderBy("range")
    placed = ranges.select(
        "*",
        F.coalesce(F.sum("range_size").over(by_range.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("range_start"),
    )
    sizes = ranges.groupBy("no_source", "source").agg(F.sum("range_size").alias("source_size"))
    placed = placed.join(source_targets(sizes, weights, share, cap), ["no_source", "source"])
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0).cast("long"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("start")))
    return (
        rows.withColumn("start_in_range", F.coalesce(F.sum("size").over(in_range), F.lit(0)))
        .join(placed, ["no_source", "source", "range"])
        .withColumn("budget", budget)
        .withColumn("epochs", epochs)
        .withColumn("start", F.col("range_start") + F.col("start_in_range"))
        .select(
            "doc_id",
            F.when(~F.col("no_source"), F.col("source")).alias("source"),
            "size",
            "source_size",
            "target",
            "start",
            (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"),
        )
    )
