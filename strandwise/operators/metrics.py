"""Metrics of confusion tables (kind, truth, predicted, n). 0 / 0 is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.functions.enums import no_error


def _cells(confusion: DataFrame) -> DataFrame:
    """Cells with the totals of their kind, row and column."""
    total = lambda *by: F.sum("n").over(Window.partitionBy("kind", *by))
    return confusion.select("*", total().alias("all"), total("truth").alias("in_truth"), total("predicted").alias("in_predicted"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a.cast("double") / b)


def per_type(confusion: DataFrame) -> DataFrame:
    """kind, type, tp, fp, tn, fn, true_total and the metrics of each type.

    accuracy is (tp + fp) / (tp + 2 fp + fn) and specificity tn / (tn + fn): the definitions that
    these reports have always used, not the textbook ones.
    """
    diagonal = _cells(confusion).where("truth = predicted")
    counts = diagonal.select(
        "kind",
        F.col("truth").alias("type"),
        F.col("n").alias("tp"),
        (F.col("in_predicted") - F.col("n")).alias("fp"),
        (F.col("all") - F.col("in_predicted") - F.col("in_truth") + F.col("n")).alias("tn"),
        (F.col("in_truth") - F.col("n")).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return counts.select(
        "*",
        (tp + fn).alias("true_total"),
        _ratio(tp + fp, tp + 2 * fp + fn).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        recall.alias("sensitivity"),
        _ratio(tp - fp, tp + fn).alias("gain"),
        _ratio(tn, tn + fn).alias("specificity"),
        _ratio(2 * precision * recall, precision + recall).alias("f1"),
    )


def average_f1(metrics: DataFrame) -> DataFrame:
    """kind, f1: mean over the types with an F1, 'nothing wrong' types left out (k-mer classes all count)."""
    counted = (F.col("kind") == "kmer") | (F.col("type") != no_error(F.col("kind")))
    return metrics.where(counted).groupBy("kind").agg(F.avg("f1").alias("f1"))


def _entropy(confusion: DataFrame, side: str, name: str) -> DataFrame:
    sums = confusion.groupBy("kind", side).agg(F.sum("n").alias("n"))
    p = F.col("n").cast("double") / F.sum("n").over(Window.partitionBy("kind"))
    return sums.withColumn("p", F.when(F.col("n") > 0, p)).groupBy("kind").agg(F.coalesce(-F.sum(F.col("p") * F.log2("p")), F.lit(0.0)).alias(name))


def information(confusion: DataFrame) -> DataFrame:
    """kind, entropy_truth, entropy_predicted, mutual_information, nmi (by the larger entropy)."""
    cells = _cells(confusion).where("n > 0")
    n, whole, t, p = (F.col(c).cast("double") for c in ("n", "all", "in_truth", "in_predicted"))
    mutual = cells.groupBy("kind").agg(F.sum(n / whole * F.log2(n * whole / (t * p))).alias("mutual_information"))
    joined = _entropy(confusion, "truth", "entropy_truth").join(_entropy(confusion, "predicted", "entropy_predicted"), "kind").join(mutual, "kind", "left")
    joined = joined.withColumn("mutual_information", F.coalesce("mutual_information", F.lit(0.0)))
    return joined.withColumn("nmi", _ratio(F.col("mutual_information"), F.greatest("entropy_truth", "entropy_predicted")))


def error_totals(confusion: DataFrame) -> DataFrame:
    """kind, total, confused, introduced, claimed, discovered, undiscovered errors."""
    none = no_error(F.col("kind"))
    there, said = F.col("truth") != none, F.col("predicted") != none
    right = F.col("truth") == F.col("predicted")
    total = lambda on, name: F.sum(F.when(on, F.col("n")).otherwise(0)).alias(name)
    return confusion.groupBy("kind").agg(
        F.sum("n").alias("total"), total(there & said & ~right, "confused"), total(~there & said, "introduced"), total(said, "claimed"), total(there & said & right, "discovered"), total(there & ~said, "undiscovered")
    )


def margins(confusion: DataFrame) -> DataFrame:
    """kind, truth, predicted, n: all cells, row sums (predicted null), column sums (truth null) and totals."""
    return confusion.cube("truth", "predicted", "kind").agg(F.sum("n").alias("n"), F.grouping("kind").alias("_g")).where("_g = 0").select("kind", "truth", "predicted", "n")


def row_percent(confusion: DataFrame) -> DataFrame:
    return _cells(confusion).select("kind", "truth", "predicted", _ratio(100 * F.col("n"), F.col("in_truth")).alias("percent"))


def report(confusion: DataFrame) -> DataFrame:
    """All metrics as rows kind, type (null for whole tables), metric, value."""
    def tall(rows: DataFrame, keys: list[str]) -> DataFrame:
        values = [c for c in rows.columns if c not in keys]
        spread = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in values])).alias("m"))
        type_ = F.col("type").cast("int") if "type" in keys else F.lit(None).cast("int")
        return spread.select("kind", type_.alias("type"), "m.metric", "m.value")

    metrics = per_type(confusion)
    totals = error_totals(confusion.where("kind <> 'kmer'"))
    ratios = totals.select("kind", _ratio(F.col("discovered"), F.col("claimed")).alias("discovered_of_claimed"), _ratio(F.col("introduced"), F.col("claimed")).alias("introduced_of_claimed"), _ratio(F.col("confused"), F.col("claimed")).alias("confused_of_claimed"))
    parts = [tall(metrics, ["kind", "type"]), tall(information(confusion), ["kind"]), tall(average_f1(metrics), ["kind"]), tall(totals, ["kind"]), tall(ratios, ["kind"])]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
