"""Count caches, plot data and other small text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def store_counts_text(counts: DataFrame, path: str) -> None:
    """'kmer count' lines."""
    counts.select("kmer", "cnt").write.mode("overwrite").csv(path, sep=" ")


def load_counts_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("kmer string, cnt long").csv(path, sep=" ")


def plot_points(points: DataFrame, x: str, y: str) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """Points in order of x, and the ranges of both axes, widened by 1 each way where they are a single value."""
    rows = points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    low_x, high_x, low_y, high_y = rows.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).head()
    wide = lambda a, b: (0.0, 0.0) if a is None else (a - 1, b + 1) if a == b else (a, b)
    return rows.orderBy("x"), {"x": wide(low_x, high_x), "y": wide(low_y, high_y)}


def write_plot(points: DataFrame, x: str, y: str, path: str) -> None:
    """``<path>_data.csv`` and ``<path>.gnu``, a script that draws it."""
    rows, ranges = plot_points(points, x, y)
    rows.write.mode("overwrite").csv(f"{path}_data.csv", header=True)
    script = [f"set {a}range [{lo}:{hi}]" for a, (lo, hi) in ranges.items()] + [f"set xlabel '{x}'", f"set ylabel '{y}'", "set datafile separator ','", f"plot '< cat {path}_data.csv/part-*' using 1:2 with lines"]
    points.sparkSession.createDataFrame([("\n".join(script),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.gnu")


def read_plot_script(spark: SparkSession, path: str) -> DataFrame:
    """x, y of the data lines ('x y') of a plot script with its data in line; lines of one or two characters end it."""
    lines = spark.read.text(path, wholetext=True).select(F.split(F.regexp_replace("value", r"(?s)^.*?\nplot[^\n]*\n", ""), "\n").alias("l"))
    rows = lines.select(F.explode("l").alias("line")).where(F.length("line") > 2).select(F.split(F.trim("line"), r"\s+").alias("f"))
    return rows.select(F.get("f", F.lit(0)).try_cast("double").alias("x"), F.get("f", F.lit(1)).try_cast("double").alias("y")).where("x is not null and y is not null")
