"""Cutting lineage in storage that outlives executors, and the package on executors of other machines."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the checkpoint folder set.

    A temporary one is made only where none is set and everything runs in this process; on a cluster
    that is an error, for executors would write where nobody else reads.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = held.get() if held.isDefined() else None
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="strandwise-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_tables(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: the lineage ends in files that outlive executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Delete the tables that ``cut`` has made for this application, once no result that reads them is needed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the Python workers of all executors, once for an application."""
    if spark.sparkContext.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    file = Path(tempfile.mkdtemp(prefix="strandwise-")) / f"{package.name}.zip"
    with zipfile.ZipFile(file, "w") as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(file))
    _shipped.add(spark.sparkContext.applicationId)
