"""Session helpers shared by every operator."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once per application."""
    context = spark.sparkContext
    if getattr(context, "_candlewick_shipped", False):
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="candlewick-")) / "candlewick.zip"
    with zipfile.ZipFile(target, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    context.addPyFile(str(target))
    context._candlewick_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; only Spark's reader touches the path."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where none is named, as in local tests, a new temporary folder is
    made once per application and becomes the checkpoint folder; on a cluster,
    whose machines do not share such a folder, that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="candlewick-")
        spark.sparkContext.setCheckpointDir(named)
        return spark.sparkContext.getCheckpointDir()
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage.

    Spark deletes the files when no frame refers to them any more, unless the
    application says otherwise (spark.cleaner.referenceTracking.cleanCheckpoints).
    """
    spark = df.sparkSession
    ship(spark)
    shared_dir(spark)
    conf, name = spark.sparkContext._jsc.sc().conf(), "spark.cleaner.referenceTracking.cleanCheckpoints"
    if not conf.contains(name):
        conf.set(name, "true")
    return df.checkpoint(eager=True)
