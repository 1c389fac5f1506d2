"""Small things that the operators of this subpackage share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.session import cut, shared_dir, ship, table

__all__ = ["Tables", "bounded_sample", "crc_mod", "cut", "dropped", "few", "release", "shared_dir", "ship", "table"]


def crc_mod(column: str, by: int) -> Column:
    """crc32 of the value's text, modulo ``by`` (null for a null)."""
    return F.crc32(F.col(column).cast("string")) % by


def bounded_sample(rows: DataFrame, by: str, most: int, key: Column) -> DataFrame:
    """About ``most`` rows of each value of ``by``, chosen by a hash of ``key``.

    Only the fitting of a model uses this. The counts per value are a few rows;
    each row is then kept or not by its own hash, so no shuffle and no sort is
    needed and a rerun of a lost task chooses the same rows.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(by).count().collect()}
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(by) == F.lit(value), F.lit(min(1.0, most / n))).otherwise(share)
    place = F.pmod(F.xxhash64(key), F.lit(1 << 20)) / float(1 << 20)
    return rows.where(place < share)


#: Rows of a few dozen bytes that may be sent to all tasks.
SENT = 200_000


def few(df: DataFrame, weight: Column | None = None, most: int = SENT) -> DataFrame:
    """``df`` with a broadcast hint if its rows (or the sum of ``weight``) are at most ``most``, else as it is."""
    n = df.agg(F.count("*") if weight is None else F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    return F.broadcast(df) if n <= most else df


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and checkpoints of frames that nobody holds any more.

    It does so when the driver collects garbage, which a driver with memory to
    spare may not do for the length of a loop that writes some in every round.
    """
    for _ in range(2):  # the first round lets go of what Python held, the second of what that held in turn
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a folder that was written under the shared one."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


class Tables:
    """Frames of one computation as Parquet under the shared folder, deleted round by round.

    Reading a frame back cuts its lineage, and its size is that of its files: a checkpoint keeps the estimate of
    the plan it came from, which joins multiply from round to round.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.top, self.made = spark, f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}", {}

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self.top}/{len(self.made)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.made[path] = out
        return out

    def drop_since(self, mark: int, *kept: DataFrame | None) -> None:
        """Delete what was written since there were ``mark`` frames, but for those in ``kept``."""
        for path, df in list(self.made.items())[mark:]:
            if df is not None and not any(df is k for k in kept):
                dropped(self.spark, path)
                self.made[path] = None

    def drop(self) -> None:
        dropped(self.spark, self.top)
