"""Window plans that stay parallel when there are few keys.

A window by symbol alone puts a symbol's whole history into one task. Both
plans here cut the order into blocks, so that a task holds one block of one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def before(df: DataFrame, keys: list[str], block: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the largest ``value`` of all earlier rows of the same keys.

    Within a block by a window; from earlier blocks by one pre-aggregated row
    per block. With a struct that begins with the order column, the largest is the latest.
    ``block`` must not decrease along ``order``.
    """
    rows = df.withColumn("_block", block).withColumn("_value", value)
    per = rows.groupBy(*keys, "_block").agg(F.max("_value").alias("_last"))
    blocks = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, "_block", F.max("_last").over(blocks).alias("_carried"))
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_near", F.max("_value").over(inside)).join(per, [*keys, "_block"])
    return rows.withColumn(name, F.greatest("_near", "_carried")).drop("_block", "_value", "_near", "_carried")


def haloed(df: DataFrame, at: str, span: int, reach: int) -> DataFrame:
    """``df`` in blocks of ``span`` seconds of column ``at``, column ``_block``; each block also gets the rows
    of the ``reach`` seconds before it, marked ``_halo``, for windows that look back no further."""
    block = F.floor(F.col(at) / span)
    last = F.floor((F.col(at) + reach) / span)
    rows = df.withColumn("_block", F.explode(F.sequence(block, last)))
    return rows.withColumn("_halo", F.col("_block") > block)
