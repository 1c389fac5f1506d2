"""Writes as pure functions of what is stored and what comes in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_per_key(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Of the rows of each key the first in ``order``, nulls last; pre-aggregated, so a key that repeats often is no hot spot.

    Whole rows go through the aggregate: select the columns that are wanted before it.
    """
    one = rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), F.struct(order.isNull().alias("last"), order.alias("order"))).alias("_row"))
    return one.select("_row.*")


def upsert_versioned(stored: DataFrame, incoming: DataFrame, keys: list[str], version: str = "updated_at") -> DataFrame:
    """The table after an upsert that never lets an older version replace a newer one.

    A row is replaced if its version is not above the incoming one's; of several
    incoming rows the highest version counts. A stored row without a version counts as oldest.
    """
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    rank = F.struct(F.coalesce(F.col(version), F.lit("1970-01-01").cast("timestamp").cast(stored.schema[version].dataType)), F.col("_new"))
    kept = both.groupBy(*keys).agg(F.max_by(F.struct(*both.columns), rank).alias("_row"))
    return kept.select("_row.*").drop("_new")


def insert_absent(stored: DataFrame, incoming: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The incoming rows to append: the first of each key, if the key is not stored yet."""
    return first_per_key(incoming, keys, order).join(stored.select(*keys), keys, "left_anti")


def quarantined(rows: DataFrame, pipeline: str, error: str = "error") -> DataFrame:
    """(pipeline, payload, error) of rows that carry an error; the payload is the row as JSON."""
    rest = [c for c in rows.columns if c != error]
    return rows.where(F.col(error).isNotNull()).select(F.lit(pipeline).alias("pipeline"), F.to_json(F.struct(*rest)).alias("payload"), F.col(error).alias("error"))


def table_name(base: str, environment: str) -> str:
    """Tables of all environments but prod carry its name."""
    return base if environment == "prod" else f"{base}_{environment}"
