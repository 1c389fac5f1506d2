"""The given tables as the relations that the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.functions import vocabulary
from candlewick.functions.expressions import sentiment_of, symbols_in, tokens
from candlewick.operators import candles as c
from candlewick.operators import trades as t
from candlewick.session import table

#: 2024-01-31 00:00:00 UTC, the moment at which queries are asked.
NOW = 1706659200
HOUR = 3600


def events_as_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a trade, valid or not."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.upper("event_type").alias("symbol"),
        F.col("event_id").alias("trade_id"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("decimal(30,12)").alias("quantity"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.computed(events_as_trades(spark, sf_dir), "quantity", F.col("quantity"))
    return t.keep_valid(rows).select(*t.FIELDS)


def redelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of which every tenth arrives twice."""
    rows = trades(spark, sf_dir)
    return rows.unionByName(rows.where("trade_id % 10 = 0"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.ohlcv(trades(spark, sf_dir), HOUR)


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades with ids missing."""
    return trades(spark, sf_dir).where("trade_id % 13 not in (3, 4)")


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles, tagged."""
    d = table(spark, sf_dir, "documents")
    words = tokens(F.col("title"), F.col("content"))
    rows = d.select(
        F.col("doc_id").alias("position"),
        F.substring(F.substring_index("text", "\n", 1), 1, 80).alias("title"),
        F.concat(F.lit("https://n.example/"), F.col("doc_id").cast("string"), F.lit("/?utm=x")).alias("url"),
        "source",
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 43 * 60).alias("published_at"),
        F.timestamp_seconds(F.lit(1704067500) + F.col("doc_id") * 43 * 60).alias("collected_at"),
        F.col("text").alias("content"),
    )
    rows = rows.withColumn("words", words)
    return rows.withColumn("symbols", symbols_in(F.col("words"), vocabulary.PROSE_KEYWORDS)).withColumn("sentiment", sentiment_of(F.col("words"), vocabulary.PROSE_POSITIVE, vocabulary.PROSE_NEGATIVE)).drop("words")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as market snapshots: one coin per order, taken on its date."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderdate").cast("timestamp_ntz").alias("collected_at"),
        F.col("o_custkey").cast("string").alias("symbol"),
        F.col("o_orderpriority").alias("name"),
        F.col("o_totalprice").alias("price"),
        (F.col("o_totalprice") * 10).alias("market_cap"),
        (F.col("o_orderkey") % 1000 + 1).cast("double").alias("volume_24h"),
        F.round(F.col("o_totalprice") % 20 - 10, 4).alias("price_change_24h"),
    )
