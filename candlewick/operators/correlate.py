"""News near price moves: a time-band join without a nested loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Pairs of one slot beyond which its articles are dealt into lots.
CROWD = 1_000_000


def near_moves(news: DataFrame, moves: DataFrame, change: str, minutes: int = 10, threshold: float = 1.0, crowd: int = CROWD) -> DataFrame:
    """Each article with each candle whose ``change`` exceeds the threshold, at most ``minutes`` away on either side.

    Both sides meet on a time slot as long as the band: an article goes to the
    two or three slots that its band touches, a candle to its own, and the band
    is checked again after this equality join. There is no condition on symbols.
    Articles and candles of each slot are counted first. In a slot with more than ``crowd`` pairs
    the articles are dealt into lots by a hash of the row and the candles go to each lot; candles that are more than ``crowd``
    themselves are dealt as well. A lot has about ``crowd`` pairs; rows that repeat in full share one.
    ``published_at`` is a timestamp, ``window_start`` epoch seconds; a null published_at joins nothing.
    """
    reach = minutes * 60
    big = moves.where(F.abs(change) > threshold).withColumn("_slot", F.floor(F.col("window_start") / reach))
    at = F.unix_seconds(F.col("published_at").cast("timestamp"))
    asked = news.where("published_at is not null").withColumn("_at", at)
    asked = asked.withColumn("_slot", F.explode(F.sequence(F.floor((F.col("_at") - reach) / reach), F.floor((F.col("_at") + reach) / reach))))
    counts = asked.groupBy("_slot").agg(F.count("*").alias("_a")).join(big.groupBy("_slot").agg(F.count("*").alias("_b")), "_slot")
    # lots of candles, then lots of articles, so that their product is about crowd pairs
    candles = F.greatest(F.lit(1), F.ceil(F.col("_b") / crowd)).cast("int")
    crowded = counts.where(F.col("_a") * F.col("_b") > crowd).select("_slot", candles.alias("_parts"), F.ceil(F.col("_a") * F.least(F.col("_b"), F.lit(crowd)) / crowd).cast("int").alias("_lots"))
    lot = lambda df, n: F.pmod(F.xxhash64(*(c for c in df.columns if not c.startswith("_"))), F.coalesce(F.col(n), F.lit(1))).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1))
    left, right = asked.join(crowded, "_slot", "left"), big.join(crowded, "_slot", "left")
    left = left.withColumn("_lot", lot(asked, "_lots")).withColumn("_part", each("_parts")).drop("_lots", "_parts")
    right = right.withColumn("_part", lot(big, "_parts")).withColumn("_lot", each("_lots")).drop("_lots", "_parts")
    return left.join(right, ["_slot", "_lot", "_part"]).where(F.col("window_start").between(F.col("_at") - reach, F.col("_at") + reach)).drop("_slot", "_lot", "_part", "_at")
