"""Candles and what is computed from runs of them. Times are epoch seconds until a result is returned."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from candlewick.functions.expressions import at_second, bucket_start, finite
from candlewick.plans.windows import before, haloed

#: Steps of the grain that one window block spans.
BLOCK = 1440


def ohlcv(trades: DataFrame, seconds: int = 60) -> DataFrame:
    """(symbol, window_start, open, high, low, close, volume, trade_count) of distinct valid trades.

    Order within a bucket is (timestamp, trade_id), found by the aggregate itself, so no sort is needed
    and a busy symbol is pre-aggregated before it is shuffled.
    """
    order = F.struct("timestamp", "trade_id")
    rows = trades.withColumn("window_start", bucket_start(F.col("timestamp"), seconds))
    return rows.groupBy("symbol", "window_start").agg(
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.sum(F.col("quantity").cast("decimal(30,12)")).alias("volume"),
        F.count("*").alias("trade_count"),
    )


def price_changes(candles: DataFrame, now: int, seconds: int = 60, steps: tuple[int, ...] = (1, 5, 15)) -> DataFrame:
    """``candles`` with price_change_<n> in percent for each n.

    Only for closed candles whose n predecessors are there without a gap, on the grid, with a finite close above 0.
    """
    rows = haloed(candles, "window_start", BLOCK * seconds, max(steps) * seconds)
    ordered = Window.partitionBy("symbol", "_block").orderBy("window_start")
    good = finite(F.col("close")) & (F.col("close") > 0) & (F.col("window_start") % seconds == 0)
    for n in steps:
        then, price = F.lag("window_start", n).over(ordered), F.lag("close", n).over(ordered)
        sound = F.count(F.when(good, 1)).over(ordered.rowsBetween(-n, 0))
        usable = (F.col("window_start") < now // seconds * seconds) & (F.col("window_start") - then == n * seconds) & (sound == n + 1)
        rows = rows.withColumn(f"price_change_{n}", F.when(usable, (F.col("close") / F.nullif(price, F.lit(0)) - 1) * 100))
    return rows.where(~F.col("_halo")).drop("_block", "_halo")


def price_change_lag(candles: DataFrame, seconds: int = 60) -> DataFrame:
    """``candles`` with price_change against the candle before, however long ago; null for the first and after a zero."""
    latest = F.struct("window_start", "close")
    rows = before(candles, ["symbol"], F.floor(F.col("window_start") / (BLOCK * seconds)), ["window_start"], latest, "previous")
    old = F.nullif(F.col("previous.close"), F.lit(0).cast(candles.schema["close"].dataType))
    return rows.withColumn("price_change", F.round((F.col("close") / old - 1) * 100, 4)).drop("previous")


def _closed(candles: DataFrame, now: int, seconds: int, sound: Column) -> DataFrame:
    return candles.where((F.col("window_start") % seconds == 0) & (F.col("window_start") < now // seconds * seconds) & sound)


def _once_each(rows: DataFrame, ordered: WindowSpec, content: list[str]) -> DataFrame:
    """Each step's candle once; the job fails where one step has two contents. Uses the blocks and order that are there."""
    own, same = F.struct(*content), ordered.rangeBetween(0, 0)
    told = F.concat(F.lit("conflicting candles "), F.col("symbol"), F.lit(" "), F.col("window_start").cast("string"))
    rows = rows.withColumn("_lo", F.min(own).over(same)).withColumn("_hi", F.max(own).over(same)).withColumn("_last", F.lag("window_start").over(ordered))
    first = F.col("_last").isNull() | (F.col("_last") != F.col("window_start"))
    return rows.where(F.when(F.col("_lo").eqNullSafe(F.col("_hi")), first).otherwise(F.raise_error(told).cast("boolean"))).drop("_lo", "_hi", "_last")


def volume_spikes(candles: DataFrame, now: int, seconds: int = 60, recent: int = 5, baseline: int = 60, threshold: float = 3.0, lookback: int = 60) -> DataFrame:
    """(symbol, signal_type, window_start, recent_volume, baseline, ratio): the last ``recent`` candles against the ``baseline`` before.

    An endpoint needs all candles of both, valid and without a gap; the ratio must exceed the threshold.
    Repeated candles count once; two different ones of a minute fail the job.
    """
    volume = F.col("volume")
    rows = _closed(candles, now, seconds, finite(volume) & (volume >= 0))
    total = recent + baseline
    content = [c for c in rows.columns if c not in ("symbol", "window_start")]
    rows = haloed(rows, "window_start", BLOCK * seconds, (total - 1) * seconds)
    w = Window.partitionBy("symbol", "_block").orderBy("window_start")
    rows = _once_each(rows, w, content)
    back = lambda first, last: w.rangeBetween(-first * seconds, -last * seconds)
    rows = rows.withColumn("n", F.count("*").over(back(total - 1, 0)))
    rows = rows.withColumn("late", F.sum("volume").over(back(recent - 1, 0)).cast("double"))
    rows = rows.withColumn("early", F.sum("volume").over(back(total - 1, recent)).cast("double") / baseline * recent)
    since = now // seconds * seconds - lookback * seconds
    rows = rows.where(~F.col("_halo") & (F.col("n") == total) & (F.col("window_start") >= since) & (F.col("early") > 0))
    rows = rows.withColumn("ratio", F.col("late") / F.col("early")).where(F.col("ratio") > threshold)
    return rows.select("symbol", F.lit("VOLUME_SPIKE").alias("signal_type"), "window_start", F.col("late").alias("recent_volume"), F.round("early", 8).alias("baseline"), F.round("ratio", 2).alias("ratio"))


def price_spikes(candles: DataFrame, now: int, threshold: float, seconds: int = 60, steps: int = 5, lookback: int = 60) -> DataFrame:
    """(symbol, signal_type, window_start, baseline_close, close, change_pct, direction): a move of at least ``threshold`` percent over ``steps`` candles.

    The comparison is one of decimals, so that exactly 1 percent counts as 1 percent.
    Repeated candles count once; two different closes of a minute fail the job.
    """
    if not 0 < threshold < float("inf"):
        raise ValueError("threshold must be finite and above 0")
    exact = Decimal(str(threshold))
    places = max(0, -exact.as_tuple().exponent)
    if places > 12 or exact >= 10**4:
        raise ValueError("threshold must have at most 12 places and be below 10,000 percent")
    close = F.col("close")
    rows = _closed(candles, now, seconds, finite(close) & (close > 0))
    rows = haloed(rows.withColumn("close", close.cast("decimal(20,8)")), "window_start", BLOCK * seconds, steps * seconds)
    w = Window.partitionBy("symbol", "_block").orderBy("window_start")
    rows, frame = _once_each(rows, w, ["close"]), w.rangeBetween(-steps * seconds, 0)
    rows = rows.withColumn("n", F.count("*").over(frame)).withColumn("base", F.first("close").over(frame))
    since = now // seconds * seconds - lookback * seconds
    rows = rows.where(~F.col("_halo") & (F.col("n") == steps + 1) & (F.col("window_start") >= since))
    # without a division, so the comparison is exact: |close - base| * 100 >= threshold * base
    bound = F.lit(f"{exact:f}").cast(f"decimal({places + 4},{places})") * F.col("base")
    rows = rows.where(F.abs(close - F.col("base")) * 100 >= bound)
    change = (close.cast("double") / F.col("base").cast("double") - 1) * 100
    return rows.select(
        "symbol", F.lit("PRICE_SPIKE").alias("signal_type"), "window_start", F.col("base").cast("double").alias("baseline_close"),
        close.cast("double").alias("close"), F.round(change, 4).alias("change_pct"), F.when(close > F.col("base"), "up").otherwise("down").alias("direction"),
    )


# The names under which a signal's details are stored.
DETAILS = {"recent_volume": "recent_volume_5m", "baseline": "baseline_5m", "change_pct": "price_change_5m_pct"}


def as_signals(spikes: DataFrame, threshold: float | None = None) -> DataFrame:
    """(symbol, signal_type, window_start, details): what a signal table stores, of price spikes with the threshold that they passed."""
    rest = [F.col(c).alias(DETAILS.get(c, c)) for c in spikes.columns if c not in ("symbol", "signal_type", "window_start")]
    rest += [] if threshold is None else [F.lit(float(threshold)).alias("threshold_pct")]
    return spikes.select("symbol", "signal_type", "window_start", F.to_json(F.struct(*rest)).alias("details"))


def lookback(candles: DataFrame, now: int, minutes: int, columns: list[str]) -> DataFrame:
    """Some columns of the candles after ``now`` minus ``minutes``."""
    return candles.where(F.col("window_start") > now - minutes * 60).select(*columns)


def shown(df: DataFrame, *columns: str) -> DataFrame:
    """window_start as a timestamp, decimals as doubles."""
    out = df.withColumn("window_start", at_second(F.col("window_start")))
    for c in columns:
        out = out.withColumn(c, F.col(c).cast("double"))
    return out
