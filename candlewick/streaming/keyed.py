"""Candles as keyed state: each batch reads and writes the state of its own keys only, never the trades of a bucket.

Two stateful steps, both in RocksDB with changelog checkpoints, neither ever dropped:

1. Ids: the trades that were seen, 64 consecutive ids of a symbol in one entry (exchanges number their trades
   in sequence, so a batch's trades share few entries). A trade passes once; an id that comes with different contents fails the query,
   whatever the dates.
2. Candles: one entry of fixed size for each symbol and bucket. Each batch emits every candle that it changed, whole.

``start`` upserts what is emitted into a candle store, a batch once, by the query's id and its number. A restart goes on from the
checkpoint; a query that has lost its checkpoint has lost its state and must read its source from the earliest message on.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, DecimalType, DoubleType, LongType, StructField, StructType

from candlewick.operators import candles, trades
from candlewick.session import ship
from candlewick.streaming.candles import candle_store

#: Ids that are equal but for so many bits are in one entry of state.
SHIFT = 6
_SEEN = np.dtype([("trade_id", "<i8"), ("price", "<f8"), ("quantity", "<f8"), ("timestamp", "<i8")])
_EXACT = decimal.Context(prec=60)
_FRESH = "symbol string, trade_id long, price double, timestamp long, volume decimal(30,12)"
_CANDLE = "symbol string, window_start long, open double, high double, low double, close double, volume decimal(38,12), trade_count long"
# no text form: a worker cannot parse one
_IDS = StructType([StructField("trades", BinaryType())])
_STATE = StructType(
    [StructField(f"{which}_{name}", kind) for which in ("first", "last") for name, kind in (("at", LongType()), ("id", LongType()), ("price", DoubleType()))]
    + [StructField("high", DoubleType()), StructField("low", DoubleType()), StructField("volume", DecimalType(38, 12)), StructField("trade_count", LongType())]
)
_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


class OnceEach(StatefulProcessor):
    """Trades of (symbol, block of ids) that were not seen before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", _IDS)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = self.seen.get()
        known = {t[0]: t[1:] for t in np.frombuffer(held[0], _SEEN).tolist()} if held else {}
        before = len(known)
        for r in rows:
            content = (r.price, r.quantity, r.timestamp)
            if known.setdefault(r.trade_id, content) is content:
                yield Row(symbol=r.symbol, trade_id=r.trade_id, price=r.price, timestamp=r.timestamp, volume=r.volume)
            elif known[r.trade_id] != content:
                raise ValueError(f"conflicting trade {r.symbol} {r.trade_id}")
        if len(known) > before:
            self.seen.update((np.array([(i, *t) for i, t in known.items()], _SEEN).tobytes(),))

    def close(self) -> None:
        pass


class Candle(StatefulProcessor):
    """The candle of (symbol, bucket) after each batch that brought trades for it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.candle = handle.getValueState("candle", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = self.candle.get()
        first, last, high, low, volume, n = ((*held[0:3],), (*held[3:6],), *held[6:10]) if held else (None, None, None, None, decimal.Decimal(0), 0)
        for r in rows:
            own = (r.timestamp, r.trade_id, r.price)
            first, last = (own, own) if first is None else (min(first, own), max(last, own))
            high, low = (r.price, r.price) if high is None else (max(high, r.price), min(low, r.price))
            volume, n = _EXACT.add(volume, r.volume), n + 1
        self.candle.update((*first, *last, high, low, volume, n))
        yield Row(symbol=key[0], window_start=key[1], open=first[2], high=high, low=low, close=last[2], volume=volume, trade_count=n)

    def close(self) -> None:
        pass


def keyed_candles(messages: DataFrame, seconds: int = 60) -> DataFrame:
    """(symbol, window_start, open, high, low, close, volume, trade_count) of a stream of messages: every candle that a
    batch changed, in append mode. Messages that are no trades are passed over; no trade is ever too late."""
    ship(messages.sparkSession)
    rows = trades.trades_of(trades.decode(messages)).withColumn("volume", F.col("quantity").cast("decimal(30,12)"))
    once = rows.withColumn("ids", F.shiftright("trade_id", SHIFT)).groupBy("symbol", "ids").transformWithState(OnceEach(), _FRESH, "append", "none")
    return once.withColumn("window_start", candles.bucket_start(F.col("timestamp"), seconds)).groupBy("symbol", "window_start").transformWithState(Candle(), _CANDLE, "append", "none")


def start(messages: DataFrame, path: str, seconds: int = 60, once: bool = False) -> StreamingQuery:
    """Keeps the candles of ``messages`` in the store under ``path``; its state lies beside it."""
    spark = messages.sparkSession
    store = candle_store(spark, f"{path}/candles")

    def write(rows: DataFrame, number: int) -> None:
        writer = rows.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "keyed"
        if store.done((writer, number)):
            return
        version = F.timestamp_seconds(F.lit(store.log.state()["seq"] + 1))  # grows whoever writes
        store.upsert((writer, number), rows.withColumn("updated_at", version), ["symbol", "window_start"])

    before = {k: spark.conf.get(k, None) for k in _CONF}
    try:
        for k, v in _CONF.items():
            spark.conf.set(k, v)  # a query takes its settings along when it starts
        writer = keyed_candles(messages, seconds).writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", f"{path}/checkpoint")
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


__all__ = ["SHIFT", "keyed_candles", "start"]
