"""The trade stream: sources, exact and bounded candle jobs."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from candlewick.operators import candles, trades
from candlewick.sources import recovery
from candlewick.sources.stores import Store, publishable
from candlewick.streaming.metrics import LiveCounters, observed_messages

TRADE = "symbol string, trade_id long, price double, quantity double, timestamp long"
CANDLE = "symbol string, window_start long, open double, high double, low double, close double, volume decimal(38,12), trade_count long, updated_at timestamp"


def read_trades_stream(spark: SparkSession, source: str, **options: str) -> DataFrame:
    """Raw messages (value) of a topic or of landed files, from the earliest on.

    ``source`` is kafka:<topic> (with ``servers``; needs the Kafka package on
    the class path) or a folder of text files, one message per line. The key of a message is no row id.
    """
    if source.startswith("kafka:"):
        stream = spark.readStream.format("kafka").option("kafka.bootstrap.servers", options["servers"]).option("subscribe", source[6:]).option("startingOffsets", "earliest").option("failOnDataLoss", "true")
        return stream.load().select("value")
    return spark.readStream.format("text").option("maxFilesPerTrigger", options.get("files", "1")).load(source)


class ExactCandles:
    """Candles that any late trade may still change.

    Each micro-batch adds its new trades to those of their days, fails on an id
    that comes with different contents, recomputes the buckets that got trades
    from all of their trades, and upserts these candles with a version that grows
    from batch to batch. Messages that are no trades go to a third table, by the day on which they came. All tables take
    a batch once, so a restart or a redelivery changes nothing. A batch reads and writes
    only the days of its trades, but for ids that may have come before, whatever the date:
    id ranges and Bloom filters tell which pieces to open for these.

    Batches are known by the query's id, which its checkpoint holds, and their number. A query that has lost its
    checkpoint counts from 0 again under a new id: nothing that it brings is taken for known, and trades that are stored already change nothing.
    """

    def __init__(self, spark: SparkSession, path: str, seconds: int = 60, counters: LiveCounters | None = None):
        self.seconds, self.path, self.writer, self.counters = seconds, path, None, counters
        self.trades = Store(spark, f"{path}/trades", TRADE, "date_from_unix_date(timestamp div 86400000)", lookup=["symbol", "trade_id"]).create()
        self.candles = candle_store(spark, f"{path}/candles")
        self.rejects = Store(spark, f"{path}/rejects", "raw string, reason string, came timestamp", "cast(came as date)").create()

    def batch(self, messages: DataFrame, number: int) -> None:
        # in a query, Spark tells its id to the jobs of its batches
        writer = self.writer or messages.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
        name = (writer, number)
        if self.rejects.done(name):
            return
        seen, latest = Observation(), []
        decoded = trades.decode(messages).observe(seen, *observed_messages()).persist()
        try:
            fresh = trades.trades_of(decoded)
            days = self.trades.days_of(fresh)
            if days and not self.trades.done(name):
                known = self.trades.read_pieces(self.trades.holding(fresh)).join(fresh.select("symbol", "trade_id").distinct(), ["symbol", "trade_id"], "left_semi")
                clash = trades.conflicts(known.unionByName(fresh)).first()
                if clash is not None:
                    raise ValueError(f"conflicting trade {clash['symbol']} {clash['trade_id']}")
                self.trades.append(name, trades.distinct_trades(fresh).join(known, ["symbol", "trade_id"], "left_anti"))
            if days and not self.candles.done(name):
                buckets = fresh.select("symbol", candles.bucket_start(F.col("timestamp"), self.seconds).alias("window_start")).distinct()
                kept = self.trades.read(days).withColumn("window_start", candles.bucket_start(F.col("timestamp"), self.seconds)).join(buckets, ["symbol", "window_start"], "left_semi").drop("window_start")
                version = self.candles.log.state()["seq"] + 1  # grows whoever writes
                self.candles.upsert(name, candles.ohlcv(kept, self.seconds).withColumn("updated_at", F.timestamp_seconds(F.lit(version))), ["symbol", "window_start"])
                if self.counters:
                    latest = [tuple(r) for r in buckets.groupBy("symbol").agg(F.max("window_start")).collect()]  # a row a symbol
            self.rejects.append(name, trades.rejects(decoded).withColumn("came", F.current_timestamp()))
            if self.counters:
                self.counters.batch(*name, seen.get, latest, self.seconds)
        finally:
            decoded.unpersist()

    def start(self, messages: DataFrame, once: bool = False) -> StreamingQuery:
        writer = messages.writeStream.foreachBatch(self.batch).option("checkpointLocation", f"{self.path}/checkpoint")
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def bounded_candles(messages: DataFrame, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """Candles in update mode with state that is dropped: trades that are more than ``late`` behind are lost."""
    rows = trades.trades_of(trades.decode(messages)).withColumn("at", F.timestamp_millis("timestamp")).withWatermark("at", late)
    order = F.struct("timestamp", "trade_id")
    one = rows.dropDuplicatesWithinWatermark(["symbol", "trade_id"])
    grouped = one.groupBy("symbol", F.window("at", f"{seconds} seconds")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.sum(F.col("quantity").cast("decimal(30,12)")).alias("volume"), F.count("*").alias("trade_count"))
    return grouped.select("symbol", F.unix_seconds("window.start").alias("window_start"), "open", "high", "low", "close", "volume", "trade_count")


def bounded_conflicts(messages: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(symbol, trade_id) of ids that come with different contents within ``late``, in update mode; ``bounded_candles`` keeps the first of these."""
    rows = trades.trades_of(trades.decode(messages)).withColumn("at", F.timestamp_millis("timestamp")).withWatermark("at", late)
    payload = F.struct("price", "quantity", "timestamp")
    one = rows.groupBy("symbol", "trade_id", F.window("at", late)).agg(F.min(payload).alias("lo"), F.max(payload).alias("hi"))
    return one.where("lo <> hi").select("symbol", "trade_id", F.col("window.start").alias("seen"), "lo", "hi")


def publish(rows: DataFrame, topic: str, servers: str, checkpoint: str) -> StreamingQuery:
    """Trades to a keyed topic (needs the Kafka package)."""
    return publishable(rows).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


def with_recovery(write: Callable[[DataFrame, int], None], path: str, kind: str, attempts: int = 3) -> Callable[[DataFrame, int], None]:
    """A batch writer that is tried a few times; then its rows become recovery records and the query fails."""

    def batch(rows: DataFrame, number: int) -> None:
        for left in reversed(range(attempts)):
            try:
                return write(rows, number)
            except Exception as e:
                if not left:
                    recovery.append(rows, path, kind, str(e)[:200])
                    raise
        return None

    return batch


def upsert_candles(spark: SparkSession, path: str, rows: DataFrame, batch: str) -> bool:
    """Candles (with updated_at) into the store at ``path``."""
    return candle_store(spark, path).upsert(batch, rows, ["symbol", "window_start"])


def candle_store(spark: SparkSession, path: str) -> Store:
    """The candles that an exact job keeps under ``path``."""
    return Store(spark, path, CANDLE, "date_from_unix_date(window_start div 86400)", keys=["symbol", "window_start"]).create()


def stored_lookback(store: Store, now: int, minutes: int, columns: list[str]) -> DataFrame:
    """Some columns of the stored candles after ``now`` minus ``minutes``: only the days since then are read, and of these the row groups and columns asked for."""
    first = datetime.fromtimestamp((now - minutes * 60) // 86400 * 86400, UTC).date().isoformat()
    rows = store.read([day for day in store.days() if day >= first], list(dict.fromkeys([*columns, "window_start"])))
    return rows.where(F.col("window_start") > now - minutes * 60).select(*columns)


def replay_handlers(spark: SparkSession, path: str, send: Callable[[DataFrame], None]) -> dict[str, Callable[[DataFrame], None]]:
    """What ``recovery.replay`` does with each kind: trades go out again through ``send`` as (key, value), candles
    into the store at ``path``, where their version decides; so a record that is replayed twice changes nothing."""

    def trade(rows: DataFrame) -> None:
        send(publishable(trades.trades_of(trades.decode(rows, "payload"))))

    def candle(rows: DataFrame) -> None:
        upsert_candles(spark, path, rows.select(F.from_json("payload", CANDLE).alias("c")).select("c.*"), f"replay-{uuid.uuid4().hex}")

    return {"trade": trade, "candle": candle}


__all__ = ["ExactCandles", "bounded_candles", "bounded_conflicts", "candle_store", "publish", "read_trades_stream", "replay_handlers", "stored_lookback", "upsert_candles", "with_recovery"]
