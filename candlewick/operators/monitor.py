"""Counters, rates and alerts from metrics in long form: (section, metric, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.plans.windows import before

#: Seconds of one series that a window of ``rates`` holds.
SPAN = 86_400

# Metric, section, environment variable of its threshold, default, direction.
RULES = [
    ("newest_candle_age_min", "db", "ALERT_MAX_CANDLE_AGE_MIN", 15.0, "gt"),
    ("candles_10m", "db", "ALERT_MIN_CANDLES_10M", 20.0, "lt"),
    ("news_1h", "db", "ALERT_MIN_NEWS_1H", 1.0, "lt"),
    ("failed_runs", "runs", "ALERT_MAX_FAILED_RUNS", 0.0, "gt"),
    ("events_lost", "feed", "ALERT_MAX_EVENTS_LOST", 0.0, "gt"),
    ("publish_failures_total", "feed", "ALERT_MAX_PUBLISH_FAILURES", 0.0, "gt"),
    ("dlq_write_failures_total", "feed", "ALERT_MAX_DLQ_FAILURES", 0.0, "gt"),
    ("lag_total", "broker", "ALERT_MAX_CONSUMER_LAG", 5000.0, "gt"),
]
#: Sections that must report; of these, the rules of one in error are not evaluated.
REQUIRED = ("feed", "broker")


def rules(spark: SparkSession, overrides: dict[str, str] | None = None) -> DataFrame:
    """The rule table; a threshold that is not a finite number of at least 0 is null."""
    rows = spark.createDataFrame([(m, s, v, str((overrides or {}).get(v, d)), op) for m, s, v, d, op in RULES], "metric string, section string, variable string, threshold string, op string")
    limit = F.col("threshold").try_cast("double")
    return rows.withColumn("threshold", F.when(~F.isnan(limit) & (limit >= 0) & (limit < float("inf")), limit))


def alerts(metrics: DataFrame, rule_table: DataFrame) -> DataFrame:
    """(subject, reason) of everything that calls for action.

    ``metrics`` is (section, metric, value); a section in error has one row
    with metric ``error``. A database in error is the only alert. ``rule_table``
    is the eight rows of ``rules``, hence the broadcast.
    """
    failing = metrics.where("metric = 'error'").select("section").distinct()
    seen = metrics.select("section").distinct()
    wanted = metrics.sparkSession.createDataFrame([(s,) for s in REQUIRED], "section string")
    engine = failing.where("section = 'engine'").select("section")
    absent = wanted.join(seen.join(failing, "section", "left_anti"), "section", "left_anti").unionByName(engine).select(F.col("section").alias("subject"), F.lit("unavailable").alias("reason"))
    skipped = F.col("section").isin(*REQUIRED)
    asked = rule_table.join(absent.select(F.col("subject").alias("section")), "section", "left_anti")
    got = metrics.where("metric <> 'error'").select("section", "metric", F.col("value"), F.lit(True).alias("there"))
    facts = got.join(F.broadcast(rule_table.select("section", "metric")), ["section", "metric"], "left_semi")
    rows = asked.join(facts, ["section", "metric"], "left").withColumn("skipped", skipped)
    size = F.when(F.col("metric") == "events_lost", F.abs("value")).otherwise(F.col("value"))
    bad = F.when(F.col("op") == "gt", size > F.col("threshold")).otherwise(size < F.col("threshold"))
    reason = (
        F.when(F.col("threshold").isNull(), "invalid threshold")
        .when(F.col("value").isNull(), "missing")
        .when(F.isnan("value") | (F.abs("value") == float("inf")), "invalid")
        .when(bad, "beyond threshold")
    )
    broken = rows.select(F.col("metric").alias("subject"), reason.alias("reason")).where("reason is not null")
    recovery = metrics.where("section = 'backfill' and metric in ('pending_trades', 'checkpoint_failures_total') and (value > 0 or value < 0 or value is null)")
    pending = recovery.select(F.col("metric").alias("subject"), F.when(F.col("value") > 0, "pending").otherwise("invalid").alias("reason"))
    all_of = absent.unionByName(broken).unionByName(pending)
    down = failing.where("section = 'db'").select(F.lit("db").alias("subject"), F.lit("unreachable").alias("reason"))
    # with a database down nothing else is reported: the only row of ``down`` meets every other alert on a constant
    rest = all_of.withColumn("section", F.lit("db")).join(failing, "section", "left_anti").drop("section")
    return down.unionByName(rest)


def delivery(outcomes: DataFrame) -> DataFrame:
    """(received, acknowledged, invalid, failed, pending, lost) of one row per message with its ``state``; either sign of lost is a fault."""
    n = lambda state: F.count_if(F.coalesce(F.col("state") == state, F.lit(False)))
    one = outcomes.agg(F.count("*").alias("received"), n("acknowledged").alias("acknowledged"), n("invalid").alias("invalid"), n("failed").alias("failed"), n("pending").alias("pending"))
    return one.withColumn("lost", F.col("received") - (F.col("acknowledged") + F.col("invalid") + F.col("failed") + F.col("pending")))


def lag(partitions: DataFrame) -> DataFrame:
    """(lag_total, log_end_total) over (log_end, current): null, not 0, without partitions."""
    known = partitions.where("current is not null")
    return known.agg(F.sum(F.col("log_end") - F.col("current")).alias("lag_total"), F.sum("log_end").alias("log_end_total"))


def rates(samples: DataFrame) -> DataFrame:
    """(series, at, rate): growth of ``total`` per second since the sample before; null for the first and for samples under a second apart."""
    latest = F.struct("at", "total")
    rows = before(samples.select("series", "at", "total"), ["series"], F.floor(F.unix_seconds("at") / SPAN), ["at"], latest, "previous")
    passed = F.unix_micros("at") - F.unix_micros("previous.at")
    grown = F.col("total") - F.col("previous.total")
    return rows.select("series", "at", F.when(passed >= 1_000_000, F.round(grown / (passed / 1e6), 1)).alias("rate"))


def latencies(emitted: DataFrame, seconds: int = 60) -> DataFrame:
    """(symbol, windows, last_window, last_close, last_latency, max_latency) of candles (symbol, window_start, close, written_at), times in epoch seconds."""
    late = F.greatest(F.lit(0.0), F.col("written_at") - (F.col("window_start") + seconds))
    order = F.struct("written_at", "window_start")
    return emitted.withColumn("late", late).groupBy("symbol").agg(
        F.count_distinct("window_start").alias("windows"), F.max_by("window_start", order).alias("last_window"), F.max_by("close", order).alias("last_close"),
        F.round(F.max_by("late", order), 3).alias("last_latency"), F.round(F.max("late"), 3).alias("max_latency"))


def stream_counters(trades: DataFrame, emitted: DataFrame) -> DataFrame:
    """(events_total, last_event, windows_created_total) of trades (timestamp) and candles (symbol, window_start): one row."""
    events = trades.agg(F.count("*").alias("events_total"), F.max("timestamp").alias("last_event"))
    windows = emitted.select("symbol", "window_start").distinct().agg(F.count("*").alias("windows_created_total"))
    one = F.lit(1).alias("k")  # a row each
    return events.select("*", one).join(windows.select("*", one), "k").drop("k")


def run_outcomes(log: DataFrame) -> DataFrame:
    """(success, failed): outcome markers in the lines of a run log."""
    n = lambda word: F.coalesce(F.sum(F.regexp_count("value", F.lit(word))), F.lit(0)).cast("long")
    return log.agg(n("RUN_SUCCESS").alias("success"), (n("RUN_FAILURE") + n("STEP_FAILURE") + n("DagsterLaunchFailedError")).alias("failed"))
