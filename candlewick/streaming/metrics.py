"""Live counters of a streaming job, taken from the pass that writes: no second scan of what came or of what is stored."""

from __future__ import annotations

import json
import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

METRIC = "section string, metric string, value double"


def observed_messages() -> list:
    """What is counted of decoded messages (with ``trade``) while they are written."""
    return [F.count("*").alias("events"), F.count("trade").alias("trades"), F.max("trade.timestamp").alias("last_event")]


class LiveCounters(StreamingQueryListener):
    """Adds up what batches observe, and what queries report of their sources.

    ``batch`` is called by a job once a batch is written, with the metrics observed in it; a batch that is
    delivered again is counted once. As a listener (``spark.streams.addListener``) it keeps
    each query's lag, the records that its sources hold and it has not read, and its end: a query that failed is a
    failed run. ``rows`` gives all of it in the long form that ``operators.monitor.alerts`` takes.
    """

    def __init__(self) -> None:
        self.lock = threading.Lock()
        self.done: dict[str, int] = {}
        self.events = self.trades = self.failed = 0
        self.last_event: int | None = None
        self.latency: dict[str, tuple[float, float]] = {}
        self.lags: dict[str, tuple[int, int] | None] = {}
        self.input_rows: dict[str, int] = {}

    def batch(self, writer: str, number: int, seen: dict, candles: list[tuple[str, int]] = (), seconds: int = 60, now: float | None = None) -> None:
        """Count a written batch: its observed metrics, and the latest candle of each symbol that it made."""
        with self.lock:
            if number <= self.done.get(writer, -1):
                return
            self.done[writer] = number
            self.events += seen["events"]
            self.trades += seen["trades"]
            self.last_event = max((x for x in (self.last_event, seen["last_event"]) if x is not None), default=None)
            for symbol, start in candles:
                late = max(0.0, (time.time() if now is None else now) - (start + seconds))
                self.latency[symbol] = (late, max(late, self.latency.get(symbol, (0.0, 0.0))[1]))

    @staticmethod
    def behind(sources) -> tuple[int, int] | None:
        """(lag, log end) over the partitions of sources that tell their latest offset as {topic: {partition: offset}}; None without any."""
        lag = end = 0
        found = False
        for source in sources:
            try:
                latest, current = (json.loads(x) if x else {} for x in (source.latestOffset, source.endOffset))
                pairs = [(int(o), int(current[t][p])) for t, parts in latest.items() for p, o in parts.items()]
            except (AttributeError, KeyError, TypeError, ValueError):
                continue  # files and rates have offsets of other kinds
            found = found or bool(pairs)
            lag, end = lag + sum(a - b for a, b in pairs), end + sum(a for a, _ in pairs)
        return (lag, end) if found else None

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        with self.lock:
            self.lags[str(p.id)] = self.behind(p.sources)
            self.input_rows[str(p.id)] = self.input_rows.get(str(p.id), 0) + p.numInputRows

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        with self.lock:
            self.failed += event.exception is not None

    def rows(self, spark: SparkSession) -> DataFrame:
        """(section, metric, value): a row a counter; lag is missing, not 0, where no source tells it."""
        with self.lock:
            read = sum(self.input_rows.values())  # what sources handed over, once a query reports
            lost = read - self.events if read else 0
            out = [("feed", "events_total", self.events), ("feed", "trades_total", self.trades), ("feed", "invalid_total", self.events - self.trades), ("feed", "events_lost", lost), ("runs", "failed_runs", self.failed)]
            out += [("feed", "last_event", self.last_event)] if self.last_event is not None else []
            out += [("feed", f"last_latency_{s}", a) for s, (a, _) in sorted(self.latency.items())] + [("feed", f"max_latency_{s}", b) for s, (_, b) in sorted(self.latency.items())]
            told = [x for x in self.lags.values() if x is not None]
            out += [("broker", "lag_total", sum(a for a, _ in told)), ("broker", "log_end_total", sum(b for _, b in told))] if told else []
        return spark.createDataFrame([(s, m, float(v)) for s, m, v in out], METRIC)
