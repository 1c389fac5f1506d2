import json
import math
import random

import pytest
from pyspark.sql import functions as F

from candlewick.operators import candles, monitor, trades
from candlewick.sources import recovery
from candlewick.sources.stores import Store
from candlewick.streaming import keyed
from candlewick.streaming.metrics import LiveCounters
from candlewick.streaming.candles import CANDLE, ExactCandles, bounded_candles, bounded_conflicts, candle_store, read_trades_stream, replay_handlers, stored_lookback, upsert_candles

T0 = 1757578861000
FIELDS = "symbol string, trade_id long, price double, quantity double, timestamp long"


def made(spark, rows):
    return spark.createDataFrame(rows, FIELDS)


def ohlcv(spark, rows, seconds=60):
    out = candles.ohlcv(trades.distinct_trades(trades.keep_valid(made(spark, rows))), seconds).collect()
    return {(r["symbol"], r["window_start"]): (r["open"], r["high"], r["low"], r["close"], float(r["volume"]), r["trade_count"]) for r in out}


def test_two_buckets(spark):
    got = ohlcv(spark, [("B", 1, 100.0, 1.0, 1789363000000), ("B", 2, 110.0, 2.0, 1789363030000), ("B", 3, 105.0, 1.0, 1789363060000)])
    assert sorted(got.values()) == [(100, 100, 100, 100, 1, 1), (110, 110, 105, 105, 3, 2)]


def test_order_ties_duplicates_and_symbols(spark):
    rows = [("BTC", 2, 10.0, 2.0, T0), ("BTC", 1, 9.0, 1.0, T0), ("BTC", 2, 10.0, 2.0, T0), ("ETH", 1, 50.0, 1.0, T0)]
    got = {k[0]: v for k, v in ohlcv(spark, rows).items()}
    assert got == {"BTC": (9, 10, 9, 10, 3, 2), "ETH": (50, 50, 50, 50, 1, 1)}
    late = [("S", 1, 105.0, 1.0, T0 + 10), ("S", 2, 98.0, 1.0, T0 + 20), ("S", 3, 100.0, 1.0, T0 + 5)]
    assert list(ohlcv(spark, late).values()) == [(100, 105, 98, 98, 3, 3)]
    assert ohlcv(spark, late[::-1] * 2) == ohlcv(spark, late)


def test_negative_price_and_empty(spark):
    assert [v[0] for v in ohlcv(spark, [("S", 1, -1.0, 1.0, T0), ("S", 2, 10.0, 1.0, T0)]).values()] == [10]
    assert ohlcv(spark, []) == {}


def test_conflicts(spark):
    rows = made(spark, [("S", 1, 9.0, 1.0, T0), ("S", 1, 100.0, 1.0, T0), ("S", 2, 1.0, 1.0, T0), ("S", 2, 1.0, 1.0, T0)])
    assert [tuple(r) for r in trades.conflicts(rows).collect()] == [("S", 1, 2)]
    with pytest.raises(Exception, match="conflicting trade S 1"):
        trades.fail_on_conflict(rows).collect()
    assert trades.fail_on_conflict(rows.where("trade_id = 2")).count() == 1


BAD = [
    {"price": "NaN"}, {"price": "Infinity"}, {"price": "-1"}, {"price": True}, {"quantity": "-Infinity"}, {"quantity": 0}, {"symbol": None}, {"symbol": "BTC USDT"}, {"symbol": "BTC\n"},
    {"price": "1.5d"}, {"price": "1.5f"}, {"price": "0x1p3"}, {"price": ""}, {"price": "."}, {"price": [1]}, {"quantity": "1e"}, {"trade_id": 1.0}, {"trade_id": "1.0"}, {"trade_id": ""}, {"timestamp": 1e12},
    {"symbol": 5}, {"trade_id": True}, {"trade_id": None}, {"trade_id": -1}, {"trade_id": 1.2}, {"trade_id": "1_000"}, {"timestamp": False}, {"timestamp": 0}, {"timestamp": 2**63},
]


def test_contract(spark):
    good = {"symbol": "btcusdt", "trade_id": "7", "price": "1.5", "quantity": 2, "timestamp": T0}
    texts = [json.dumps(good)] + [json.dumps(good | b) for b in BAD] + ["not-json", "{}", "null", "[]", '{"price":"NaN"}', None]
    rows = trades.decode(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string")).orderBy("i").collect()
    assert [r["trade"] is not None for r in rows] == [True] + [False] * (len(texts) - 1)
    assert tuple(rows[0]["trade"]) == ("BTCUSDT", 7, 1.5, 2.0, T0)
    odd = [{"price": " 1.5 "}, {"price": 15e-1}, {"price": "+1.5"}, {"price": ".15E1"}, {"trade_id": " 7"}, {"trade_id": "+7"}, {"trade_id": 7}, {"quantity": "2."}, {"timestamp": str(T0)}]
    kept = trades.decode(spark.createDataFrame([(json.dumps(good | o),) for o in odd], "value string")).collect()
    assert [r["trade"] and tuple(r["trade"]) for r in kept] == [("BTCUSDT", 7, 1.5, 2.0, T0)] * len(odd)


def test_only_one_whole_object_is_a_trade(spark):
    good = json.dumps({"symbol": "BTC", "trade_id": 7, "price": "1.5", "quantity": 2, "timestamp": T0})
    kept = [" " + good + "\n", '{"symbol":"A","n":{"x":1,"x":2},' + good[1:], good[:-1] + ',"_seal":"5"}', good[:-1] + ',"symbol":"btc"}']
    odd = [good + " trailing", good + "] {", good + "," + good, good + '},{"_seal":"1"', good[:-1], good.replace('"', "'"), good.replace('"1.5"', "NaN"), "[" + good + "]", good[:-1] + ',"symbol":5}']
    rows = trades.decode(spark.createDataFrame([(i, t.encode()) for i, t in enumerate(kept + odd)] + [(99, good.encode()[:-1] + b',"x":"\xff"}')], "i int, value binary"))
    got = {r["i"]: r["trade"] and tuple(r["trade"]) for r in rows.collect()}
    assert [got.pop(i) for i in range(len(kept))] == [("BTC", 7, 1.5, 2.0, T0)] * len(kept) and not any(got.values())
    why = [r["reason"] for r in trades.rejects(rows).collect()]
    assert why.count("invalid-trade") == 2 and len(why) == len(odd) + 1  # the array, and the symbol whose last value is a number


def test_envelope_and_rejects(spark):
    inner = {"e": "trade", "t": 123, "s": "BTCUSDT", "p": "112345.12", "q": "0.023", "T": 1757578923123}
    texts = [json.dumps({"stream": "x", "data": inner}), json.dumps(inner), "{}", json.dumps({"data": inner | {"e": "aggTrade"}}), json.dumps(inner | {"p": "-1"}), "no" * 2000]
    beside = [json.dumps({"data": d} | inner) for d in (None, json.dumps(inner), [inner], 5)] + [json.dumps(inner) + "x"]
    assert trades.trades_of(trades.parse_envelope(spark.createDataFrame([(t,) for t in beside], "value string"))).isEmpty()
    last = '{"data":{"e":"x"},"data":{"e":"no",' + json.dumps(inner | {"E": 1, "S": "x"})[1:] + "}"
    assert trades.trades_of(trades.parse_envelope(spark.createDataFrame([(last,)], "value string"))).first()["symbol"] == "BTCUSDT"
    rows = trades.parse_envelope(spark.createDataFrame([(t,) for t in texts], "value string"))
    assert [tuple(r) for r in trades.trades_of(rows).collect()] == [("BTCUSDT", 123, 112345.12, 0.023, 1757578923123)] * 2
    got = [(len(r["raw"]), r["reason"]) for r in trades.rejects(rows).collect()]
    assert sorted(r for _, r in got) == ["invalid-trade"] * 3 + ["non-json"] and max(n for n, _ in got) == 2000


def computed_once(df):
    """How often the optimised plan reads JSON and builds ``value``."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("from_json("), plan.count("reverse(")


def test_an_envelope_is_read_once(spark):
    inner = {"e": "trade", "t": 123, "s": "BTCUSDT", "p": "112345.12", "q": 0.5, "T": 1757578923123}
    texts = spark.createDataFrame([(json.dumps(inner)[::-1],)], "value string").select(F.reverse("value").alias("value"))
    assert computed_once(trades.trades_of(trades.parse_envelope(texts))) == (2, 1)  # the second only where a text can spell data
    spelt = lambda name, value: "{" + f'"{name}":{value},' + json.dumps(inner)[1:]
    cases = {spelt("\\u0064ata", "null"): False, spelt("Data", "null"): True, spelt("n", '{"x":1,"x":2}'): True, spelt("note", '"data \\u0064"'): True, spelt("data", "null") + " ": False, "": False, '{"data":' + json.dumps(inner) + ',"data":null}': False}
    cases |= {json.dumps(inner | odd): False for odd in ({"t": True}, {"t": None}, {"t": [5]}, {"t": 5.0}, {"p": {"x": 1}}, {"s": 7}, {"s": None}, {"e": None}, {"T": "true"})}
    rows = trades.parse_envelope(spark.createDataFrame(list(cases), "string")).collect()
    assert {r["value"]: r["trade"] is not None for r in rows} == cases


def test_a_message_is_read_once(spark):
    good = json.dumps({"symbol": "btc", "trade_id": 7, "price": 1.50, "quantity": "2", "timestamp": T0})
    texts = spark.createDataFrame([(good[::-1],), (None,)], "value string").select(F.reverse("value").alias("value"))
    kept = trades.trades_of(trades.decode(texts))
    assert computed_once(kept) == (1, 1) and [tuple(r) for r in kept.collect()] == [("BTC", 7, 1.5, 2.0, T0)]


def series(spark, closes, start=0, volume=10.0, symbol="S"):
    rows = [(symbol, start + 60 * i, c, c, c, c, volume if not callable(volume) else volume(i), 1) for i, c in closes]
    return spark.createDataFrame(rows, "symbol string, window_start long, open double, high double, low double, close double, volume double, trade_count long")


def changes(spark, closes, now=10**6):
    return {r["window_start"] // 60: r for r in candles.price_changes(series(spark, closes), now).collect()}


def test_price_changes(spark):
    full = [(i, 100.0 + i) for i in range(17)]
    got = changes(spark, full, 16 * 60 + 30)
    assert got[0]["price_change_1"] is None and got[16]["price_change_1"] is None
    assert math.isclose(got[15]["price_change_1"], (115 / 114 - 1) * 100) and math.isclose(got[15]["price_change_5"], (115 / 110 - 1) * 100) and math.isclose(got[15]["price_change_15"], 15)
    holed = changes(spark, [x for x in full if x[0] != 7])
    assert holed[15]["price_change_15"] is None and holed[15]["price_change_5"] is not None
    for bad in (0.0, -1.0, float("nan"), float("inf")):
        assert changes(spark, [(i, bad if i == 12 else c) for i, c in full])[15]["price_change_5"] is None


def test_price_changes_across_blocks(spark):
    edge = candles.BLOCK
    got = changes(spark, [(i, 100.0 + i - edge) for i in range(edge - 20, edge + 3)], 10**7)
    assert math.isclose(got[edge + 1]["price_change_15"], (101 / 86 - 1) * 100) and len(got) == 23


def test_volume_spike(spark):
    def found(volume, n=65, now=None, drop=None):
        s = series(spark, [(i, 1.0) for i in range(n) if i != drop], volume=volume)
        return [r["window_start"] // 60 for r in candles.volume_spikes(s, now or n * 60, lookback=200).collect()]

    assert found(lambda i: 151.0 if i >= 60 else 10.0) == [64]
    assert found(lambda i: 30.0 if i >= 60 else 10.0) == []  # three times is not more than three times
    assert found(lambda i: 10.0) == []
    middle = lambda i: 100.0 if 80 <= i < 85 else 10.0
    assert 84 in found(middle, 125) and 84 not in found(middle, 125, drop=60)


def test_price_spike(spark):
    def found(last, threshold=1.0, closes=None):
        s = series(spark, closes or [*((i, 100.0) for i in range(5)), (5, last)])
        return [r["direction"] for r in candles.price_spikes(s, 360, threshold).collect()]

    assert found(101.0) == ["up"] and found(99.0) == ["down"]
    assert found(100.99) == found(99.01) == found(100.0) == found(101.0, 2) == []
    assert found(0, closes=[(0, 100.0), (1, 100.0), (3, 100.0), (4, 100.0), (5, 101.0)]) == []
    for bad in (0, -1, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            candles.price_spikes(series(spark, [(0, 1.0)]), 60, bad)


def test_spikes_count_minutes_not_rows(spark):
    full = [(i, 100.0) for i in range(5)] + [(5, 101.0)]
    holed = series(spark, [x for x in full if x[0] != 2])
    twice = lambda s: s.unionByName(s)
    spikes = lambda s, threshold=1.0: candles.price_spikes(s, 360, threshold).collect()
    assert spikes(twice(holed)) == [] and len(spikes(twice(series(spark, full)))) == 1
    assert spikes(series(spark, [(i, 100.0) for i in range(6)]), 1e-7) == [] and len(spikes(series(spark, full), 1e-7)) == 1
    with pytest.raises(ValueError):
        candles.price_spikes(holed, 360, 1e-20)
    with pytest.raises(Exception, match="conflicting candles"):
        spikes(series(spark, full).unionByName(series(spark, [(3, 100.5)])))
    assert len(spikes(series(spark, full).unionByName(series(spark, [(3, 100.0)], volume=1.0)))) == 1  # volumes don't matter to prices
    busy = series(spark, [(i, 1.0) for i in range(65)], volume=lambda i: 151.0 if i >= 60 else 10.0)
    assert len(candles.volume_spikes(twice(busy), 65 * 60).collect()) == 1
    assert candles.volume_spikes(twice(busy.where("window_start <> 600")), 65 * 60).count() == 0
    with pytest.raises(Exception, match="conflicting candles"):
        candles.volume_spikes(busy.unionByName(series(spark, [(3, 2.0)])), 65 * 60).collect()
    kept = candles.as_signals(candles.price_spikes(series(spark, full), 360, 1.0), 1.0).first()
    assert json.loads(kept["details"]) == {"baseline_close": 100.0, "close": 101.0, "price_change_5m_pct": 1.0, "direction": "up", "threshold_pct": 1.0}
    kept = candles.as_signals(candles.volume_spikes(busy, 65 * 60)).first()
    assert json.loads(kept["details"]) == {"recent_volume_5m": 755.0, "baseline_5m": 50.0, "ratio": 15.1}


def test_rates(spark):
    rows = [("a", 0.0, 5), ("a", 10.0, 25), ("a", 10.5, 99), ("a", 200000.0, 300), ("b", 5.0, 1)]
    df = spark.createDataFrame(rows, "series string, s double, total long").withColumn("at", F.timestamp_micros((F.col("s") * 1e6).cast("long")))
    got = {(r["series"], r["at"].timestamp()): r["rate"] for r in monitor.rates(df).collect()}
    assert sorted(got.items())[:4] == [(("a", 0.0), None), (("a", 10.0), 2.0), (("a", 10.5), None), (("a", 200000.0), 0.0)] and got["b", 5.0] is None


def files(path):
    return {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_batches_leave_other_days_alone(spark, tmp_path):
    job = ExactCandles(spark, str(tmp_path))
    day = 86_400_000
    send = lambda number, *rows: job.batch(spark.createDataFrame([(message(*r),) for r in rows] + [("no",)], "value string"), number)
    send(0, ("S", 1, 100.0, T0), ("S", 2, 101.0, T0 + 5))
    send(1, ("S", 3, 102.0, T0 + day))
    old = {n: files(tmp_path / n / "data") for n in ("trades", "candles")}
    send(2, ("S", 4, 103.0, T0 + day), ("S", 3, 102.0, T0 + day))
    send(2, ("S", 4, 103.0, T0 + day), ("S", 3, 102.0, T0 + day))  # delivered again
    for name, before in old.items():
        now = files(tmp_path / name / "data")
        assert all(now.get(p) == t for p, t in before.items()) and len(now) > len(before)
        assert all("2025-09-12" in str(p) for p in set(now) - set(before))
    got = {r["window_start"]: (r["close"], r["trade_count"]) for r in job.candles.read().collect()}
    start = T0 // 60000 * 60
    assert got == {start: (101.0, 2), start + 86400: (103.0, 2)} and job.trades.read().count() == 4 and job.rejects.read().count() == 3
    for bad in (("S", 2, 7.0, T0 + 5), ("S", 2, 101.0, T0 + 3 * day)):  # on its own day, and on another one
        with pytest.raises(Exception, match="conflicting trade S 2"):
            send(3, bad)
    job.candles.vacuum()
    assert {r["window_start"]: (r["close"], r["trade_count"]) for r in job.candles.read().collect()} == got
    # a query that has lost its checkpoint counts from 0 again; nothing of it is taken for known
    lost = ExactCandles(spark, str(tmp_path))
    lost.writer = "another"
    lost.batch(spark.createDataFrame([(message("S", 5, 104.0, T0 + day),), (message("S", 1, 100.0, T0),)], "value string"), 0)
    got[start + 86400] = (104.0, 3)
    assert {r["window_start"]: (r["close"], r["trade_count"]) for r in lost.candles.read().collect()} == got and lost.trades.read().count() == 5


def test_bounded_conflicts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(message(*m) for m in [("S", 1, 100.0, T0), ("S", 1, 100.0, T0), ("S", 2, 98.0, T0), ("S", 2, 99.0, T0 + 4)]))
    q = bounded_conflicts(read_trades_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("clashes").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["symbol"], r["trade_id"]) for r in spark.table("clashes").collect()] == [("S", 2)]


def test_replay_into_stores(spark, tmp_path):
    trade = {"symbol": "S", "trade_id": 1, "price": 2, "quantity": 1, "timestamp": T0}
    candle = {"symbol": "S", "window_start": 60, "open": 1.0, "high": 1.0, "low": 1.0, "close": 1.0, "volume": 1, "trade_count": 1, "updated_at": "2024-01-02T00:00:00Z"}
    older = candle | {"close": 9.0, "updated_at": "2024-01-01T00:00:00Z"}
    (tmp_path / "r").mkdir()
    for n, record in enumerate([("trade", trade), ("candle", candle), ("candle", older), ("trade", trade | {"price": -1})]):
        (tmp_path / "r" / f"{n}.txt").write_text(json.dumps({"kind": record[0], "payload": record[1]}))
    sent = []
    handlers = replay_handlers(spark, str(tmp_path / "candles"), lambda rows: sent.extend(tuple(r) for r in rows.collect()))
    for name in "ab":  # the second checkpoint replays everything again
        recovery.replay(spark, str(tmp_path / "r"), str(tmp_path / name), handlers)
    assert [k for k, _ in sent] == ["S", "S"] and json.loads(sent[0][1])["price"] == 2.0
    stored = upsert_candles(spark, str(tmp_path / "candles"), spark.createDataFrame([], CANDLE), "none") and Store(spark, str(tmp_path / "candles"), CANDLE).read().collect()
    assert [(r["window_start"], r["close"]) for r in stored] == [(60, 1.0)]


def message(symbol, i, price, ms, quantity=1.0):
    return json.dumps({"symbol": symbol, "trade_id": i, "price": price, "quantity": quantity, "timestamp": ms})


def test_exact_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    batches = [[("S", 1, 100.0, T0 + 5), ("S", 2, 105.0, T0 + 10)], [("R", 1, 5.0, T0 + 2)], [("S", 3, 90.0, T0 + 30), ("S", 2, 105.0, T0 + 10)]]
    job = None
    for n, rows in enumerate(batches):  # a query per batch: each resumes from the checkpoint
        (src / f"{n}.txt").write_text("\n".join([*(message(*r) for r in rows), "not json"]))
        job = ExactCandles(spark, str(tmp_path / "out"))
        job.start(read_trades_stream(spark, str(src)), once=True).awaitTermination()
    flat = [(s, i, p, 1.0, t) for b in batches for s, i, p, t in b]
    got = {(r["symbol"], r["window_start"]): (r["open"], r["high"], r["low"], r["close"], float(r["volume"]), r["trade_count"]) for r in job.candles.read().collect()}
    assert got == ohlcv(spark, flat)
    (src / "bad.txt").write_text(message("S", 3, 91.0, T0 + 30))
    with pytest.raises(Exception, match="conflicting trade"):
        ExactCandles(spark, str(tmp_path / "out")).start(read_trades_stream(spark, str(src)), once=True).awaitTermination()


def test_bounded_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join([message("S", 1, 100.0, T0), message("S", 1, 100.0, T0), message("S", 2, 98.0, T0 + 4000), "x"]))
    stream = bounded_candles(read_trades_stream(spark, str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("bounded").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    r = spark.table("bounded").orderBy(F.desc("trade_count")).first()
    assert (r["open"], r["low"], r["close"], r["trade_count"]) == (100, 98, 98, 2)


def test_live_counters(spark, tmp_path):
    from types import SimpleNamespace as N

    (tmp_path / "in").mkdir()
    counters = LiveCounters()
    spark.streams.addListener(counters)
    try:
        job = ExactCandles(spark, str(tmp_path / "out"), counters=counters)
        for n, rows in enumerate([[("S", 1, 100.0, T0), ("R", 2, 101.0, T0 + 5)], [("S", 3, 102.0, T0 + 60_000)]]):
            (tmp_path / "in" / f"{n}.txt").write_text("\n".join([*(message(*r) for r in rows), "not json"]))
            job.start(read_trades_stream(spark, str(tmp_path / "in")), once=True).awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    finally:
        spark.streams.removeListener(counters)
    got = {(r["section"], r["metric"]): r["value"] for r in counters.rows(spark).collect()}
    stored = monitor.stream_counters(job.trades.read(), job.candles.read()).first()
    assert got["feed", "trades_total"] == stored["events_total"] == 3 and got["feed", "last_event"] == stored["last_event"] and got["feed", "events_total"] == 5 and got["feed", "invalid_total"] == job.rejects.read().count() == 2
    assert got["feed", "events_lost"] == 0 and got["feed", "max_latency_S"] > got["feed", "last_latency_S"] > 0 and ("broker", "lag_total") not in got
    counters.batch("q", 0, {"events": 1, "trades": 1, "last_event": 5}, [("S", 0)], now=100.0)
    counters.batch("q", 0, {"events": 1, "trades": 1, "last_event": 5}, [("S", 0)], now=100.0)
    assert counters.events == 6 and counters.latency["S"][0] == 40.0
    source = N(latestOffset='{"t":{"0":10,"1":7}}', endOffset='{"t":{"0":8,"1":7}}')
    counters.onQueryProgress(N(progress=N(id="k", sources=[source, N(latestOffset=None, endOffset='{"logOffset":3}')], numInputRows=1)))
    counters.onQueryTerminated(N(exception="lost"))
    rows = counters.rows(spark)
    assert {(r["metric"], r["value"]) for r in rows.where("section in ('broker', 'runs')").collect()} == {("lag_total", 2.0), ("log_end_total", 17.0), ("failed_runs", 1.0)}
    assert ("failed_runs", "beyond threshold") in {tuple(r) for r in monitor.alerts(rows, monitor.rules(spark)).collect()}


def test_resume_by_record(spark, tmp_path):
    (tmp_path / "r").mkdir()
    trade = lambda i: json.dumps({"kind": "trade", "payload": {"symbol": "S", "trade_id": i, "price": 2, "quantity": 1, "timestamp": T0}})
    whole = [trade(0), "junk", trade(1), trade(2), trade(3)]
    (tmp_path / "r" / "a.jsonl").write_text("\n".join(whole) + "\n")
    (tmp_path / "r" / "b.jsonl").write_text(trade(4) + "\n" + trade(5)[:20])
    calls, broken = [], {2, 4}

    def handle(rows):
        for r in rows.collect():
            i = json.loads(r["payload"])["trade_id"]
            calls.append(i)
            if i in broken:
                broken.discard(i)
                raise OSError("down")

    run = lambda: recovery.resume(spark, str(tmp_path / "r"), str(tmp_path / "p"), {"trade": handle}, every=1)
    for _ in range(2):
        with pytest.raises(OSError):
            run()
    assert calls == [0, 1, 2, 2, 3, 4]
    assert run() == 1 and run() == 0
    (tmp_path / "r" / "b.jsonl").write_text(trade(4) + "\n" + trade(5) + "\n")
    assert run() == 1 and calls == [0, 1, 2, 2, 3, 4, 4, 5] and run() == 0
    (tmp_path / "big").mkdir()
    (tmp_path / "big" / "x.jsonl").write_text("".join(f"{i}\n" for i in range(4000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert recovery.numbered(spark, str(tmp_path / "big")).where("record <> cast(value as long) or last <> 3999").isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_lookback_reads_only_its_days(spark, tmp_path):
    store = candle_store(spark, str(tmp_path))
    rows = spark.createDataFrame([("S", 86400 * d + 60 * m, float(m), float(d)) for d in range(6) for m in (1, 700)], "symbol string, window_start long, close double, volume double")
    full = rows.selectExpr("symbol", "window_start", "close AS open", "close AS high", "close AS low", "close", "cast(volume as decimal(38,12)) AS volume", "1L AS trade_count", "timestamp_seconds(1) AS updated_at")
    store.upsert("a", full, ["symbol", "window_start"])
    store.upsert("b", full.where("window_start > 400000").withColumn("close", F.col("close") + 1), ["symbol", "window_start"])
    got = stored_lookback(store, 5 * 86400 + 3600, 24 * 60, ["symbol", "window_start", "close"])
    assert sorted(tuple(r) for r in got.collect()) == [("S", 4 * 86400 + 42000, 700.0), ("S", 5 * 86400 + 60, 2.0), ("S", 5 * 86400 + 42000, 701.0)]
    assert {f.split("_day=")[1][:10] for f in got.inputFiles()} == {"1970-01-05", "1970-01-06"}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Filter") and "volume" not in plan.split("Relation")[0]  # the scan has the filter and the columns asked for


def test_keyed_candles_equal_batch(spark, tmp_path):
    """Shuffled arrival over several files, redelivery, a restart after each of them; then a conflict over two days."""
    rng = random.Random(5)
    flat = [(s, i, round(rng.uniform(1, 200), 2), T0 + rng.randrange(600_000)) for s in ("R", "S") for i in range(150)]
    flat.append(("S", 9_000, 3.5, T0 + 86_400_000))
    rng.shuffle(flat)
    src = tmp_path / "in"
    src.mkdir()
    for n in range(3):
        part = flat[n::3] + (flat[:40] if n else [])  # delivered before
        (src / f"{n}.txt").write_text("\n".join([*(message(*r) for r in part), "not json"]))
        keyed.start(read_trades_stream(spark, str(src)), str(tmp_path / "out"), once=True).awaitTermination()
    rows = candle_store(spark, str(tmp_path / "out/candles")).read().collect()
    got = {(r["symbol"], r["window_start"]): (r["open"], r["high"], r["low"], r["close"], float(r["volume"]), r["trade_count"]) for r in rows}
    assert len(got) == len(rows) and got == ohlcv(spark, [(s, i, p, 1.0, t) for s, i, p, t in flat])
    assert spark.conf.get("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "none") == "none"  # the session's own settings are back
    s, i, p, t = next(r for r in flat if r[0] == "S")
    (src / "bad.txt").write_text(message(s, i, p, t + 86_400_000))
    with pytest.raises(Exception, match="conflicting trade"):
        keyed.start(read_trades_stream(spark, str(src)), str(tmp_path / "out"), once=True).awaitTermination()
