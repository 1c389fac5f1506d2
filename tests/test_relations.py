import json
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from candlewick import session
from candlewick.functions import expressions as x
from candlewick.functions import vocabulary
from candlewick.functions.text import clean_text_full
from candlewick.operators import merge, monitor, quality, ranges
from candlewick.operators.correlate import near_moves
from candlewick.sources import adapters, recovery
from candlewick.sources.stores import Store, coin_list, feed_entries, history_pages
from candlewick.streaming.candles import with_recovery


def one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v"))).first()[0]


def test_text(spark):
    clean = "<div>Rain  <i>stops</i>\n&amp; sun returns</div>"
    assert one(spark, x.clean_text, clean) == one(spark, clean_text_full, clean) == "Rain stops & sun returns"
    assert one(spark, clean_text_full, "&Uuml;ber&nbsp;&#66;&hellip;") == "Über B…" and one(spark, clean_text_full, None) is None
    url = lambda u: one(spark, x.normalized_url, u)
    assert url("https://site.example/a/b/?page=2#top") == "https://site.example/a/b"
    assert url(" https://a.b/x/ ") == "https://a.b/x" and url("https://a.b") == "https://a.b/" and url(None) is None
    when = lambda t: one(spark, lambda c: x.parsed_published(c).cast("timestamp_ntz"), t)
    assert when("Mon, 02 Sep 2024 10:00:00 +0200") == datetime(2024, 9, 2, 8) == when("2024-09-02T08:00:00Z") == when("2 Sep 2024 08:00:00 GMT")
    assert when("2024-09-02 08:00:00") == datetime(2024, 9, 2, 8) and when("soon") is None and when(None) is None
    for odd, want in [("\n https://a.b/c/ \n", "https://a.b/c"), ("https://a.b/c\nd", "https://a.b/cd"), ("HTTP://A.b/C/?x#y", "http://A.b/C"), ("x?y\nz", "x"), ("\u00a0https://a.b/\u2003", "https://a.b/"), ("mailto:x@y", "mailto:x@y"), ("//h/p/", "//h/p"), ("", "/")]:
        assert url(odd) == want
    assert [one(spark, x.blank, t) for t in ("\n\t\u00a0 ", "", None, " a")] == [True, True, True, False]
    assert one(spark, x.sanitized_feed, "<a><content:encoded/><content:encoded>b</content:encoded></a>") == "<a><content:encoded>b</content:encoded></a>"


def test_entities_cut_off_before_their_semicolon(spark, tmp_path):
    import duckdb

    from __spark_entry__ import oracle_sql, queries

    cut = "ver&amp p &am; &ampx; &amp;lt; &middot;"
    assert one(spark, clean_text_full, cut) == "ver& p &am; &x; &lt; ·"
    assert one(spark, lambda c: clean_text_full(c, closed=True), cut) == "ver&amp p &am; &ampx; &lt; ·"
    pages = spark.createDataFrame([(1, f"<b>{cut}</b>"), (2, None), (3, "&am")], "page_id long, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    sql = oracle_sql()["clean_text_full"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = [tuple(r) for r in queries()["clean_text_full"](spark, str(tmp_path)).orderBy("page_id").collect()]
    assert got == duckdb.sql(sql).order("page_id").fetchall()


def test_dates(spark):
    d = lambda *t: datetime(2024, 9, 2, *t)
    forms = {
        "2024-09-02T08:00:00Z": d(8), "2024-09-02 08:00": d(8), "2024-09-02": d(), "2024-09": datetime(2024, 9, 1), "20240902": d(), "20240902T080000": d(8), "20240902T080000.5+0200": d(6, 0, 0, 500000),
        "2024-09-02T08:00:00,25Z": d(8, 0, 0, 250000), "2024-09-02T08": d(8), "2024-W36-1": d(), "2024W361T08": d(8), "2024-W36": d(), "2024-246": d(), "2024246T0800": d(8), "2020-W53-7": datetime(2021, 1, 3), "2024-366": datetime(2024, 12, 31),
        "2024-09-01T24:00:00Z": d(), "2024-09-02T08:00:00-05": d(13), "Mon, 02 Sep 2024 10:00:00 +0200": d(8), "2 Sep 24 08:00 GMT": d(8), "Mon, 2 Sep 2024 08:00": d(8), "2 Sep 95 08:00 EST": datetime(1995, 9, 2, 13),
        "Monday, 02-Sep-24 08:00:00 UTC": d(8), "Sep 2, 2024 8:00 PM": d(20), "Sep 2, 2024 12:05 am": d(0, 5), "September 2, 2024": d(), "Mon Sep  2 08:00:00 2024": d(8), "Mon Sep  2 08:00:00 GMT 2024": d(8), "2024/9/2 08:00": d(8),
        "2 September 2024": d(), "Mon, 02 Sep 2024 10:00:00 GMT (London)": d(10), "Mon, 02 Sep 2024 08:00:00 PDT": d(15), "Mon, 02 Sep 2024 08:00:00 XYZ": d(8), "\n2024-09-02T08:00:00.123456789+05:30\t": d(2, 30, 0, 123456),
        "2024-02-30": None, "2024-13-01": None, "2023-366": None, "2021-W53-1": None, "2024-09-02T25:00": None, "2024-09-02T08:00:60Z": None, "31 Apr 2024": None, "13:00 PM": None, "yesterday": None, "": None,
    }
    got = spark.createDataFrame(list(enumerate(forms)), "i int, v string").select("i", x.parsed_published(F.col("v")).cast("timestamp_ntz").alias("at")).orderBy("i").collect()
    assert {text: r["at"] for text, r in zip(forms, got, strict=True)} == forms


def test_symbols_and_sentiment(spark):
    tag = lambda t: one(spark, lambda c: x.symbols_in(x.tokens(c), vocabulary.SYMBOL_KEYWORDS), t)
    assert tag("cardano and TRON beat litecoin, solar is none") == ["ADA", "LTC", "TRX"] and tag("nothing") == []
    mood = lambda t: one(spark, lambda c: x.sentiment_of(x.tokens(c), vocabulary.POSITIVE, vocabulary.NEGATIVE), t)
    assert [mood(t) for t in ("a rebound after growth", "fraud, then losses", "gains and decline", "")] == ["positive", "negative", "neutral", "neutral"]


def test_market_rules(spark):
    rows = [("BTC", 1.0, None), ("", 1.0, None), ("A", None, None), ("A", float("nan"), None), ("A", 0.0, None), ("A", 1.0, float("inf")), ("A", 1.0, 0.0)]
    got = spark.createDataFrame(rows, "s string, p double, m double").select(quality.market_error(F.col("s"), F.col("p"), F.col("m"))).collect()
    assert [r[0] for r in got] == [None, "missing symbol", "missing price", "non-finite price", "price <= 0 (0.0)", "non-finite market_cap", "market_cap <= 0 (0.0)"]


def test_candle_rules(spark):
    kind = "symbol string, window_start long, open double, high double, low double, close double, volume double, trade_count long"
    base = ("S", 0, 100.0, 110.0, 90.0, 105.0, 5.0, 10)
    put = lambda **k: tuple(k.get(n.split()[0], v) for n, v in zip(kind.split(", "), base, strict=True))
    rules = lambda row: sorted(r["rule"] for r in quality.candle_violations(spark.createDataFrame([row], kind)).collect())
    assert rules(base) == [] and rules(put(high=80.0)) == ["high_low", "high_open_close"]
    assert rules(put(volume=-1.0, trade_count=0)) == ["count", "volume"] and rules(put(open=None, volume=-1.0)) == ["missing_field"]
    assert rules(put(high=float("nan"))) == ["high_low", "high_open_close"]


def test_checks(spark):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    at = lambda *ts: spark.createDataFrame([(t,) for t in ts], "t string").select(F.col("t").try_cast("timestamp").alias("t"))
    fresh = lambda *ts: quality.check_freshness(at(*ts), "t", 1440, now).first()["passed"]
    assert fresh("2024-01-01 23:00:00", None) and not fresh("2023-12-31 18:00:00") and not fresh(None) and not fresh()
    keys = spark.createDataFrame([("a",), ("a",), (None,), (None,)], "u string")
    r = quality.check_duplicates(keys, "u").first()
    assert not r["passed"] and r["metrics"]["duplicates"] == 2
    assert quality.check_duplicates(keys.limit(0), "u").first()["passed"]
    assert not quality.check_nulls(spark.createDataFrame([("",)], "u string"), ["u"]).first()["passed"]
    assert [quality.check_row_count(spark.range(n), 1, 1000).first()["passed"] for n in (50, 0, 5000)] == [True, False, False]


def test_merge(spark):
    kind = "k int, v int, updated_at timestamp"
    t = [datetime(2024, 1, d) for d in (1, 2, 3)]
    stored = spark.createDataFrame([(1, 10, t[1]), (2, 20, t[1]), (3, 30, None)], kind)
    new = spark.createDataFrame([(1, 11, t[0]), (2, 21, t[1]), (3, 31, t[0]), (4, 40, t[2]), (4, 41, t[0])], kind)
    assert sorted((r["k"], r["v"]) for r in merge.upsert_versioned(stored, new, ["k"]).collect()) == [(1, 10), (2, 21), (3, 31), (4, 40)]
    got = merge.insert_absent(stored, spark.createDataFrame([(1, 1, t[0]), (9, 2, t[0]), (9, 1, t[0])], kind), ["k"], F.col("v")).collect()
    assert [(r["k"], r["v"]) for r in got] == [(9, 1)]
    assert merge.table_name("news", "prod") == "news" and merge.table_name("news", "local") == "news_local"


def test_shared_folder_must_be_named_on_a_cluster():
    class Context:
        master = "spark://a:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), "k int, v int, updated_at timestamp").create()
    rows = spark.createDataFrame([(1, 10, datetime(2024, 1, 2))], "k int, v int, updated_at timestamp")
    assert s.upsert("a", rows, ["k"]) and not s.upsert("a", rows, ["k"])
    assert s.create().upsert("b", rows.withColumn("v", F.lit(9)).withColumn("updated_at", F.lit("2024-01-01").cast("timestamp")), ["k"])
    assert [tuple(r)[:2] for r in s.read().collect()] == [(1, 10)]
    wider = Store(spark, str(tmp_path / "s"), "k int, v int, updated_at timestamp, extra string, more string", defaults={"more": "'new'"})
    assert tuple(wider.read().first())[3:] == (None, "new")
    more = Store(spark, str(tmp_path / "t"), "k int, v int", "cast(v div 10 as string)").create()
    more.FAN = 3
    for i in range(5):
        assert more.insert_absent(f"b{i}", spark.createDataFrame([(i, 1), (0, 11 + i), (9, None)], "k int, v int"), ["k"], F.col("v"))
    assert sorted(((r["k"], r["v"]) for r in more.read().collect()), key=str) == [(0, 1), (1, 1), (2, 1), (3, 1), (4, 1), (9, None)]
    assert len(more.pieces(["0"])) <= 3 and sorted(r["k"] for r in more.read(["none"]).collect()) == [9]


def test_lookup_names_the_pieces_that_may_hold_an_id(spark, tmp_path):
    kind = "symbol string, id long, at long"
    s = Store(spark, str(tmp_path), kind, "cast(at as string)", lookup=["symbol", "id"]).create()
    s.FAN = 3
    rows = lambda *r: spark.createDataFrame(list(r), kind)
    for day in range(5):
        s.append(f"d{day}", rows(*[("A", 100 * day + i, day) for i in range(60)], *[("B", 100 * day + i + 7, day) for i in range(60)]))
    s.append("late", rows(("A", 5000, 1), ("A", -3, 1)))  # a piece whose ids span all others
    days = lambda *r: [p.rpartition("=")[2] for p in s.holding(rows(*r))]
    assert days(("A", 305, 9)) == ["3"] and sorted(days(("A", 105, 9), ("B", 420, 9))) == ["1", "4"] and days(("A", 5000, 0)) == ["1"] and days(("C", 9999, 0)) == [] and days(("A", 80, 0)) == [] and s.holding(rows()) == []
    s.append("more", rows(("A", 7000, 1)))  # merges the pieces of day 1
    assert len(s.pieces(["1"])) == 1 and days(("A", 7000, 0)) == days(("A", 105, 0)) == days(("A", -3, 0)) == ["1"]
    assert sum(len(s.holding(rows(("X", i, 0)))) for i in range(0, 400, 40)) <= 2
    files = s.read_pieces(s.holding(rows(("A", 305, 9)))).inputFiles()
    assert files and all("_day=3" in f for f in files)


class Fake(Store):
    """A store whose pieces are only names: a piece's rows are counted, not written."""

    FAN = 4
    rewritten = 0

    def __init__(self, spark, path):
        super().__init__(spark, path, "k int, v int")
        self.rows = {}

    def days_of(self, rows):
        return ["d"]

    def _rows(self, pieces):
        self.rewritten += sum(self.rows[p] for p in pieces)
        return FakeRows(sum(self.rows[p] for p in pieces))

    def _write(self, rows, days, level):
        name = f"data/{len(self.rows)}"
        self.rows[name] = rows.n
        return [(name, "d", level)]


class FakeRows:
    columns = ["k", "v"]

    def __init__(self, n):
        self.n = n

    def select(self, *_):
        return self

    def coalesce(self, _):
        return self


def test_cost_of_a_batch_does_not_grow(spark, tmp_path):
    s = Fake(spark, str(tmp_path)).create()
    s.log.EVERY = 16
    reads, listed = [], []
    for i in range(500):
        s.log.seen, before = {}, s.log.reads  # as if each batch were a new process
        assert s.append(("q", i) if i % 2 else f"one-{i}", FakeRows(1))
        reads.append(s.log.reads - before)
        listed.append(len(s.log.names()))
    assert max(reads[400:]) <= max(reads[40:140]) + 2 and max(reads) < 3 * 16 and max(listed[400:]) <= max(listed[40:140]) + 2
    state = s.log.state()
    assert sum(s.rows[p] for p in state["pieces"]) == 500 and len(state["pieces"]) <= 3 * 5 and s.rewritten <= 500 * 5 and state["marks"] == {"q": 499}
    assert not s.append("one-0", FakeRows(1)) and not s.append("one-498", FakeRows(1)) and not s.append(("q", 7), FakeRows(1)) and s.append(("other", 7), FakeRows(1))


@pytest.mark.parametrize("keyed", [False, True])
def test_a_crash_leaves_either_state(spark, tmp_path, keyed, monkeypatch):
    shape = "k int, v int, updated_at timestamp"
    s = Store(spark, str(tmp_path), shape, keys=["k"] if keyed else None).create()
    s.FAN, s.log.EVERY = 2, 2
    at = datetime(2024, 1, 1)
    batch = lambda i: spark.createDataFrame([(1, i, at), (i + 10, i, at)], shape)
    want = lambda n: sorted(({1: n, **{i + 10: i for i in range(n + 1)}}).items()) if keyed else sorted([(1, i) for i in range(n + 1)] + [(i + 10, i) for i in range(n + 1)])
    got = lambda: sorted((r["k"], r["v"]) for r in s.read().collect())
    assert s.append(("q", 0), batch(0))
    save, delete = type(s.log).save, type(s.log).delete
    for i, (name, late) in enumerate([("entry", False), ("entry", True), ("snapshot", False), ("snapshot", True), ("delete", False)], 1):
        # the process ends before or after a file is in place, at its first entry (the batch), second (a merge), snapshot or deletion
        with monkeypatch.context() as m:
            def broken(self, *args, name=name, late=late):
                wrong = name == "delete" or args[0].startswith(name)
                if late or not wrong:
                    (delete if name == "delete" else save)(self, *args)
                if wrong:
                    raise OSError("lost")
            m.setattr(type(s.log), "delete" if name == "delete" else "save", broken)
            try:
                s.append(("q", i), batch(i))
            except OSError:
                pass
        s = Store(spark, str(tmp_path), shape, keys=["k"] if keyed else None).create()
        s.FAN, s.log.EVERY = 2, 2
        assert got() in (want(i - 1), want(i))
        s.append(("q", i), batch(i))
        assert got() == want(i) and not s.append(("q", i), batch(i))
    s.vacuum()
    assert got() == want(5)


def test_coins(spark):
    good = {"symbol": "btc", "name": "B", "current_price": 1, "market_cap": None}
    items = [good, good | {"name": 5}, {k: v for k, v in good.items() if k != "name"}, good | {"current_price": "1"}, good | {"current_price": True}, {"symbol": "x", "name": "y"}, good | {"total_volume": "9"}, [good], {"name": "n", "current_price": 2.5}, good | {"symbol": None}]
    rows = quality.coins_of(spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(items)] + [(10, "{"), (11, None)], "i int, value string").orderBy("i")).collect()
    told = ["schema: expected a text - at name", "schema: expected a number - at price", "schema: expected a number or null - at volume_24h", "schema: expected an object"]
    assert [r["error"] for r in rows] == [None, told[0], None, told[1], told[1], told[1], told[2], told[3], None, None, told[3], told[3]]
    assert (rows[0]["symbol"], rows[0]["price"], rows[2]["name"], rows[8]["symbol"], rows[9]["symbol"], json.loads(rows[3]["payload"])) == ("BTC", 1.0, "", "", "NONE", items[3])


def test_correlation(spark):
    moves = spark.createDataFrame([("BTC", 1060, 3.0), ("ETH", 1060, 0.5), ("DOT", 1060, -2.0), ("ADA", 1660, 9.0), ("ADA", 1661, 9.0)], "symbol string, window_start long, change double")
    news = spark.createDataFrame([("a", 1060), ("old", 1), ("none", None)], "title string, s long").withColumn("published_at", F.timestamp_seconds("s"))
    joined = near_moves(news, moves, "change")
    assert sorted((r["title"], r["symbol"], r["window_start"]) for r in joined.collect()) == [("a", "ADA", 1660), ("a", "BTC", 1060), ("a", "DOT", 1060)]
    assert "NestedLoop" not in joined._jdf.queryExecution().toString() and "Cartesian" not in joined._jdf.queryExecution().toString()


def closed(spark, rows):
    return spark.createDataFrame(rows, "symbol string, start long, `end` long")


def listed(df):
    return sorted((r["symbol"], r["start"], r["end"]) for r in df.collect())


def test_ranges(spark):
    arrived = spark.createDataFrame([("S", 10, 0), ("S", 14, 1), ("S", 20, 2), ("S", 18, 3)], "symbol string, trade_id long, at long")
    assert listed(ranges.arrival_gaps(arrived, "at")) == [("S", 11, 13), ("S", 15, 19)]
    assert listed(ranges.id_gaps(arrived)) == [("S", 11, 13), ("S", 15, 17), ("S", 19, 19)]
    failed = closed(spark, [("S", i, i) for i in (11, 13, 12, 11, 20)])
    assert listed(ranges.merged(failed)) == [("S", 11, 13), ("S", 20, 20)]
    assert listed(ranges.subtracted(failed, closed(spark, [("S", 12, 12)]))) == [("S", 11, 11), ("S", 13, 13), ("S", 20, 20)]
    plan = ranges.fetch_plan(closed(spark, [("A", 1, 2500), ("B", 5, 5)])).orderBy("round", "symbol").collect()
    assert [tuple(r) for r in plan] == [(1, "A", 1, 1000), (1, "B", 5, 1), (2, "A", 1001, 1000), (3, "A", 2001, 500)]
    far = ranges.page_chunks(closed(spark, [("A", 10, 3 * 10**12 + 9), ("A", 4 * 10**12, 4 * 10**12), ("B", 0, 2**62)]).where("symbol = 'A'"))
    assert far.agg(F.sum("k"), F.max("k"), F.count("*")).first()[:] == (3 * 10**9 + 1, ranges.FAN, 732423)
    assert tuple(far.orderBy(F.desc("place")).first()) == ("A", 4 * 10**12, 4 * 10**12, 4 * 10**12, 3 * 10**9, 1)
    pages = spark.createDataFrame([(0, 1), (0, 2), (1, 5), (1, 7), (2, 9), (2, 9)], "page long, id long")
    assert {r["page"]: r["contiguous"] for r in ranges.contiguous_pages(pages).collect()} == {0: True, 1: False, 2: False}


def test_ranges_are_read_once_and_run_across_blocks(spark):
    a, b = closed(spark, [("S", 5, 5 * ranges.SPAN), ("S", 2**63 - 9, 2**63 - 1), ("T", 7, 3)]), closed(spark, [("S", ranges.SPAN - 1, ranges.SPAN + 3), ("T", 0, 9)])
    assert listed(ranges.subtracted(a, b)) == [("S", 5, ranges.SPAN - 2), ("S", ranges.SPAN + 4, 5 * ranges.SPAN), ("S", 2**63 - 9, 2**63 - 1)]
    assert listed(ranges.merged(a.where("symbol = 'S'").unionByName(b.where("symbol = 'S'")))) == [("S", 5, 5 * ranges.SPAN), ("S", 2**63 - 9, 2**63 - 1)]
    plan = ranges.subtracted(a, b)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") <= 4  # each kind once for the events, once for the blocks' sums


def test_a_quantity_is_read_once(spark):
    plan = adapters.trades(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get_json_object(") == 1


pairs = st.lists(st.tuples(st.integers(0, 60), st.integers(0, 6)), max_size=12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=pairs, b=pairs)
def test_ranges_behave_as_sets(spark, a, b):
    flat = lambda rows: {i for s, n in rows for i in range(s, s + n + 1)}
    rows = lambda p: closed(spark, [("S", s, s + n) for s, n in p])
    got = listed(ranges.subtracted(rows(a), rows(b)))
    assert {i for _, s, e in got for i in range(s, e + 1)} == flat(a) - flat(b)
    assert all(x[2] + 1 < y[1] for x, y in zip(got, got[1:], strict=False))


def test_monitor(spark):
    green = {"db": {"newest_candle_age_min": 1, "candles_10m": 50, "news_1h": 5}, "runs": {"failed_runs": 0}, "feed": {"events_lost": 0, "publish_failures_total": 0, "dlq_write_failures_total": 0}, "broker": {"lag_total": 3}}

    def found(overrides=None, **sections):
        both = green | sections
        rows = [(s, m, float(v)) for s, ms in both.items() if ms is not None for m, v in ms.items()]
        return sorted(tuple(r) for r in monitor.alerts(spark.createDataFrame(rows, "section string, metric string, value double"), monitor.rules(spark, overrides)).collect())

    assert found() == []
    assert found(db={"error": 1}) == [("db", "unreachable")]
    assert found(broker={"error": 1}) == [("broker", "unavailable")] == found(broker=None)
    assert found(feed=green["feed"] | {"events_lost": -1}) == [("events_lost", "beyond threshold")]
    assert found({"ALERT_MAX_CONSUMER_LAG": "nan"}) == [("lag_total", "invalid threshold")] and found({"ALERT_MAX_CONSUMER_LAG": "2"}) == [("lag_total", "beyond threshold")]
    assert found(backfill={"pending_trades": 2, "checkpoint_failures_total": 0}) == [("pending_trades", "pending")]
    assert len(found(runs={"failed_runs": 2}, broker={"lag_total": 99999}, db={"newest_candle_age_min": 99, "candles_10m": 5, "news_1h": 0})) == 5
    assert tuple(monitor.lag(spark.createDataFrame([], "log_end long, current long")).first()) == (None, None)


def test_recovery(spark, tmp_path):
    ok = {"symbol": "S", "trade_id": 1, "price": 1, "quantity": 1, "timestamp": 5}
    lines = [{"kind": "trade", "payload": ok}, {"kind": "candle", "payload": {"symbol": "S"}}, {"kind": "candle", "payload": {"symbol": "S", "updated_at": "2024-01-01"}}, {"kind": "x", "payload": {}}, {"kind": "trade", "payload": []}]
    src = tmp_path / "r"
    src.mkdir()
    (src / "a.txt").write_text("\n".join([*map(json.dumps, lines), '{"kind":"tra']))
    assert recovery.dry_run(spark, str(src)) == {"ok": 2, "candle without updated_at": 1, "unknown kind": 1, "payload is no object": 1, "not json": 1}
    seen = []
    for _ in range(2):
        recovery.replay(spark, str(src), str(tmp_path / "c"), {"trade": lambda d: seen.extend(r[0] for r in d.collect()), "candle": lambda d: None})
    assert len(seen) == 1

    def fails(rows, number):
        raise RuntimeError("down")

    try:
        with_recovery(fails, str(tmp_path / "dead"), "candle")(spark.range(2), 0)
        raise AssertionError
    except RuntimeError:
        assert spark.read.json(str(tmp_path / "dead")).count() == 2


def test_landed_files(spark, tmp_path):
    (tmp_path / "coins.json").write_text(json.dumps([{"symbol": "btc", "name": "B", "current_price": 1.0, "market_cap": 5.0}, {"symbol": "x", "name": "X", "current_price": 1.0, "market_cap": 9.0}]))
    assert [r["symbol"] for r in quality.map_coins(coin_list(spark, str(tmp_path / "coins.json"))).collect()] == ["X", "BTC"]
    (tmp_path / "page.json").write_text(json.dumps([{"id": 1, "price": "2.5", "qty": "1", "time": 5}]))
    assert history_pages(spark, str(tmp_path / "page.json")).first()["price"] == 2.5
    feed = tmp_path / "feeds"
    feed.mkdir()
    (feed / "one.xml").write_text("<rss><channel><item><title>T</title><link>https://a/b</link><description>D</description><content:encoded/></item></channel></rss>")
    (feed / "two.xml").write_text("down for maintenance")
    (feed / "three.xml").write_text('<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><entry><title>A</title><link rel="alternate" href="https://c/d"/><updated>2024-01-02T00:00:00Z</updated><summary>S</summary></entry></feed>')
    (feed / "four.xml").write_text("<rss><channel><title>empty</title></channel></rss>")
    rows = {r["source"]: r for r in feed_entries(spark, str(feed)).collect()}
    assert tuple(rows["three"]) == ("three", "A", "https://c/d", "2024-01-02T00:00:00Z", "S", None) and "four" not in rows
    assert (rows["one"]["title"], rows["one"]["content"], rows["one"]["error"]) == ("T", "D", None) and rows["two"]["error"] == "no items"
    (feed / "cdata.xml").write_text('<rss><item><title>X</title><media:title>no</media:title><link>https://e/f</link><content:encoded/><description><![CDATA[a </item> <b>b</b>]]></description></item></rss>')
    (feed / "torn.xml").write_text("<rss><channel><item><title>kept</title><link>https://g</link></item><item><title>lost</title><li")
    rows = [tuple(r) for r in feed_entries(spark, str(feed)).where("source in ('cdata', 'torn')").collect()]
    assert sorted(rows, key=str) == sorted([("cdata", "X", "https://e/f", None, "a </item> <b>b</b>", None), ("torn", "kept", "https://g", None, "", None), ("torn", None, None, None, None, "broken markup")], key=str)
