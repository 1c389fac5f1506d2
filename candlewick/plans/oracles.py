"""For each query the SQL, over the same tables, that must give the same rows."""

from __future__ import annotations

from candlewick.functions import vocabulary

NOW = "TIMESTAMP '2024-01-31 00:00:00'"
EVENTS = "e AS (SELECT upper(event_type) AS symbol, event_id AS trade_id, value AS price, CAST(json_extract_string(props, '$.k') AS DECIMAL(30,12)) AS quantity, epoch_us(ts) // 1000 AS ms, ts FROM events)"
VALID = r"regexp_full_match(symbol, '[A-Z0-9]{1,20}') AND trade_id >= 0 AND isfinite(price) AND price > 0 AND quantity > 0 AND ms BETWEEN 1 AND 253402300799999"
TRADES = f"{EVENTS}, v AS (SELECT symbol, trade_id, price, quantity, ms FROM e WHERE {VALID})"


def candles(seconds: int = 3600, source: str = "v", name: str = "c") -> str:
    return (
        f"{name} AS (SELECT symbol, (ms // 1000 // {seconds}) * {seconds} AS ws, arg_min(price, (ms, trade_id)) AS open, max(price) AS high, min(price) AS low, "
        f"arg_max(price, (ms, trade_id)) AS close, sum(quantity) AS volume, count(*) AS trade_count FROM {source} GROUP BY 1, 2)"
    )


AT = "make_timestamp((ws * 1000000)::BIGINT) AS window_start"
CANDLE = f"symbol, {AT}, open, high, low, close, volume::DOUBLE AS volume, trade_count"
HOURLY = f"{TRADES}, {candles()}"
CLOSED = "epoch(TIMESTAMP '2024-01-31 00:00:00')"


MINUTES = f"""{EVENTS}, v AS (SELECT 'ALL' AS symbol, trade_id, price, CASE WHEN m // 300000 % 7 = 0 THEN quantity * 9 + 1 ELSE quantity % 3 + 1 END AS quantity, m AS ms
  FROM (SELECT *, 1706659200::BIGINT * 1000 - 1 - trade_id % 4000 * 2000 AS m FROM e WHERE {VALID})), {candles(60)}"""


def changes(seconds: int = 3600) -> str:
    parts = []
    for n in (1, 5, 15):
        sound = f"count(*) FILTER (close > 0 AND isfinite(close) AND ws % {seconds} = 0) OVER (PARTITION BY symbol ORDER BY ws ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"
        parts.append(f"CASE WHEN ws < {CLOSED} AND ws - lag(ws, {n}) OVER w = {n * seconds} AND {sound} = {n + 1} THEN (close / nullif(lag(close, {n}) OVER w, 0) - 1) * 100 END AS raw_{n}")
    return f"p AS (SELECT symbol, ws, close, {', '.join(parts)} FROM c WINDOW w AS (PARTITION BY symbol ORDER BY ws))"


ROUNDED = ", ".join(f"round(raw_{n}, 6) AS price_change_{n}" for n in (1, 5, 15))
LAG = "q AS (SELECT symbol, ws, close, round((close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ws), 0) - 1) * 100, 4) AS price_change FROM c)"


def spikes(seconds: int, recent: int, baseline: int, threshold: float) -> str:
    back = lambda first, last: f"OVER (PARTITION BY symbol ORDER BY ws RANGE BETWEEN {first * seconds} PRECEDING AND {last})"
    total = recent + baseline
    return f"""vs AS (
  SELECT symbol, 'VOLUME_SPIKE' AS signal_type, ws, late AS recent_volume, round(early, 8) AS baseline, round(late / early, 2) AS ratio
  FROM (SELECT symbol, ws,
               count(*) {back(total - 1, "CURRENT ROW")} AS n,
               (sum(volume) {back(recent - 1, "CURRENT ROW")})::DOUBLE AS late,
               (sum(volume) {back(total - 1, f"{recent * seconds} PRECEDING")})::DOUBLE / {baseline} * {recent} AS early
        FROM c WHERE ws < epoch(TIMESTAMP '2024-01-31 00:00:00') AND volume >= 0)
  WHERE n = {total} AND early > 0 AND late / early > {threshold})"""


def moves(seconds: int, percent: int) -> str:
    return f"""ps AS (
  SELECT symbol, 'PRICE_SPIKE' AS signal_type, ws, base::DOUBLE AS baseline_close, close::DOUBLE AS close,
         round((close::DOUBLE / base::DOUBLE - 1) * 100, 4) AS change_pct, CASE WHEN close > base THEN 'up' ELSE 'down' END AS direction
  FROM (SELECT symbol, ws, close, count(*) OVER f AS n, first_value(close) OVER f AS base
        FROM (SELECT symbol, ws, close::DECIMAL(20,8) AS close FROM c WHERE close > 0 AND ws < epoch(TIMESTAMP '2024-01-31 00:00:00'))
        WINDOW f AS (PARTITION BY symbol ORDER BY ws RANGE BETWEEN {5 * seconds} PRECEDING AND CURRENT ROW))
  WHERE n = 6 AND abs(close - base) * 100 >= {percent} * base)"""


VOLUME, PRICE = spikes(3600, 2, 10, 1.5), moves(3600, 50)
SIGNALS = f"{HOURLY}, {VOLUME}, {PRICE}, s AS (SELECT symbol, signal_type, ws, ratio AS value FROM vs UNION ALL SELECT symbol, signal_type, ws, change_pct FROM ps)"
NEWS = """d AS (
  SELECT doc_id AS position, left(split_part(text, chr(10), 1), 80) AS title, 'https://n.example/' || doc_id || '/?utm=x' AS url, source,
         TIMESTAMP '2024-01-01' + to_minutes((doc_id * 43)::INT) AS published_at, TIMESTAMP '2024-01-01 00:05:00' + to_minutes((doc_id * 43)::INT) AS collected_at, text AS content
  FROM documents),
k AS (SELECT *, list_distinct(regexp_extract_all(lower(concat_ws(' ', title, content)), '[a-z]+')) AS w FROM d),
n AS (
  SELECT position, title, url, source, published_at, collected_at, content,
         list_filter([CASE WHEN list_contains(w, 'de') THEN 'ADA' END, CASE WHEN list_contains(w, 'the') THEN 'BTC' END, CASE WHEN list_contains(w, 'la') THEN 'DOT' END,
                      CASE WHEN list_contains(w, 'etf') THEN 'ETF' END, CASE WHEN list_contains(w, 'of') THEN 'ETH' END, CASE WHEN list_has_any(w, ['der', 'die']) THEN 'LTC' END,
                      CASE WHEN list_contains(w, 'and') THEN 'SOL' END, CASE WHEN list_contains(w, 'que') THEN 'XRP' END], lambda s: s IS NOT NULL) AS symbols,
         len(list_intersect(w, ['is', 'in', 'le', 'que', 'und', 'thing'])) AS up, len(list_intersect(w, ['to', 'by', 'un', 'des', 'von', 'est'])) AS down,
         CASE WHEN up > down THEN 'positive' WHEN down > up THEN 'negative' ELSE 'neutral' END AS sentiment
  FROM k)"""


STRIP = r"[\s\x1C-\x1F\x0B\x85\p{Z}]+"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^{STRIP}|{STRIP}$', '', 'g')"


def norm(url: str) -> str:
    bare = f"regexp_replace(regexp_replace({strip(url)}, '[\\t\\r\\n]', '', 'g'), '(?s)[?#].*$', '')"
    parts = "'^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)?(.*)$'"
    host = f"regexp_extract({bare}, {parts}, 1)"
    return f"lower(regexp_extract({host}, '^[A-Za-z][A-Za-z0-9+.-]*:', 0)) || regexp_replace({host}, '^[A-Za-z][A-Za-z0-9+.-]*:', '') || coalesce(nullif(rtrim(regexp_extract({bare}, {parts}, 2), '/'), ''), '/')"


CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '<[^>]+>', ' ', 'g'), '[\s\x0B\x85\p{Z}]+', ' ', 'g'), '^ | $', '', 'g')"""
INSIDE = r"regexp_replace('</item> </entry> ' || coalesce(html, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F]', ' ', 'g')"
HTML = "replace(replace(html, '&copy;', '©'), '&middot;', '·') || ' é' || chr(160) || 'AB…<i>&amp;lt;©'"
REPEATED = r"""r0 AS (
  SELECT position, title, url, source, published_at FROM n
  UNION ALL SELECT position + 100000000, title, regexp_replace(url, '\?.*', '') || '#later', source, published_at FROM n WHERE position % 4 = 0),
r AS (SELECT position, CASE WHEN position % 41 = 0 THEN '  ' WHEN position % 47 = 0 THEN chr(10) || chr(9) || chr(160) || ' ' ELSE title END AS title,
  CASE WHEN position % 43 = 0 THEN '' WHEN position % 53 = 0 THEN chr(9) || chr(10) WHEN position % 5 = 0 THEN chr(10) || ' ' || url || ' ' || chr(10) WHEN position % 7 = 0 THEN replace(url, 'https', 'HTTPS') ELSE url END AS url, source FROM r0)"""
FULL = f"{strip('title')} <> '' AND {strip('url')} <> ''"
ENTRIES = f"{NEWS}, {REPEATED}, en AS (SELECT * FROM r WHERE {FULL})"
SNAP = "s AS (SELECT o_orderdate AS collected_at, o_custkey::VARCHAR AS symbol, o_orderpriority AS name, o_totalprice AS price, o_totalprice * 10 AS market_cap, (o_orderkey % 1000 + 1)::DOUBLE AS volume_24h, round(o_totalprice % 20 - 10, 4) AS price_change_24h FROM orders)"
LATEST = f"{SNAP}, l AS (SELECT * FROM s WHERE collected_at = (SELECT max(collected_at) FROM s))"
MARKET = """m AS (
  SELECT CASE WHEN c_custkey % 29 = 0 THEN '' ELSE c_custkey::VARCHAR END AS symbol, CASE WHEN c_custkey % 37 <> 0 THEN c_name END AS name,
         CASE WHEN c_custkey % 31 <> 0 THEN c_acctbal END AS price,
         CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 19 = 0 THEN 0.0::DOUBLE ELSE c_acctbal * 100 + 1 END AS market_cap
  FROM customer)"""
RULE = "CASE WHEN symbol IS NULL OR symbol = '' THEN 'missing symbol' WHEN price IS NULL THEN 'missing price' WHEN price <= 0 THEN 'price <= 0 (' || price || ')' WHEN market_cap <= 0 THEN 'market_cap <= 0 (' || market_cap || ')' ELSE 'valid' END"
ODD = """o AS (
  SELECT symbol, ws, CASE WHEN (ws // 3600) % 17 <> 0 THEN open END AS open, CASE WHEN (ws // 3600) % 7 = 0 THEN low - 1 ELSE high END AS high, low, close,
         CASE WHEN (ws // 3600) % 11 = 0 THEN -volume ELSE volume END AS volume, CASE WHEN (ws // 3600) % 13 = 0 THEN 0 ELSE trade_count END AS trade_count
  FROM c),
x0 AS (SELECT symbol, ws, unnest(CASE WHEN open IS NULL THEN ['missing_field: missing open'] ELSE list_filter([
        CASE WHEN high < low THEN 'high_low: high=' || high || ' < low=' || low END,
        CASE WHEN high < open OR high < close THEN 'high_open_close: high=' || high || ' outside [open=' || open || ', close=' || close || ']' END,
        CASE WHEN low > open OR low > close THEN 'low_open_close: low=' || low || ' outside [open=' || open || ', close=' || close || ']' END,
        CASE WHEN volume < 0 THEN 'volume: volume=' || volume::DOUBLE || ' < 0' END, CASE WHEN trade_count <= 0 THEN 'count: trade_count=' || trade_count || ' must be above 0' END], lambda r: r IS NOT NULL) END) AS told FROM o),
x AS (SELECT symbol, ws, split_part(told, ': ', 1) AS rule, split_part(told, ': ', 2) AS detail FROM x0)"""
KEYWORDS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in vocabulary.SYMBOL_KEYWORDS.items()) + "}"
WORDS, POS, NEG = (str(list(x)) for x in ([*vocabulary.SYMBOL_KEYWORDS, "adapter", "links", "solar"], vocabulary.POSITIVE, vocabulary.NEGATIVE))
HEADLINES = f"""hw AS (SELECT o_orderkey, {WORDS} AS ws, {POS} || {NEG} || ['steady'] AS ms FROM orders),
h AS (SELECT o_orderkey, {KEYWORDS} AS d, {POS} AS pos, {NEG} AS neg,
  list_distinct([ws[o_orderkey % len(ws) + 1], ms[o_orderkey * 3 % len(ms) + 1], 'and', ws[o_orderkey * 7 % len(ws) + 1], ms[o_orderkey * 11 % len(ms) + 1]]) AS w FROM hw)"""
GAPPY = f"{TRADES}, g AS (SELECT * FROM v WHERE trade_id % 13 NOT IN (3, 4))"
IDGAPS = f"{GAPPY}, i AS (SELECT symbol, p + 1 AS start, trade_id - 1 AS \"end\" FROM (SELECT symbol, trade_id, lag(trade_id) OVER (PARTITION BY symbol ORDER BY trade_id) AS p FROM g) WHERE trade_id > p + 1)"
ARRIVAL = f"""{GAPPY},
a AS (SELECT symbol, trade_id, CASE WHEN trade_id % 7 = 0 THEN (trade_id + 40) * 2 + 1 ELSE trade_id * 2 END AS arrival FROM g),
j AS (SELECT symbol, p + 1 AS start, trade_id - 1 AS "end" FROM (SELECT symbol, trade_id, max(trade_id) OVER (PARTITION BY symbol ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM a) WHERE trade_id > p + 1)"""
MERGED = f"""{ARRIVAL},
f AS (SELECT * FROM j UNION ALL SELECT symbol, trade_id, trade_id FROM g WHERE trade_id % 17 = 0),
f1 AS (SELECT *, max("end") OVER (PARTITION BY symbol ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM f),
f2 AS (SELECT *, sum(CASE WHEN reached IS NULL OR start > reached + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY start, "end") AS island FROM f1),
mg AS (SELECT symbol, min(start) AS start, max("end") AS "end" FROM f2 GROUP BY symbol, island)"""
STATE = f"CASE WHEN NOT ({VALID}) THEN 'invalid' WHEN trade_id % 101 = 0 THEN 'failed' WHEN trade_id % 103 = 0 THEN 'pending' WHEN trade_id % 107 <> 0 THEN 'acknowledged' END"


def metric(**values: str) -> str:
    """name=value pairs in order of the names, one decimal."""
    return " || ',' || ".join(f"'{k}=' || coalesce(round(({v})::DOUBLE, 1)::DECIMAL(30,1)::VARCHAR, 'null')" for k, v in sorted(values.items()))


FRESH = f"SELECT 'freshness' AS \"check\", coalesce(age <= 1440, false) AS passed, {metric(age_minutes='age', dated='dated', records='records')} AS metrics FROM (SELECT round(epoch({NOW} - max(published_at)) / 60, 1) AS age, count(*) AS records, count(published_at) AS dated FROM n)"


def duplicates(source: str, key: str) -> str:
    return f"SELECT 'duplicates' AS \"check\", dup = 0 AS passed, {metric(duplicates='dup', records='records')} AS metrics FROM (SELECT sum(c - 1) AS dup, sum(c) AS records FROM (SELECT count(*) AS c FROM {source} GROUP BY {key}))"


def nulls(source: str, *columns: str) -> str:
    bad = " OR ".join(f"{c} IS NULL OR {c}::VARCHAR = ''" for c in columns)
    return f"SELECT 'nulls' AS \"check\", bad = 0 AS passed, {metric(null_rows='bad', records='records')} AS metrics FROM (SELECT count(*) FILTER ({bad}) AS bad, count(*) AS records FROM {source})"


def row_count(source: str, least: int, most: int) -> str:
    return f"SELECT 'row_count' AS \"check\", records BETWEEN {least} AND {most} AS passed, {metric(records='records')} AS metrics FROM (SELECT count(*) AS records FROM {source})"


def schema(source: str, *columns: str) -> str:
    bad = " OR ".join(f"{c} IS NULL" for c in columns)
    return f"SELECT 'schema' AS \"check\", bad = 0 AS passed, {metric(bad_rows='bad', records='records')} AS metrics FROM (SELECT count(*) FILTER ({bad}) AS bad, count(*) AS records FROM {source})"


WAREHOUSE = f"""wh0 AS (
  SELECT (SELECT count(*) FROM documents) AS news_total,
         (SELECT count(*) FROM documents WHERE TIMESTAMP '2024-01-01 00:05:00' + to_minutes((doc_id * 43)::INT) BETWEEN {NOW} - INTERVAL 1 DAY AND {NOW}) AS news_recent,
         (SELECT count(*) FROM c) AS candles_total, (SELECT count(*) FROM c WHERE ws > 1706659200 - 36000) AS candles_recent,
         (SELECT coalesce(sum(trade_count), 0)::BIGINT FROM c WHERE ws > 1706659200 - 36000) AS trades_recent, (SELECT count(*) FROM orders) AS snapshots_total,
         (SELECT round((1706659200 - max(ws)) / 60, 1) FROM c) AS newest_age_min),
wh AS (SELECT *, round(trades_recent / 600, 1) AS trades_per_min FROM wh0)"""

ORACLES = {
    "trade_contract": f"WITH {EVENTS} SELECT symbol, trade_id, price, quantity::DOUBLE AS quantity, ms AS timestamp FROM e WHERE trade_id % 50 NOT IN (7, 11, 13, 19, 23, 37) AND {VALID}",
    "trade_rejects": f"""WITH {EVENTS}, b AS (SELECT *, trade_id % 50 AS k FROM e WHERE trade_id % 50 IN (7, 11, 13, 19, 23, 37) OR NOT ({VALID}))
        SELECT CASE WHEN k = 7 THEN 'not json ' ELSE '' END || CASE WHEN k = 31 THEN '{{"symbol":5,"symbol":"' ELSE '{{"symbol":"' END || symbol || '","trade_id":' || CASE k WHEN 13 THEN trade_id || '.0' WHEN 29 THEN '"+' || trade_id || '"' ELSE trade_id::VARCHAR END
          || ',"price":"' || CASE k WHEN 11 THEN price || 'd' WHEN 17 THEN ' ' || price || ' ' ELSE price::VARCHAR END || '","quantity":"' || quantity || '","timestamp":' || CASE WHEN k = 19 THEN 'true' ELSE ms::VARCHAR END || '}}' || CASE k WHEN 23 THEN ' trailing' WHEN 37 THEN '] {{}}' ELSE '' END AS raw,
          CASE WHEN k IN (7, 23, 37) THEN 'non-json' ELSE 'invalid-trade' END AS reason FROM b""",
    "trade_envelope_parse": f"WITH {EVENTS} SELECT symbol, trade_id, price, quantity::DOUBLE AS quantity, ms AS timestamp FROM e WHERE trade_id % 5 <> 0 AND trade_id % 11 <> 0 AND trade_id % 13 <> 0 AND {VALID}",
    "trade_distinct": f"WITH {TRADES} SELECT DISTINCT symbol, trade_id, price, quantity::DOUBLE AS quantity, ms AS timestamp FROM (SELECT * FROM v UNION ALL SELECT * FROM v WHERE trade_id % 10 = 0)",
    "trade_id_conflicts": f"WITH {TRADES} SELECT symbol, trade_id, count(DISTINCT (price, quantity, ms)) AS versions FROM (SELECT * FROM v UNION ALL SELECT symbol, trade_id, price + 1, quantity, ms FROM v WHERE trade_id % 97 = 0) GROUP BY 1, 2 HAVING count(DISTINCT (price, quantity, ms)) > 1",
    "ohlcv_1m": f"WITH {TRADES}, {candles(60)} SELECT {CANDLE} FROM c",
    "ohlcv_1h": f"WITH {HOURLY} SELECT {CANDLE} FROM c",
    "candle_lookback": f"WITH {HOURLY} SELECT symbol, {AT}, volume::DOUBLE AS volume, close FROM c WHERE ws > 1706659200 - 864000",
    "candle_lookback_ohlcv": f"WITH {HOURLY} SELECT symbol, {AT}, open, high, low, close, volume::DOUBLE AS volume FROM c WHERE ws > 1706659200 - 864000",
    "price_change_multi": f"WITH {HOURLY}, {changes()} SELECT symbol, {AT}, close, {ROUNDED} FROM p",
    "recent_changes": f"WITH {HOURLY}, {changes()} SELECT symbol, {AT}, close, {ROUNDED} FROM p WHERE ws > 1706659200 - 259200 ORDER BY ws DESC, symbol",
    "price_change_lag": f"WITH {HOURLY}, {LAG} SELECT symbol, {AT}, close, price_change FROM q",
    "volume_spike": f"WITH {HOURLY}, {VOLUME} SELECT * EXCLUDE (ws), {AT} FROM vs",
    "price_spike": f"WITH {HOURLY}, {PRICE} SELECT * EXCLUDE (ws), {AT} FROM ps",
    "volume_spike_1m": f"WITH {MINUTES}, {spikes(60, 5, 60, 3.0)} SELECT symbol, signal_type, recent_volume, baseline, ratio, {AT} FROM vs WHERE ws >= 1706659200 - 3600",
    "price_spike_1m": f"WITH {MINUTES}, {moves(60, 1)} SELECT * EXCLUDE (ws), {AT} FROM ps WHERE ws >= 1706659200 - 3600",
    "price_change_1m": f"WITH {MINUTES}, {changes(60)} SELECT symbol, {AT}, close, {ROUNDED} FROM p",
    "all_signals": f"WITH {SIGNALS} SELECT * EXCLUDE (ws), {AT} FROM s",
    "ohlcv_violations": f"WITH {HOURLY}, {ODD} SELECT symbol, {AT}, rule FROM x",
    "ohlcv_errors": f"WITH {HOURLY}, {ODD} SELECT 'ohlcv' AS pipeline, symbol, ws::BIGINT AS at, 'ohlcv/' || rule || ': ' || detail AS error FROM x",
    "candle_upsert_versioned": f"""WITH {TRADES}, a AS (SELECT * FROM v WHERE trade_id % 4 < 2), b AS (SELECT * FROM v WHERE trade_id % 4 > 0), {candles(source='a', name='ca')}, {candles(source='b', name='cb')},
        u AS (SELECT *, TIMESTAMP '2024-02-02' AS updated_at, 0 AS n FROM ca UNION ALL SELECT *, CASE WHEN (ws // 3600) % 3 = 0 THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-02-03' END, 1 FROM cb)
        SELECT {CANDLE}, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ws ORDER BY updated_at DESC, n DESC) AS rn FROM u) WHERE rn = 1""",
    "news_insert_new": f"WITH {NEWS} SELECT {norm('url')} AS url, source, sentiment, position FROM n WHERE position % 3 <> 0",
    "snapshot_insert_new": f"WITH {SNAP} SELECT collected_at, symbol, price FROM (SELECT *, row_number() OVER (PARTITION BY collected_at, symbol ORDER BY price, volume_24h) AS rn FROM s) x WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM s y WHERE y.collected_at = x.collected_at AND y.symbol = x.symbol AND y.price > 250000)",
    "signals_insert_new": f"WITH {SIGNALS} SELECT symbol, signal_type, {AT}, value FROM s WHERE (ws // 3600) % 2 <> 0",
    "market_validate": f"WITH {MARKET} SELECT symbol, name, price, {RULE} AS verdict FROM m",
    "market_coin_schema": """WITH i AS (SELECT c_custkey AS k, c_name FROM customer)
        SELECT CASE WHEN k % 37 <> 0 THEN 'C' || k END AS symbol, CASE WHEN k % 37 = 0 THEN NULL WHEN k % 7 = 0 THEN '5' WHEN k % 11 = 0 OR k % 13 = 0 THEN '' ELSE c_name END AS name,
          CASE WHEN k % 37 = 0 THEN NULL WHEN k % 17 = 0 THEN 1.0::DOUBLE WHEN k % 19 = 0 THEN 1.0::DOUBLE WHEN k % 23 <> 0 THEN k + 0.5::DOUBLE END AS price,
          CASE WHEN k % 37 = 0 OR k % 29 = 0 OR k % 31 = 0 THEN NULL ELSE 7.0::DOUBLE END AS market_cap,
          CASE WHEN k % 37 = 0 THEN 'schema: expected an object' WHEN k % 7 = 0 OR k % 11 = 0 THEN 'schema: expected a text - at name'
            WHEN k % 17 = 0 OR k % 19 = 0 OR k % 23 = 0 THEN 'schema: expected a number - at price' WHEN k % 29 = 0 THEN 'schema: expected a number or null - at market_cap' END AS error FROM i""",
    "market_schema_split": f"WITH {MARKET} SELECT symbol, name, price, market_cap, CASE WHEN symbol IS NULL THEN 'schema: symbol is required' WHEN name IS NULL THEN 'schema: name is required' WHEN price IS NULL THEN 'schema: price is required' END AS error FROM m",
    "market_map": "SELECT upper(lower(c_mktsegment)) AS symbol, c_name AS name, c_acctbal AS price, NULL::DOUBLE AS market_cap, c_custkey::DOUBLE AS circulating_supply, c_acctbal * 2 AS volume_24h, 1.5::DOUBLE AS price_change_24h FROM customer",
    "quarantine_all": f"""WITH {HOURLY}, {ODD}, {MARKET},
        k AS (SELECT 'market' AS pipeline, symbol, CASE WHEN name IS NULL THEN 'schema: name is required' ELSE {RULE} END AS error FROM m UNION ALL SELECT 'ohlcv', symbol, 'ohlcv/' || rule || ': ' || detail FROM x)
        SELECT * FROM k WHERE error <> 'valid'""",
    "recovery_replay_valid": f"""WITH {EVENTS}, z AS (SELECT trade_id % 10 AS k, trade_id, ({VALID}) AS good FROM e)
        SELECT CASE WHEN k = 0 THEN 'candle' WHEN k = 1 THEN 'other' WHEN k <> 3 THEN 'trade' END AS kind,
               CASE WHEN k = 0 AND trade_id % 3 = 0 THEN 'ok' WHEN k = 0 THEN 'candle without updated_at' WHEN k = 1 THEN 'unknown kind' WHEN k = 2 THEN 'payload is no object' WHEN k = 3 THEN 'not json' WHEN good THEN 'ok' ELSE 'invalid trade' END AS verdict,
               count(*) AS n FROM z GROUP BY 1, 2""",
    "news_symbols": f"WITH {NEWS} SELECT url, array_to_string(symbols, ',') AS symbols FROM n",
    "news_sentiment": f"WITH {NEWS} SELECT url, sentiment FROM n",
    "news_tags": f"""WITH {HEADLINES} SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(w, lambda i: d[i]), lambda s: s IS NOT NULL))), ',') AS symbols,
        CASE WHEN up > down THEN 'positive' WHEN down > up THEN 'negative' ELSE 'neutral' END AS sentiment FROM (SELECT *, len(list_intersect(w, pos)) AS up, len(list_intersect(w, neg)) AS down FROM h)""",
    "news_mentions": f"WITH {NEWS} SELECT title, sentiment, published_at FROM n WHERE list_contains(symbols, 'BTC') AND collected_at > {NOW} - INTERVAL 10 DAYS",
    "news_title_search": f"WITH {NEWS} SELECT title, published_at FROM n WHERE title ILIKE '%the%'",
    "news_by_source_sentiment": f"WITH {NEWS} SELECT source, sentiment, count(*) AS n FROM n GROUP BY 1, 2",
    "top_mentions": f"WITH {NEWS} SELECT coin, count(*) AS n FROM (SELECT unnest(symbols) AS coin FROM n WHERE collected_at > {NOW} - INTERVAL 20 DAYS) GROUP BY 1",
    "news_by_hour": f"WITH {NEWS} SELECT hour(published_at)::INT AS hour, count(*) AS n FROM n GROUP BY 1",
    "latest_news": f"WITH {NEWS} SELECT title, source, array_to_string(symbols, ',') AS symbols, sentiment, collected_at FROM n ORDER BY collected_at DESC, position LIMIT 10",
    "news_entry_filter": f"WITH {ENTRIES} SELECT position, url FROM en",
    "news_quarantine": f"WITH {NEWS}, {REPEATED} SELECT 'news' AS pipeline, position, CASE WHEN {strip('title')} = '' THEN 'schema: title is required' ELSE 'schema: url is required' END AS error FROM r WHERE NOT ({FULL})",
    "news_dedupe_url": f"WITH {ENTRIES} SELECT {norm('url')} AS url, min(position) AS position FROM en GROUP BY 1",
    "news_stage_counts": f"""WITH {NEWS}, {REPEATED}, u AS (SELECT {norm('url')} AS url, position, {strip('title')} <> '' AND {norm('url')} <> '/' AS ok FROM r),
        g AS (SELECT url, count(*) AS raw, count(*) FILTER (ok) AS usable, min(position) FILTER (ok) AS first FROM u GROUP BY 1)
        SELECT sum(raw)::BIGINT AS raw, sum(usable)::BIGINT AS usable, count(*) FILTER (usable > 0) AS deduped, count(*) FILTER (usable > 0 AND first % 3 <> 0) AS inserted, count(*) FILTER (usable > 0 AND first % 3 = 0) AS skipped FROM g""",
    "url_normalize": f"""SELECT page_id, {norm('u')} AS url FROM (SELECT page_id, CASE page_id % 5 WHEN 1 THEN ' ' || chr(10) || chr(9) || url || chr(160) || chr(10) WHEN 2 THEN url[:12] || chr(10) || chr(9) || url[13:]
        WHEN 3 THEN regexp_replace(url, '^https', 'HTTPS') WHEN 4 THEN url || '?a' || chr(10) || 'b#c' ELSE url END AS u FROM pages)""",
    "clean_text_full": f"SELECT page_id, {CLEAN.replace('html,', HTML + ',')} AS text FROM pages",
    "clean_text": f"SELECT page_id, {CLEAN} AS text FROM pages",
    "page_content": "SELECT page_id, coalesce(nullif(CASE WHEN page_id % 2 = 0 THEN regexp_extract(html, '<p>([^<]*)</p>', 1) END, ''), nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), nullif(url, ''), '') AS content FROM pages",
    "news_from_pages": f"SELECT * FROM (SELECT page_id, {norm('url')} AS url, trim(regexp_extract(html, '<title>([^<]*)</title>', 1), ' ') AS title, {CLEAN} AS content FROM pages) WHERE url <> '' AND title <> ''",
    "feed_scan": f"SELECT page_id, 'Page <' || page_id || '> & more' AS title, {norm('url')} AS url, {CLEAN.replace('html,', INSIDE + ',')} AS content FROM pages WHERE url IS NOT NULL",
    "feed_sanitize": "SELECT page_id, '<item><link>' || url || '</link></item>' AS feed FROM pages",
    # by the form of a date: to the millisecond, second, minute, day or month; no date; with the hours from UTC that its zone has
    "parse_published": """SELECT event_id, CASE WHEN k = 8 THEN date_trunc('millisecond', ts) WHEN k IN (3, 26, 27) THEN NULL WHEN k < 16 THEN date_trunc('second', ts) WHEN k < 20 THEN date_trunc('minute', ts) WHEN k < 25 THEN date_trunc('day', ts)
        WHEN k = 25 THEN date_trunc('month', ts) WHEN k < 33 THEN date_trunc('second', ts) + to_minutes([300, 420, -120, 210, -330][k - 27]::INT) ELSE date_trunc('second', ts) END::TIMESTAMP AS published_at
        FROM (SELECT *, event_id % 34 AS k FROM events)""",
    "news_market_correlation": f"WITH {HOURLY}, {changes()}, {NEWS} SELECT title, published_at, symbol, {AT}, round(raw_1, 6) AS price_change FROM n JOIN p ON make_timestamp((ws * 1000000)::BIGINT) BETWEEN published_at - INTERVAL 10 MINUTES AND published_at + INTERVAL 10 MINUTES WHERE abs(raw_1) > 1",
    "news_market_correlation_lag": f"WITH {HOURLY}, {LAG}, {NEWS} SELECT title, symbol, {AT}, price_change FROM n JOIN q ON make_timestamp((ws * 1000000)::BIGINT) BETWEEN published_at - INTERVAL 10 MINUTES AND published_at + INTERVAL 10 MINUTES WHERE abs(price_change) > 1",
    "top_market_cap": f"WITH {LATEST} SELECT symbol, name, price, market_cap FROM l ORDER BY market_cap DESC NULLS FIRST, symbol, volume_24h LIMIT 10",
    "top_gainers": f"WITH {LATEST} SELECT symbol, price, price_change_24h FROM l ORDER BY price_change_24h DESC NULLS FIRST, symbol, volume_24h LIMIT 10",
    "volume_leaders": f"WITH {LATEST} SELECT symbol, volume_24h FROM l ORDER BY volume_24h DESC NULLS FIRST, symbol LIMIT 10",
    "trade_id_gaps": f"WITH {IDGAPS} SELECT * FROM i",
    "trade_id_gaps_arrival": f"WITH {ARRIVAL} SELECT * FROM j",
    "range_merge": f"WITH {MERGED} SELECT * FROM mg",
    "range_subtract": f"""WITH {MERGED}, ids AS (SELECT symbol, unnest(range(start, "end" + 1)) AS id FROM mg),
        dn AS (SELECT symbol, trade_id AS id FROM v WHERE trade_id % 5 = 0 UNION SELECT symbol, trade_id + 1 FROM v WHERE trade_id % 5 = 0),
        lf AS (SELECT symbol, id, id - row_number() OVER (PARTITION BY symbol ORDER BY id) AS grp FROM ids WHERE (symbol, id) NOT IN (SELECT symbol, id FROM dn))
        SELECT symbol, min(id) AS start, max(id) AS "end" FROM lf GROUP BY symbol, grp""",
    "gap_summary": f"WITH {IDGAPS} SELECT symbol, count(start) AS gaps, coalesce(sum(\"end\" - start + 1), 0)::BIGINT AS missing, (SELECT max(trade_id) FROM g WHERE g.symbol = i.symbol) AS last_ack FROM i GROUP BY symbol",
    "fetch_plan": f"WITH {IDGAPS}, pg AS (SELECT symbol, \"end\", unnest(range(start, \"end\" + 1, 5)) AS from_id FROM i) SELECT row_number() OVER (PARTITION BY symbol ORDER BY from_id) AS round, symbol, from_id, least(\"end\" - from_id + 1, 5) AS n FROM pg",
    "page_contiguity": "SELECT event_id // 100 AS page, count(*) AS n, min(event_id) AS first_id, max(event_id) - min(event_id) + 1 = count(*) AND count(DISTINCT event_id) = count(*) AND count(*) <= 100 AS contiguous FROM events WHERE event_id % 977 <> 5 GROUP BY 1",
    "check_freshness": f"WITH {NEWS} {FRESH}",
    "check_duplicates": f"WITH {NEWS}, {REPEATED} {duplicates('r', 'title')}",
    "check_nulls": f"WITH {NEWS}, {REPEATED} {nulls('r', 'title', 'url', 'source')}",
    "check_row_count": f"WITH {NEWS} {row_count('n', 1, 1000)}",
    "check_schema": f"WITH {MARKET} {schema('m', 'symbol', 'name', 'price')}",
    "check_summary": f"""WITH {NEWS}, {REPEATED}, k2 AS ({row_count('n', 1, 1000)} UNION ALL {duplicates('n', 'url')} UNION ALL {nulls('r', 'url')})
        SELECT 'news' AS pipeline, count(*) FILTER (passed) AS passed_checks, count(*) FILTER (NOT passed) AS failed_checks, bool_and(passed) AS passed,
          string_agg(told, ' | ' ORDER BY "check") AS description, string_agg(flat, ',' ORDER BY "check") AS metrics
        FROM (SELECT *, array_to_string(list_transform(string_split(metrics, ','), lambda m: "check" || '_' || m), ',') AS flat,
          CASE "check" WHEN 'row_count' THEN regexp_extract(metrics, 'records=(\\d+)', 1) || ' rows, 1 to 1000 allowed' WHEN 'duplicates' THEN regexp_extract(metrics, 'duplicates=(\\d+)', 1) || ' duplicates' ELSE regexp_extract(metrics, 'null_rows=(\\d+)', 1) || ' rows with empty fields' END AS told FROM k2)""",
    "news_quality": f"WITH {NEWS}, k2 AS ({FRESH} UNION ALL {duplicates('n', 'url')} UNION ALL {nulls('n', 'title', 'url', 'source')} UNION ALL {row_count('n', 1, 1000)} UNION ALL {schema('n', 'title', 'url', 'source')}) SELECT *, CASE WHEN \"check\" = 'freshness' THEN 'WARN' ELSE 'ERROR' END AS severity FROM k2",
    "market_quality": f"""WITH {MARKET}, g AS (SELECT * FROM m WHERE name IS NOT NULL AND price IS NOT NULL), b AS (SELECT * FROM m WHERE name IS NULL OR price IS NULL)
        {row_count('g', 10, 500)} UNION ALL {schema('g', 'symbol', 'name', 'price')} UNION ALL {nulls('g', 'symbol', 'price')}
        UNION ALL SELECT 'schema_rejects', n = 0, {metric(schema_rejects='n')} FROM (SELECT count(*) AS n FROM b)
        UNION ALL SELECT 'metrics', true, {metric(coins='n', priced='p', missing_price='n - p')} FROM (SELECT count(*) AS n, count(price) AS p FROM g)""",
    "warehouse_stats": f"WITH {HOURLY}, {WAREHOUSE} SELECT * FROM wh",
    "candle_latency": f"""WITH {HOURLY}, w AS (SELECT symbol, ws, close, ws + 3600 + (ws / 3600) % 17 - 3 AS wa FROM c)
        SELECT symbol, count(DISTINCT ws) AS windows, arg_max(ws, (wa, ws)) AS last_window, arg_max(close, (wa, ws)) AS last_close, round(arg_max(greatest(0.0, wa - ws - 3600), (wa, ws)), 3) AS last_latency, round(max(greatest(0.0, wa - ws - 3600)), 3) AS max_latency FROM w GROUP BY 1""",
    "stream_counters": f"WITH {HOURLY} SELECT (SELECT count(*) FROM v) AS events_total, (SELECT max(ms) FROM v) AS last_event, (SELECT count(*) FROM (SELECT DISTINCT symbol, ws FROM c)) AS windows_created_total",
    "delivery_accounting": f"""WITH {EVENTS}, st AS (SELECT {STATE} AS state FROM e)
        SELECT count(*) AS received, count(*) FILTER (state = 'acknowledged') AS acknowledged, count(*) FILTER (state = 'invalid') AS invalid, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state IS NULL) AS lost FROM st""",
    "consumer_lag": f"WITH {TRADES}, pt AS (SELECT symbol, max(trade_id) AS log_end, max(trade_id) FILTER (ms < (1706659200 - 259200)::BIGINT * 1000) AS cur FROM v GROUP BY 1) SELECT sum(log_end - cur)::BIGINT AS lag_total, sum(log_end)::BIGINT AS log_end_total FROM pt WHERE cur IS NOT NULL",
    "produce_rate": f"WITH {HOURLY} SELECT symbol AS series, make_timestamp((ws * 1000000)::BIGINT) AS at, round((trade_count - lag(trade_count) OVER w) * 3600 / ((ws - lag(ws) OVER w)::DOUBLE), 1) AS rate FROM c WINDOW w AS (PARTITION BY symbol ORDER BY ws)",
    "alerts": f"""WITH {HOURLY}, {WAREHOUSE}, st AS (SELECT {STATE} AS state FROM e),
        f AS (SELECT count(*) FILTER (state IS NULL) AS lost, count(*) FILTER (state = 'failed') AS failed FROM st),
        al AS (SELECT 'newest_candle_age_min' AS subject, CASE WHEN newest_age_min > 15 THEN 'beyond threshold' END AS reason FROM wh
          UNION ALL SELECT 'candles_10m', CASE WHEN candles_recent < 20 THEN 'beyond threshold' END FROM wh
          UNION ALL SELECT 'news_1h', 'missing' UNION ALL SELECT 'failed_runs', 'missing'
          UNION ALL SELECT 'events_lost', CASE WHEN abs(lost) > 0 THEN 'beyond threshold' END FROM f
          UNION ALL SELECT 'publish_failures_total', CASE WHEN failed > 0 THEN 'beyond threshold' END FROM f
          UNION ALL SELECT 'dlq_write_failures_total', 'missing' UNION ALL SELECT 'lag_total', 'invalid threshold')
        SELECT * FROM al WHERE reason IS NOT NULL""",
    "run_outcomes": "SELECT count(*) FILTER (o_orderstatus = 'F') AS success, 2 * count(*) FILTER (o_orderstatus = 'P') AS failed FROM orders",
}
