"""Rules, and checks of whole relations. A check is one row: (check, passed, message, metrics)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.functions.expressions import blank, finite

CANDLE_FIELDS = ["symbol", "window_start", "open", "high", "low", "close", "volume", "trade_count"]


def market_error(symbol: Column, price: Column, market_cap: Column) -> Column:
    """The first rule that a snapshot row breaks, in this order, or null."""
    return (
        F.when(symbol.isNull() | (symbol == ""), "missing symbol")
        .when(price.isNull(), "missing price")
        .when(~finite(price), "non-finite price")
        .when(price <= 0, F.concat(F.lit("price <= 0 ("), price.cast("string"), F.lit(")")))
        .when(market_cap.isNotNull() & ~finite(market_cap), "non-finite market_cap")
        .when(market_cap <= 0, F.concat(F.lit("market_cap <= 0 ("), market_cap.cast("string"), F.lit(")")))
    )


def schema_error(df: DataFrame, required: list[str], corrupt: str | None = None) -> Column:
    """``schema: ...`` for a row that could not be read as declared or lacks a required field."""
    out = F.when(F.col(corrupt).isNotNull(), F.lit("schema: malformed record")) if corrupt and corrupt in df.columns else None
    for name in required:
        text = F.lit(f"schema: {name} is required")
        out = F.when(F.col(name).isNull(), text) if out is None else out.when(F.col(name).isNull(), text)
    return out


def article_error(title: Column, url: Column) -> Column:
    """What an article lacks, or null."""
    return F.when(blank(title), "schema: title is required").when(blank(url), "schema: url is required")


NUMBERS = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)\z"


def coins_of(items: DataFrame, column: str = "value") -> DataFrame:
    """Coins given as JSON texts under the snapshot's names, with ``error`` (``schema: ...``, or null) and ``payload``.

    The name must be a text and may be missing, the price a number, the others numbers or null; whatever is
    no object is an error. The symbol is read as a text, whatever it is; a missing one is empty.
    """
    tree = F.try_parse_json(column)
    part = lambda name: F.try_variant_get(tree, f"$.{name}", "variant")
    kind = lambda name: F.schema_of_variant(part(name))
    text = lambda name: F.try_variant_get(tree, f"$.{name}", "string")
    number = lambda name: F.try_variant_get(tree, f"$.{name}", "double")
    optional = [("market_cap", "market_cap"), ("circulating_supply", "circulating_supply"), ("volume_24h", "total_volume"), ("price_change_24h", "price_change_percentage_24h")]
    no_object = ~F.coalesce(F.schema_of_variant(tree).startswith("OBJECT"), F.lit(False))
    error = F.when(no_object, "schema: expected an object").when(kind("name") != "STRING", "schema: expected a text - at name")
    error = error.when(~F.coalesce(kind("current_price").rlike(NUMBERS), F.lit(False)), "schema: expected a number - at price")
    for name, own in optional:
        error = error.when(~kind(own).rlike(NUMBERS) & (kind(own) != "VOID"), f"schema: expected a number or null - at {name}")
    symbol = F.when(kind("symbol") == "VOID", "NONE").otherwise(F.coalesce(F.upper(text("symbol")), F.upper(F.to_json(part("symbol"))), F.lit("")))
    names = [F.when(~no_object, symbol).alias("symbol"), F.when(~no_object, F.coalesce(text("name"), F.lit(""))).alias("name"), number("current_price").alias("price")]
    return items.select(*names, *(number(own).alias(name) for name, own in optional), F.col(column).alias("payload"), error.alias("error"))


def map_coins(coins: DataFrame) -> DataFrame:
    """A coin list's fields under the snapshot's names."""
    return coins.select(
        F.upper(F.col("symbol").cast("string")).alias("symbol"), "name", F.col("current_price").alias("price"), "market_cap", "circulating_supply",
        F.col("total_volume").alias("volume_24h"), F.col("price_change_percentage_24h").alias("price_change_24h"),
    )


def candle_violations(candles: DataFrame) -> DataFrame:
    """(symbol, window_start, rule, detail), none to five per candle; a missing field stops the other rules."""
    absent = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in CANDLE_FIELDS)))
    o, h, low, c, v = (F.col(x).cast("double") for x in ("open", "high", "low", "close", "volume"))
    n = F.col("trade_count")
    # NaN breaks every comparison it takes part in, unlike in Spark's order, where it is above all numbers
    at_least = lambda a, b: ~F.isnan(a) & ~F.isnan(b) & (a >= b)
    rules = [
        ("high_low", ~at_least(h, low), F.format_string("high=%s < low=%s", h, low)),
        ("high_open_close", ~(at_least(h, o) & at_least(h, c)), F.format_string("high=%s outside [open=%s, close=%s]", h, o, c)),
        ("low_open_close", ~(at_least(o, low) & at_least(c, low)), F.format_string("low=%s outside [open=%s, close=%s]", low, o, c)),
        ("volume", ~F.isnan(v) & (v < 0), F.format_string("volume=%s < 0", v)),
        ("count", ~(n > 0), F.format_string("trade_count=%s must be above 0", n)),
    ]
    violation = lambda rule, detail: F.struct(F.lit(rule).alias("rule"), detail.alias("detail"))
    missing = F.array(violation("missing_field", F.concat(F.lit("missing "), F.array_join(absent, ","))))
    broken = F.array_compact(F.array(*(F.when(test, violation(rule, detail)) for rule, test, detail in rules)))
    rows = candles.select("symbol", "window_start", F.explode(F.when(F.size(absent) > 0, missing).otherwise(broken)).alias("v"))
    return rows.select("symbol", "window_start", "v.rule", "v.detail")


def candle_errors(violations: DataFrame) -> DataFrame:
    """Violations as quarantine rows."""
    return violations.select(
        F.lit("ohlcv").alias("pipeline"),
        F.to_json(F.struct("symbol", "window_start", "rule", "detail")).alias("payload"),
        F.concat(F.lit("ohlcv/"), F.col("rule"), F.lit(": "), F.col("detail")).alias("error"),
    )


def _check(df: DataFrame, name: str, passed: Column, message: Column, **metrics: Column) -> DataFrame:
    pairs = [x for k, v in metrics.items() for x in (F.lit(k), v.cast("double"))]
    return df.select(F.lit(name).alias("check"), F.coalesce(passed, F.lit(False)).alias("passed"), message.alias("message"), F.create_map(*pairs).alias("metrics"))


def check_freshness(df: DataFrame, column: str, max_minutes: float, now: Column) -> DataFrame:
    """The newest time that can be read is at most ``max_minutes`` old; if none can be, the check fails."""
    at = F.col(column).cast("timestamp")
    one = df.agg(F.max(at).alias("newest"), F.count("*").alias("records"), F.count(at).alias("dated"))
    age = F.round((F.unix_micros(now.cast("timestamp")) - F.unix_micros("newest")) / 60e6, 1)
    told = F.coalesce(F.format_string("newest is %s min old", age), F.lit("no time can be read"))
    return _check(one, "freshness", age <= max_minutes, told, records=F.col("records"), dated=F.col("dated"), age_minutes=age)


def check_duplicates(df: DataFrame, key: str) -> DataFrame:
    """No key twice; nulls are one key."""
    per = df.groupBy(key).agg(F.count("*").alias("n"))
    one = per.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("dup"), F.coalesce(F.sum("n"), F.lit(0)).alias("records"))
    return _check(one, "duplicates", F.col("dup") == 0, F.format_string("%d duplicates", F.col("dup")), duplicates=F.col("dup"), records=F.col("records"))


def check_nulls(df: DataFrame, required: list[str]) -> DataFrame:
    """No required field null or empty."""
    bad = reduce(lambda a, b: a | b, (F.col(c).isNull() | (F.col(c).cast("string") == "") for c in required))
    one = df.agg(F.count_if(bad).alias("bad"), F.count("*").alias("records"))
    return _check(one, "nulls", F.col("bad") == 0, F.format_string("%d rows with empty fields", F.col("bad")), null_rows=F.col("bad"), records=F.col("records"))


def check_row_count(df: DataFrame, least: int, most: int) -> DataFrame:
    one = df.agg(F.count("*").alias("records"))
    return _check(one, "row_count", F.col("records").between(least, most), F.format_string(f"%d rows, {least} to {most} allowed", F.col("records")), records=F.col("records"))


def check_schema(df: DataFrame, required: list[str], position: Column, corrupt: str | None = None) -> DataFrame:
    """No row breaks the schema; the message has the first error, 200 characters of it at most."""
    rows = df.withColumn("_error", schema_error(df, required, corrupt))
    one = rows.agg(F.count("_error").alias("bad"), F.count("*").alias("records"), F.min_by("_error", F.when(F.col("_error").isNotNull(), position)).alias("first"))
    told = F.when(F.col("bad") == 0, F.lit("schema ok")).otherwise(F.substring(F.col("first"), 1, 200))
    return _check(one, "schema", F.col("bad") == 0, told, bad_rows=F.col("bad"), records=F.col("records"))


def summary(checks: DataFrame, pipeline: str) -> DataFrame:
    """(pipeline, passed_checks, failed_checks, passed, description, metrics): all checks of a pipeline in one row.

    Metrics are named <check>_<metric>; the checks, a handful of rows, have different names.
    """
    named = F.transform(F.map_entries("metrics"), lambda e: F.struct(F.concat("check", F.lit("_"), e.key).alias("key"), e.value.alias("value")))
    return checks.agg(
        F.count_if("passed").alias("passed_checks"), F.count_if(~F.col("passed")).alias("failed_checks"),
        F.array_sort(F.collect_list(F.struct("check", "message"))).alias("all"), F.flatten(F.collect_list(named)).alias("named"),
    ).select(
        F.lit(pipeline).alias("pipeline"), "passed_checks", "failed_checks", (F.col("failed_checks") == 0).alias("passed"),
        F.array_join(F.col("all.message"), " | ").alias("description"), F.map_from_entries("named").alias("metrics"))


def news_suite(news: DataFrame, now: Column) -> DataFrame:
    """The checks of the news pipeline, with their severity."""
    required = ["title", "url", "source"]
    warn = check_freshness(news, "published_at", 24 * 60, now).withColumn("severity", F.lit("WARN"))
    hard = [check_duplicates(news, "url"), check_nulls(news, required), check_row_count(news, 1, 1000), check_schema(news, required, F.col("position"))]
    return reduce(DataFrame.unionByName, [warn, *(c.withColumn("severity", F.lit("ERROR")) for c in hard)])


def market_suite(valid: DataFrame, rejects: DataFrame) -> DataFrame:
    """The checks of the market pipeline; rejected rows fail it as well."""
    parts = [check_row_count(valid, 10, 500), check_schema(valid, ["symbol", "name", "price"], F.col("symbol")), check_nulls(valid, ["symbol", "price"])]
    lost = rejects.agg(F.count("*").alias("n"))
    parts.append(_check(lost, "schema_rejects", F.col("n") == 0, F.format_string("%d rejected", F.col("n")), schema_rejects=F.col("n")))
    coins = valid.agg(F.count("*").alias("coins"), F.count("price").alias("priced"))
    parts.append(_check(coins, "metrics", F.lit(True), F.lit("metrics only"), coins=F.col("coins"), priced=F.col("priced"), missing_price=F.col("coins") - F.col("priced")))
    return reduce(DataFrame.unionByName, parts)
