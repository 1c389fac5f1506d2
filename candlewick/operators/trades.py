"""Trades: parsing, contract, duplicates, conflicts, rejects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.functions.expressions import once, valid_trade

FIELDS = ["symbol", "trade_id", "price", "quantity", "timestamp"]


#: Numbers as a text may give them; Java's own forms (1d, 0x1p3) are none.
WHOLE = r"^\s*[+-]?[0-9]+\s*\z"
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*\z"
#: JSON and nothing else: Spark's reader would take single quotes and NaN as well.
STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def _sealed(raw: Column) -> Column:
    """The text as first element of a JSON array whose second, a seal made of the text's hash, shows that the first is the whole text.

    A reader of JSON stops behind the first value; what follows that would go unnoticed.
    """
    return F.concat(F.lit("["), raw, F.lit(',{"_seal":"'), F.xxhash64(raw).cast("string"), F.lit('"}]'))


def _read(raw: Column, kind: str) -> Column:
    """The elements of a sealed text, the first as ``kind``; what can't be read is null."""
    return F.from_json(_sealed(raw), f"array<{kind}>", STRICT)


def _opened(two: Column, raw: Column, seal: Callable[[Column], Column]) -> Column:
    """The first of the elements read, where the second is the seal of ``raw``."""
    return F.when((F.size(two) == 2) & (seal(F.get(two, F.lit(1))) == F.xxhash64(raw).cast("string")), F.get(two, F.lit(0)))


def _whole(raw: Column, kind: str, seal: Callable[[Column], Column]) -> Column:
    """The object in a JSON text as ``kind``; null where the text is not exactly one object."""
    return once(_read(raw, kind), lambda two: _opened(two, raw, seal))


def is_json(raw: Column) -> Column:
    """Whether a text is one JSON value; an object may repeat names."""
    tree = F.try_variant_get(F.try_parse_json(_sealed(raw)), "$[1]._seal", "string") == F.xxhash64(raw).cast("string")
    return F.coalesce(tree, F.lit(False)) | _whole(raw, "map<string,string>", lambda m: F.try_element_at(m, F.lit("_seal"))).isNotNull()


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _string(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _text(value: Column) -> Column:
    """The text in a JSON value; null where it is something else."""
    return F.when(_kind(value) == "STRING", _string(value))


def _fields(symbol: Column, trade_id: Column, price: Column, quantity: Column, at: Column) -> Column:
    """A struct of FIELDS, null where a value has not the form of its field.

    The symbol is a JSON value; the others are texts, of a JSON number as it is written: what else JSON has (true, lists, objects) matches neither pattern.
    """
    whole = lambda v: F.when(v.rlike(WHOLE), v).try_cast("long")
    number = lambda v: F.when(v.rlike(NUMBER), v).try_cast("double")
    own = [F.upper(_text(symbol)), whole(trade_id), number(price), number(quantity), whole(at)]
    return F.struct(*(f.alias(n) for f, n in zip(own, FIELDS, strict=True)))


def _kept(fields: Column) -> Column:
    return F.when(valid_trade(*(fields[n] for n in FIELDS)), fields)


#: What is read of a message: the symbol's kind counts, the others may be texts.
SHAPE = "struct<symbol:variant," + ",".join(f"{n}:string" for n in FIELDS[1:]) + ",_seal:string>"


def _contract_fields(two: Column, raw: Column) -> Column:
    whole = _opened(two, raw, lambda s: s["_seal"])
    return _fields(*(whole[n] for n in FIELDS))


def contract(raw: Column) -> Column:
    """The trade in a JSON text, an object of FIELDS, as a struct, or null where it breaks the contract.

    The text is one object and nothing more; of a name that repeats the last counts. The symbol must be a string;
    ids and times integers or texts of digits, never true or false or with a point or exponent; price and quantity numbers or numeric texts.
    """
    return once(once(_read(raw, SHAPE), lambda two: _contract_fields(two, raw)), _kept)


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``name``, computed once a row: a later filter on it is not moved below, which would repeat ``value`` and all that it is made of."""
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c != name), F.explode(F.array(value)).alias(name))


#: What is read of an exchange message, and the same by names that differ in more than case.
MESSAGE = "e:variant,s:variant,t:string,p:string,q:string,T:string"
RENAMED = "e:variant,s:variant,t:string,p:string,q:string,at:string"


def parse_envelope(df: DataFrame, column: str = "value") -> DataFrame:
    """``df`` with ``trade``: of exchange messages, wrapped in ``data`` or bare, those with ``e`` = trade that keep the contract.

    What has the name ``data`` is wrapped, whatever that holds: null or a text there is no trade. Names are told apart by case.
    """
    raw, two, whole, message = (F.col(c) for c in ("_raw", "_two", "_whole", "_message"))
    read = _read(raw, f"struct<data:struct<{MESSAGE}>,{MESSAGE},_seal:string>").cast(f"array<struct<data:struct<{RENAMED}>,{RENAMED},_seal:string>>")
    # without data the name may be missing or hold something else; a text that can't spell the name need not be read again
    named = (raw.contains("data") | raw.contains("\\")) & F.map_contains_key(_whole(raw, "map<string,string>", lambda m: F.try_element_at(m, F.lit("_seal"))), F.lit("data"))
    bare = F.struct(*(whole[n].alias(n) for n in ("e", "s", "t", "p", "q", "at")))
    rows = computed(df, "_raw", F.col(column).cast("string"))
    rows = computed(rows, "_two", read)
    rows = computed(rows, "_whole", _opened(two, raw, lambda s: s["_seal"]))
    rows = computed(rows, "_message", F.when(whole["data"].isNotNull(), whole["data"]).when(whole.isNotNull() & ~named, bare))
    fields = F.when(_text(message["e"]) == "trade", _fields(*(message[n] for n in ("s", "t", "p", "q", "at"))))
    return computed(computed(rows, "_fields", fields), "trade", _kept(F.col("_fields"))).drop("_raw", "_two", "_whole", "_message", "_fields")


def decode(df: DataFrame, column: str = "value") -> DataFrame:
    """``df`` with ``trade``: messages in the normalised form; bytes that are no UTF-8 are no message."""
    raw, text = F.col("_raw"), F.col(column).cast("string")
    rows = computed(df, "_raw", F.when(F.is_valid_utf8(text), text))
    rows = computed(rows, "_two", _read(raw, SHAPE))
    rows = computed(rows, "_fields", _contract_fields(F.col("_two"), raw))
    return computed(rows, "trade", _kept(F.col("_fields"))).drop("_raw", "_two", "_fields")


def trades_of(decoded: DataFrame) -> DataFrame:
    return decoded.where("trade is not null").select("trade.*")


def rejects(decoded: DataFrame, column: str = "value") -> DataFrame:
    """(raw, reason) of messages without a trade: at most 2000 characters; non-json or invalid-trade."""
    text = F.col(column).cast("string")
    reason = F.when(F.is_valid_utf8(text) & is_json(text), "invalid-trade").otherwise("non-json")
    return decoded.where("trade is null").select(F.substring(text, 1, 2000).alias("raw"), reason.alias("reason"))


def keep_valid(df: DataFrame) -> DataFrame:
    """Rows of FIELDS that keep the contract."""
    return df.where(valid_trade(*(F.col(c) for c in FIELDS)))


def distinct_trades(df: DataFrame) -> DataFrame:
    """Each trade once, whatever it was delivered; equal in all five fields."""
    return df.dropDuplicates(FIELDS)


def conflicts(df: DataFrame) -> DataFrame:
    """(symbol, trade_id, versions) of ids that come with different contents."""
    one = df.select("symbol", "trade_id", "price", "quantity", "timestamp").distinct()
    return one.groupBy("symbol", "trade_id").agg(F.count("*").alias("versions")).where("versions > 1")


def fail_on_conflict(df: DataFrame) -> DataFrame:
    """Distinct trades; the job fails at the first id that comes with different contents."""
    payload = F.struct("price", "quantity", "timestamp")
    one = df.groupBy("symbol", "trade_id").agg(F.min(payload).alias("lo"), F.max(payload).alias("hi"))
    told = F.concat(F.lit("conflicting trade "), F.col("symbol"), F.lit(" "), F.col("trade_id").cast("string"))
    checked = one.withColumn("lo", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.raise_error(told)))
    return checked.select("symbol", "trade_id", "lo.price", "lo.quantity", "lo.timestamp")
