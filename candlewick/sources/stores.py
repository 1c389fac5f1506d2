"""Stored relations as Parquet folders by day, and the writers that keep their keys unique.

A batch writes its rows aside as one piece a day and then puts one entry into the
store's log, so readers see either the old table or the new one, and a batch that
the log knows is not applied again. Pieces have levels: once a day has ``FAN`` pieces
of a level they are merged into one of the next, so a row is rewritten a
few times only, however many batches come. Every ``Log.EVERY`` entries the log's state is
written as a snapshot, and what a batch reads of the log is one snapshot and the entries since.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.operators import merge

Batch = str | tuple[str, int]


class Log:
    """What a store consists of: entries in order, and snapshots of what they add up to.

    An entry is a small file that a rename puts in place. A snapshot has the live pieces and, for each
    writer that numbers its batches, the last number; batches with names of their own get an empty file each, by which
    they are found. Entries and snapshots before the last but one snapshot are deleted, with the pieces that were replaced by then.
    """

    EVERY = 32
    KEYS = "keys.json"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.seen = spark, path, {}
        self.hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.reads = self.writes = 0

    def names(self) -> list[str]:
        folder = self.hadoop(f"{self.path}/log")
        return sorted(f.getPath().getName() for f in self.fs.listStatus(folder)) if self.fs.exists(folder) else []

    def load(self, name: str) -> dict:
        if name not in self.seen:
            self.reads += 1
            stream = self.fs.open(self.hadoop(f"{self.path}/log/{name}"))
            try:
                self.seen[name] = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
        return self.seen[name]

    def save(self, name: str, content: dict) -> None:
        self.writes += 1
        aside, place = self.hadoop(f"{self.path}/log/.{uuid.uuid4().hex}"), self.hadoop(f"{self.path}/log/{name}")
        out = self.fs.create(aside)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if self.fs.exists(place) or not self.fs.rename(aside, place):
            raise RuntimeError(f"{name} of {self.path} was written by somebody else")

    def delete(self, name: str) -> None:
        """Delete a file, or a piece with what stands beside it."""
        for own in {name, beside(name)}:
            self.fs.delete(self.hadoop(f"{self.path}/{own}"), True)

    def state(self) -> dict:
        """seq, pieces (data -> [day, level, seq] and the ends of its ids, if they are kept), marks (writer -> last number), ids of named batches since the snapshot, dropped pieces."""
        names = self.names()
        snapshots = [n for n in names if n.startswith("snapshot-")]
        last = snapshots[-1] if snapshots else ""
        state = json.loads(json.dumps(self.load(last))) if last else {"seq": -1, "pieces": {}, "marks": {}, "dropped": []}
        state |= {"ids": [], "since": 0, "snapshots": snapshots}
        for name in names:
            if name.startswith("entry-") and int(name[6:26]) > state["seq"]:
                entry = self.load(name)
                state["seq"], state["since"] = entry["seq"], state["since"] + 1
                for data in entry["drops"]:
                    state["pieces"].pop(data)
                    state["dropped"].append(data)
                state["pieces"] |= {data: [day, level, entry["seq"], *ends] for data, day, level, *ends in entry["adds"]}
                if entry["number"] is None:
                    state["ids"].append(entry["writer"])
                else:
                    state["marks"][entry["writer"]] = max(entry["number"], state["marks"].get(entry["writer"], -1))
        kept = {*names}
        self.seen = {n: c for n, c in self.seen.items() if n in kept}
        return state

    def _marker(self, batch: str) -> str:
        return f"batches/{hashlib.sha256(batch.encode()).hexdigest()}"

    def done(self, batch: Batch, state: dict | None = None) -> bool:
        state = state or self.state()
        if isinstance(batch, tuple):
            return batch[1] <= state["marks"].get(batch[0], -1)
        return batch in state["ids"] or self.fs.exists(self.hadoop(f"{self.path}/{self._marker(batch)}"))

    def commit(self, batch: Batch, adds: list[tuple[str, str, int]], drops: list[str], state: dict) -> None:
        writer, number = batch if isinstance(batch, tuple) else (batch, None)
        entry = {"seq": state["seq"] + 1, "writer": writer, "number": number, "adds": adds, "drops": drops}
        self.save(f"entry-{entry['seq']:020d}", entry)
        if state["since"] + 1 >= self.EVERY:
            self.snapshot()

    def snapshot(self) -> None:
        """Write down the state; then delete what lies before the snapshot before."""
        state = self.state()
        for batch in state["ids"]:
            self.fs.create(self.hadoop(f"{self.path}/{self._marker(batch)}"), True).close()
        before = state["snapshots"][-1] if state["snapshots"] else None
        old = {*self.load(before)["dropped"]} if before else set()
        whole = {k: state[k] for k in ("seq", "pieces", "marks")} | {"dropped": [d for d in state["dropped"] if d not in old]}
        self.save(f"snapshot-{state['seq']:020d}", whole)
        for data in old:
            self.delete(data)
        for name in self.names():
            if before and ((name.startswith("snapshot-") and name < before) or (name.startswith("entry-") and int(name[6:26]) <= int(before[9:]))):
                self.delete(f"log/{name}")


class Store:
    """A table of ``schema``. ``day`` is a SQL expression of the columns, the day that a row belongs to; without one the table is one part.

    With ``keys`` and ``version`` the table has one row a key, that of the highest version, of equal ones the last that came;
    a batch adds only its own rows, and a reader puts the pieces of a day together. The keys must fix the day.
    A batch is a name, or a writer and its growing number.

    With ``lookup``, columns that name a row, the last of them an integer, the log has the ends of that integer in each piece, and a Bloom
    filter of the columns' hashes stands beside it: ``holding`` tells which pieces may hold given rows without opening the others.
    """

    #: Bits of a Bloom filter on level 0; a filter has FAN times as many on each further level.
    BITS = 1 << 19

    #: Pieces of one level and day that are merged into one.
    FAN = 8

    def __init__(self, spark: SparkSession, path: str, schema: str, day: str | None = None, defaults: dict[str, str] | None = None, keys: list[str] | None = None, version: str = "updated_at", lookup: list[str] | None = None):
        self.lookup = lookup
        self.spark, self.path, self.schema, self.defaults = spark, path, schema, defaults or {}
        self.day = F.coalesce(F.expr(day).cast("string"), F.lit("none")) if day else F.lit("all")
        self.keys, self.version, self.log = keys, version, Log(spark, path)
        if self.log.KEYS in self.log.names():  # the store knows them
            told = self.log.load(self.log.KEYS)
            if keys and (keys, version) != (told["keys"], told["version"]):
                raise ValueError(f"{path} keeps {told['keys']} by {told['version']}")
            self.keys, self.version = told["keys"], told["version"]

    def create(self) -> Store:
        """Create it if missing; an existing store is left alone."""
        self.log.fs.mkdirs(self.log.hadoop(f"{self.path}/log"))
        if self.keys and self.log.KEYS not in self.log.names():
            self.log.save(self.log.KEYS, {"keys": self.keys, "version": self.version})
        return self

    def done(self, batch: Batch) -> bool:
        return self.log.done(batch)

    def pieces(self, days: Iterable[str] | None = None) -> list[str]:
        """The folders that the table, or some days of it, consists of."""
        wanted = None if days is None else {*days}
        return sorted(data for data, (day, *_) in self.log.state()["pieces"].items() if wanted is None or day in wanted)

    def _rows(self, pieces: list[str]) -> DataFrame:
        """The rows of pieces, with ``_seq`` where keys are kept."""
        schema = self.schema + (", _seq long" if self.keys else "")
        rows = self.spark.read.schema(schema).parquet(*(f"{self.path}/{p}" for p in pieces)) if pieces else self.spark.createDataFrame([], schema)
        for name, value in self.defaults.items():
            rows = rows.withColumn(name, F.coalesce(F.col(name), F.expr(value).cast(rows.schema[name].dataType)))
        return rows

    def _newest(self, rows: DataFrame) -> DataFrame:
        """One row a key."""
        oldest = F.lit("1970-01-01").cast("timestamp").cast(rows.schema[self.version].dataType) if "timestamp" in rows.schema[self.version].dataType.simpleString() else F.lit(0)
        rank = F.struct(F.coalesce(F.col(self.version), oldest), F.col("_seq"))
        rest = [c for c in rows.columns if c not in self.keys]
        one = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), rank).alias("_row"))
        return one.select(*(c if c in self.keys else F.col(f"_row.{c}").alias(c) for c in rows.columns))  # keys as they are grouped, so a filter on them reaches the scan

    def read(self, days: Iterable[str] | None = None, columns: list[str] | None = None) -> DataFrame:
        """The table, or some days of it, or some columns; columns added to the schema since a file was written have their default, or null."""
        rows = self._rows(self.pieces(days))
        wanted = columns or [c for c in rows.columns if c != "_seq"]
        if self.keys:
            rows = self._newest(rows.select(*dict.fromkeys([*self.keys, *wanted, self.version, "_seq"])))
        return rows.select(*wanted)

    def days(self) -> list[str]:
        """The days that the table has rows of."""
        return sorted({day for day, *_ in self.log.state()["pieces"].values()})

    def days_of(self, rows: DataFrame) -> list[str]:
        return sorted(r[0] for r in rows.select(self.day.alias("day")).distinct().collect())

    def _write(self, rows: DataFrame, days: list[str], level: int) -> list[tuple[str, str, int]]:
        data = f"data/{uuid.uuid4().hex}"
        rows.withColumn("_day", self.day).write.partitionBy("_day").parquet(f"{self.path}/{data}")
        pieces = {day: f"{data}/_day={day}" for day in days}
        if not self.lookup:
            return [(piece, day, level) for day, piece in pieces.items()]
        kept = self.spark.read.schema(f"{self.schema}, _day string").parquet(f"{self.path}/{data}")
        bits = kept.select("_day", *self._slot(level, *map(F.col, self.lookup)))
        bits = bits.groupBy("_day", "bucket").agg(F.expr("bitmap_construct_agg(place)").alias("bits")).withColumn("level", F.lit(level))
        bits.write.partitionBy("_day").parquet(f"{self.path}/{data}-bloom")
        ends = {r[0]: r[1:] for r in kept.groupBy("_day").agg(F.min(self.lookup[-1]), F.max(self.lookup[-1])).collect()}  # a row a day
        return [(piece, day, level, *ends.get(day, (None, None))) for day, piece in pieces.items()]

    def _slot(self, level: int, *columns) -> list:
        """Where a row's bit is in a filter of a level: the bucket of 32768 bits, and the place in it."""
        at = F.pmod(F.xxhash64(*columns), F.lit(self.BITS * self.FAN**level))
        return [F.floor(at / 32768).alias("bucket"), (at % 32768).alias("place")]

    def holding(self, rows: DataFrame) -> list[str]:
        """The pieces that may hold one of ``rows`` (columns of ``lookup``), by the ends of their ids, then by their filters."""
        low, high = rows.agg(F.min(self.lookup[-1]), F.max(self.lookup[-1])).first()
        if low is None:
            return []
        found: dict[int, list[str]] = {}
        for data, (_, level, _, first, last) in self.log.state()["pieces"].items():
            if first is not None and first <= high and low <= last:
                found.setdefault(level, []).append(data)
        out: list[str] = []
        for level, pieces in found.items():  # a job a level, over the filters of these pieces alone
            bits = self.spark.read.schema("bucket long, bits binary, level int").parquet(*(f"{self.path}/{beside(p)}" for p in pieces))
            bits = bits.select("bucket", "bits", F.regexp_extract("_metadata.file_path", r"data/([^/]+)-bloom/(_day=[^/]+)/", 0).alias("piece"))
            asked = rows.select(*self._slot(level, *map(F.col, self.lookup))).distinct()
            there = F.expr("shiftright(cast(conv(hex(substring(bits, cast(place div 8 + 1 as int), 1)), 16, 10) as int), cast(place % 8 as int)) & 1") == 1
            out += [r[0] for r in bits.join(asked, "bucket").where(there).select(F.regexp_replace(F.regexp_replace("piece", "-bloom/", "/"), "/$", "")).distinct().collect()]
        return sorted(out)

    def read_pieces(self, pieces: list[str]) -> DataFrame:
        """The rows of some pieces of a store without keys."""
        return self._rows(pieces)

    def _add(self, batch: Batch, rows: DataFrame, replaced: Callable[[list[str]], list[str]] | None = None) -> bool:
        state = self.log.state()
        if self.log.done(batch, state):
            return False
        if self.keys:
            rows = rows.withColumn("_seq", F.lit(state["seq"] + 1).cast("long"))
        rows = rows.select(*self._rows([]).columns)
        days = self.days_of(rows)
        adds = self._write(rows, days, 0) if days else []
        self.log.commit(batch, adds, replaced(days) if replaced else [], state)
        self._merge(days)
        return True

    def _merge(self, days: list[str]) -> None:
        """Merge the days' levels that are full, an entry for each merge; a merge that is lost is made up for by the next batch."""
        for day in days:
            while True:
                state, full = self.log.state(), None
                by_level: dict[int, list[str]] = {}
                for data, (own, level, *_) in state["pieces"].items():
                    if own == day:
                        by_level.setdefault(level, []).append(data)
                full = next((level for level in sorted(by_level) if len(by_level[level]) >= self.FAN), None)
                if full is None:
                    break
                rows = self._rows(sorted(by_level[full]))
                rows = self._newest(rows) if self.keys else rows
                adds = self._write(rows.coalesce(max(1, len(by_level[full]) // self.FAN)), [day], full + 1)
                self.log.commit(f"merge-{uuid.uuid4().hex}", adds, by_level[full], state)

    def change(self, batch: Batch, rows: DataFrame, merged: Callable[[DataFrame], DataFrame]) -> bool:
        """Replace the days of ``rows`` by ``merged`` of what they hold, once per batch."""
        days = self.days_of(rows)
        old = self.pieces(days)
        if self.done(batch):
            return False
        return self._add(batch, merged(self.read(days)) if days else rows, lambda _: old)

    def upsert(self, batch: Batch, rows: DataFrame, keys: list[str], version: str = "updated_at") -> bool:
        """Version-guarded upsert: an older version never replaces a newer one. The keys must fix the day."""
        if self.keys:
            if (keys, version) != (self.keys, self.version):
                raise ValueError(f"this store keeps {self.keys} by {self.version}")
            return self._add(batch, rows)
        return self.change(batch, rows, lambda now: merge.upsert_versioned(now, rows.select(now.columns), keys, version))

    def append(self, batch: Batch, rows: DataFrame) -> bool:
        """Add rows as a piece a day."""
        return self._add(batch, rows)

    def insert_absent(self, batch: Batch, rows: DataFrame, keys: list[str], order) -> bool:
        """Append the rows whose keys are not stored; the first of each key wins. Only the keys of stored rows are read."""
        now = self.read()
        return self.append(batch, merge.insert_absent(now, rows.select(now.columns), keys, order))

    def vacuum(self) -> None:
        """Delete at once what snapshots would delete in time; no batch and no reader of an older state may be at work."""
        for data in self.log.state()["dropped"]:
            self.log.delete(data)


def beside(data: str) -> str:
    """Where the Bloom filter of a piece is."""
    return data.replace("/_day=", "-bloom/_day=")


def publishable(trades: DataFrame) -> DataFrame:
    """(key, value) of trades for a keyed stream: the symbol, and the trade as JSON."""
    return trades.select(F.col("symbol").alias("key"), F.to_json(F.struct(*trades.columns)).alias("value"))


def coin_list(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON arrays of coins, the 50 largest by market cap."""
    declared = "symbol string, name string, current_price double, market_cap double, circulating_supply double, total_volume double, price_change_percentage_24h double, _corrupt_record string"
    return spark.read.schema(declared).option("multiLine", True).json(path).orderBy(F.desc_nulls_last("market_cap"), "symbol").limit(50)


def history_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages of past trades as (page, id, price, quantity, at); a page is a file."""
    rows = spark.read.schema("id long, price string, qty string, time long").option("multiLine", True).json(path)
    return rows.select(F.col("_metadata.file_name").alias("page"), "id", F.col("price").try_cast("double").alias("price"), F.col("qty").try_cast("double").alias("quantity"), F.col("time").alias("at"))


def feed_entries(spark: SparkSession, path: str) -> DataFrame:
    """Landed feeds, RSS or Atom, as (source, title, link, published, content, error): one row per item or entry; the source is the file's name.

    Files are split and read by their items, not as a whole. What stands in a CDATA section or carries another prefix is no markup of the feed.
    A file that is no feed, or whose markup breaks off, gives one row with an error beside the items before that, so it does not stop the others; an empty feed gives none.
    """
    from candlewick.functions.expressions import first_filled

    shape = "title string, link struct<_VALUE string, _href string>, pubDate string, description string, `content:encoded` string, published string, updated string, summary string, content string, broken string"
    source = F.regexp_extract("_metadata.file_path", r"([^/]+?)(\.[^./]*)?$", 1).alias("source")
    reader = spark.read.format("xml").schema(shape).option("columnNameOfCorruptRecord", "broken").option("mode", "PERMISSIVE")
    items = reader.option("rowTag", "item").load(path).select(source, "*").unionByName(reader.option("rowTag", "entry").load(path).select(source, "*"))
    # Spark reads the broken text only together with a field
    items = items.withColumn("broken", F.nullif(F.concat_ws("", "broken", F.substring("title", 1, 0)), F.lit("")))
    link = first_filled(F.trim("link._VALUE"), F.col("link._href"))
    published = first_filled(F.col("pubDate"), F.col("published"), F.col("updated"))
    content = first_filled(F.col("content:encoded"), F.col("content"), F.col("description"), F.col("summary"))
    none = F.lit(None).cast("string")
    good = items.where("broken is null").select("source", "title", link.alias("link"), F.nullif(published, F.lit("")).alias("published"), content.alias("content"), none.alias("error"))
    files = spark.read.text(path).groupBy(source).agg(F.max(F.col("value").rlike(r"<(rss|feed|rdf:RDF|item|entry)[\s>]")).alias("feed"))
    broken = items.groupBy("source").agg(F.max(F.col("broken").isNotNull()).alias("broken"))
    error = F.when(~F.col("feed"), "no items").when(F.col("broken"), "broken markup")
    errors = files.join(broken, "source", "left").select("source", *(none.alias(c) for c in ("title", "link", "published", "content")), error.alias("error")).where("error is not null")
    return good.unionByName(errors)
