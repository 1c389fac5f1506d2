"""Closed ranges of ids: gaps, merging, subtracting, and what to fetch. Columns: symbol, start, end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewick.plans.windows import before

#: Ids, or arrival positions, that one window block spans.
SPAN = 1 << 20


def _block(column: str):
    return F.floor(F.col(column) / SPAN)


def id_gaps(trades: DataFrame) -> DataFrame:
    """Ranges of ids that never came, between the smallest and the largest of a symbol."""
    rows = before(trades.select("symbol", "trade_id"), ["symbol"], _block("trade_id"), ["trade_id"], F.col("trade_id"), "previous")
    return rows.where("trade_id > previous + 1").select("symbol", (F.col("previous") + 1).alias("start"), (F.col("trade_id") - 1).alias("end"))


def arrival_gaps(trades: DataFrame, position: str) -> DataFrame:
    """Ranges that were missing when a later id arrived: an id below one already seen opens none."""
    rows = before(trades.select("symbol", "trade_id", position), ["symbol"], _block(position), [position], F.col("trade_id"), "seen")
    return rows.where("trade_id > seen + 1").select("symbol", (F.col("seen") + 1).alias("start"), (F.col("trade_id") - 1).alias("end"))


def _events(ranges: DataFrame) -> DataFrame:
    """(symbol, at, n) of ranges: behind id ``at`` one range more is open, or one less."""
    ends = F.array(F.struct((F.col("start") - 1).alias("at"), F.lit(1).alias("n")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("n")))
    return ranges.where("start <= end").select("symbol", F.inline(ends))


def _runs(events: DataFrame) -> DataFrame:
    """Closed runs of ids, as long as they can be, at which ranges of ``gap`` and none of ``cut`` are open; of events (symbol, at, gap, cut).

    What is open behind an event is a sum within a block and one row for the blocks before; only events that
    open or close a run go on. A run within a block is known there, what reaches over its end is paired across blocks, two rows a block at most.
    """
    events = events.groupBy("symbol", "at").agg(F.sum("gap").alias("gap"), F.sum("cut").alias("cut")).where("gap <> 0 or cut <> 0").withColumn("block", _block("at"))
    per = events.groupBy("symbol", "block").agg(F.sum("gap").alias("gap"), F.sum("cut").alias("cut"))
    earlier = Window.partitionBy("symbol").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("symbol", "block", *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}0") for n in ("gap", "cut")))
    inside = Window.partitionBy("symbol", "block").orderBy("at")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = events.select("symbol", "block", "at", *(F.sum(n).over(upto).alias(n) for n in ("gap", "cut"))).join(per, ["symbol", "block"])
    rows = rows.select("symbol", "block", "at", F.expr("gap + gap0 > 0 and cut + cut0 = 0").alias("now"), F.expr("gap0 > 0 and cut0 = 0").alias("carried"))
    rows = rows.withColumn("was", F.coalesce(F.lag("now").over(inside), "carried")).where("now <> was")
    rows = rows.select("symbol", "block", "at", "now", F.lag("at").over(inside).alias("since"), F.lead("at").over(inside).alias("until")).where("now or since is null")
    across = Window.partitionBy("symbol", F.expr("case when now and until is not null then block end")).orderBy("at")
    rows = rows.withColumn("until", F.coalesce("until", F.lead("at").over(across)))
    return rows.where("now").select("symbol", (F.col("at") + 1).alias("start"), F.col("until").alias("end"))


def merged(ranges: DataFrame) -> DataFrame:
    """Ranges that overlap or touch as one."""
    return _runs(_events(ranges).select("symbol", "at", F.col("n").alias("gap"), F.lit(0).alias("cut")))


def subtracted(gaps: DataFrame, done: DataFrame) -> DataFrame:
    """What remains of the merged ``gaps`` without the ranges ``done``.

    Both are turned into events on the id line; after each event it is known
    how many ranges of either kind are open, so no range meets another in a join.
    """
    holes, out = _events(gaps), _events(done)
    return _runs(holes.select("symbol", "at", F.col("n").alias("gap"), F.lit(0).alias("cut")).unionByName(out.select("symbol", "at", F.lit(0).alias("gap"), F.col("n").alias("cut"))))


def pending(gaps: DataFrame, acked: DataFrame) -> DataFrame:
    """(symbol, gaps, missing, last_ack): how much is missing, and the highest id acknowledged."""
    per = gaps.groupBy("symbol").agg(F.count("*").alias("gaps"), F.sum(F.col("end") - F.col("start") + 1).alias("missing"))
    high = acked.groupBy("symbol").agg(F.max("trade_id").alias("last_ack"))
    return high.join(per, "symbol", "full").select("symbol", F.coalesce("gaps", F.lit(0)).alias("gaps"), F.coalesce("missing", F.lit(0)).alias("missing"), "last_ack")


#: Pages of a chunk, and chunks that one row is turned into at once.
FAN = 4096


def page_chunks(gaps: DataFrame, page: int = 1000) -> DataFrame:
    """(symbol, start, end, first, place, k): runs of at most FAN pages, k each; ``first`` is a run's first id, ``place`` its pages' place among the symbol's.

    A gap is cut into runs step by step, into FAN parts at most, so no row holds more than FAN numbers however long
    a gap is; runs are then dealt over all tasks.
    """
    rows = gaps.select("symbol", "start", "end", F.expr(f"(end - start) div {page} + 1").alias("pages"), _block("start").alias("block"))
    # pages of a symbol's gaps before this one: within a block of ids by a window, across blocks by their sums
    per = rows.groupBy("symbol", "block").agg(F.sum("pages").alias("n"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("symbol", "block", F.coalesce(F.sum("n").over(earlier(Window.partitionBy("symbol").orderBy("block"))), F.lit(0)).alias("ahead"))
    inside = F.coalesce(F.sum("pages").over(earlier(Window.partitionBy("symbol", "block").orderBy("start"))), F.lit(0))
    rows = rows.withColumn("inside", inside).join(per, ["symbol", "block"])
    rows = rows.select("symbol", "start", "end", F.lit(0).cast("long").alias("at"), F.col("pages").alias("k"), (F.col("ahead") + F.col("inside")).alias("before"))
    for run in (FAN**4, FAN**3, FAN**2, FAN):
        parts = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(k - 1) div {run}"))))
        rows = parts.select("symbol", "start", "end", (F.col("at") + F.col("part") * run).alias("at"), F.least(F.lit(run), F.col("k") - F.col("part") * run).alias("k"), "before")
        if run == FAN**2:
            rows = rows.repartition("symbol", "start", "at")
    return rows.select("symbol", "start", "end", (F.col("start") + F.col("at") * page).alias("first"), (F.col("before") + F.col("at")).alias("place"), "k")


def fetch_plan(gaps: DataFrame, page: int = 1000) -> DataFrame:
    """(round, symbol, from_id, n): pages of at most ``page`` ids, symbols taking turns, each in order of ids."""
    runs = page_chunks(gaps, page)
    pages = runs.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    from_id = F.col("first") + F.col("i") * page
    return pages.select((F.col("place") + F.col("i") + 1).alias("round"), "symbol", from_id.alias("from_id"), F.least(F.col("end") - from_id + 1, F.lit(page)).alias("n"))


def contiguous_pages(rows: DataFrame, limit: int = 1000) -> DataFrame:
    """(page, n, first_id, contiguous) of rows (page, id): every id once, without a hole, and at most ``limit``."""
    per = rows.groupBy("page").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count_distinct("id").alias("ids"))
    whole = (F.col("last_id") - F.col("first_id") + 1 == F.col("n")) & (F.col("ids") == F.col("n")) & (F.col("n") <= limit)
    return per.select("page", "n", "first_id", whole.alias("contiguous"))
