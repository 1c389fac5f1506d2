"""Recovery records: JSON lines of what could not be delivered, judged before they are replayed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlewick.operators.trades import contract
from candlewick.sources.stores import Log


def append(rows: DataFrame, path: str, kind: str, reason: str) -> None:
    """Add rows as records (kind, payload, reason, recorded_at)."""
    rows.select(F.lit(kind).alias("kind"), F.struct("*").alias("payload"), F.lit(reason).alias("reason"), F.current_timestamp().alias("recorded_at")).write.mode("append").json(path)


def judged(lines: DataFrame, column: str = "value") -> DataFrame:
    """(kind, payload, verdict) of each line: ok, or why it can't be replayed.

    A trade must keep the contract; a candle must carry its version, else an old one could win.
    """
    tree = F.try_parse_json(column)
    kind = F.try_variant_get(tree, "$.kind", "string")
    payload = F.try_variant_get(tree, "$.payload", "variant")
    text = F.to_json(payload)
    verdict = (
        F.when(tree.isNull(), "not json")
        .when(~F.coalesce(kind.isin("trade", "candle"), F.lit(False)), "unknown kind")
        .when(~F.coalesce(F.schema_of_variant(payload).startswith("OBJECT"), F.lit(False)), "payload is no object")
        .when((kind == "trade") & contract(text).isNull(), "invalid trade")
        .when((kind == "candle") & F.try_variant_get(payload, "$.updated_at", "string").isNull(), "candle without updated_at")
        .otherwise("ok")
    )
    return lines.select(kind.alias("kind"), text.alias("payload"), verdict.alias("verdict"))


def replay(spark: SparkSession, path: str, checkpoint: str, handlers: dict[str, Callable[[DataFrame], None]]) -> None:
    """Hand every new record that is ok to the handler of its kind, once.

    A file stream with a checkpoint resumes behind what the handlers have finished;
    a handler that fails stops the query before its batch is recorded.
    """

    def batch(rows: DataFrame, _: int) -> None:
        good = judged(rows).where("verdict = 'ok'").persist()
        try:
            for kind, handle in handlers.items():
                handle(good.where(F.col("kind") == kind).select("payload"))
        finally:
            good.unpersist()

    stream = spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(path)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, last, value): the lines of files, numbered from 0 in each, however the file was split for reading; ``last`` is the file's highest number."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    # lines before a split's own: a count per split, a row each
    per = lines.groupBy("file", "block").agg(F.count("*").alias("n"))
    splits = Window.partitionBy("file").orderBy("block")
    ahead = F.coalesce(F.sum("n").over(splits.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("file", "block", ahead.alias("ahead"), (F.sum("n").over(Window.partitionBy("file")) - 1).alias("last"))
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) - 1
    return lines.withColumn("inside", inside).join(per, ["file", "block"]).select("file", (F.col("ahead") + F.col("inside")).alias("record"), "last", "value")


def resume(spark: SparkSession, path: str, progress: str, handlers: dict[str, Callable[[DataFrame], None]], every: int = 1000) -> int:
    """Hand the records behind the last acknowledged one to the handlers of their kinds, file by file in order; how many were handed over.

    ``every`` records of a file go to the handlers at once and are then acknowledged in the log under ``progress``, by file and
    record: a handler that fails at a record is given it again, and none of those acknowledged before. Records that can't be replayed are
    passed over, but a last line that is no JSON yet waits, since it may still be written. Handlers may see records again of
    which they did not return, so they must not mind; with ``every`` = 1 that is one record.
    """
    log = Log(spark, progress)
    log.fs.mkdirs(log.hadoop(f"{progress}/log"))
    lines, sent = numbered(spark, path), 0
    files = lines.groupBy("file").agg(F.max("record").alias("last"), F.max_by("value", "record").alias("tail"))
    files = files.select("file", F.when(F.try_parse_json("tail").isNull(), F.col("last") - 1).otherwise(F.col("last")).alias("last"))
    for name, last in sorted(tuple(r) for r in files.collect()):  # a row a file
        begin = log.state()["marks"].get(name, -1) + 1
        while begin <= last:
            end = min(begin + every - 1, last)
            good = judged(lines.where((F.col("file") == name) & F.col("record").between(begin, end)).orderBy("record")).where("verdict = 'ok'").persist()
            try:
                kinds = {r["kind"]: r["count"] for r in good.groupBy("kind").count().collect()}
                for kind, handle in handlers.items():
                    if kinds.get(kind):
                        handle(good.where(F.col("kind") == kind).select("payload"))
                        sent += kinds[kind]
            finally:
                good.unpersist()
            log.commit((name, end), [], [], log.state())
            begin = end + 1
    return sent


def dry_run(spark: SparkSession, path: str) -> dict[str, int]:
    """Verdict -> number of records; writes nothing."""
    return {r["verdict"]: r["count"] for r in judged(spark.read.text(path)).groupBy("verdict").count().collect()}
