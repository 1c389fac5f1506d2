"""Token totals by source, language and tokenizer version, kept up by signed deltas.

A batch is a set of events: an insert adds a document's tokens to its group, a
delete takes them off, and a revision takes the old count off the old group and
adds the new count to the new one. Within a batch the signed rows are added up
by group before anything is stored, so a stored batch has as many rows as it
touches groups. Totals are the sum of all stored batches; addition does not care
about their order.

Batches are idempotent. Each is written aside and counts once the commit log names it;
committing an id that the log knows does nothing, and a batch without a log entry is not read.
``compact`` folds all committed batches into one piece, written aside and put in place by
one log entry that drops the others, so wherever it stops, the log names either all the batches or
their fold. The log writes snapshots (``sources.stores.Log``): what a commit reads of it does not grow with the batches before.

Null source, language or version is a group of its own. A null count is 0. Groups
whose documents and tokens have both come to 0 are not reported. A doc_id that
comes again is another document: events carry no ids, only counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm.common import cut, shared_dir, table
from candlewick.sources.stores import Log

GROUP = ("source", "lang", "tokenizer_version")
_DELTA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


def insert(rows: DataFrame) -> DataFrame:
    """Events that add documents: columns of GROUP and ``tokens``."""
    return rows.select(*GROUP, F.lit(1).cast("long").alias("n_docs"), F.coalesce("tokens", F.lit(0)).cast("long").alias("n_tokens"))


def delete(rows: DataFrame) -> DataFrame:
    """Events that take documents off again, with the counts they were added with."""
    return insert(rows).select(*GROUP, (-F.col("n_docs")).alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))


def revise(old: DataFrame, new: DataFrame) -> DataFrame:
    """Events that replace documents' counts, and their groups where those differ."""
    return delete(old).unionByName(insert(new))


class Rollup:
    """The totals stored under ``path``, a folder that every executor can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.log = spark, path, Log(spark, path)

    def create(self) -> Rollup:
        """Start an empty store, or leave one alone that is there."""
        self.log.fs.mkdirs(self.log.hadoop(f"{self.path}/log"))
        return self

    def pieces(self) -> list[str]:
        """The folders that hold the committed batches: as many as batches since the last compaction, and its fold."""
        return sorted(self.log.state()["pieces"])

    def commit(self, batch: str, events: DataFrame) -> bool:
        """Store a batch; False if it was committed before."""
        state = self.log.state()
        if self.log.done(batch, state):
            return False
        summed = events.groupBy(*GROUP).agg(F.sum("n_docs").cast("long").alias("n_docs"), F.sum("n_tokens").cast("long").alias("n_tokens"))
        self._put(batch, summed, [], state)
        return True

    def _put(self, batch: str, rows: DataFrame, drops: list[str], state: dict) -> None:
        data = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{data}")
        self.log.commit(batch, [(data, "all", 0)], drops, state)

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer_version, n_docs, n_tokens) over all committed batches."""
        return self._totals(self.pieces())

    def _totals(self, pieces: list[str]) -> DataFrame:
        if not pieces:
            return self.spark.createDataFrame([], _DELTA)
        rows = self.spark.read.schema(_DELTA).parquet(*(f"{self.path}/{x}" for x in pieces))
        out = rows.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return out.where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> None:
        """Fold the committed batches into one piece; one writer at a time."""
        state = self.log.state()
        if len(state["pieces"]) > 1:
            self._put(f"fold-{uuid.uuid4().hex}", self._totals(sorted(state["pieces"])), sorted(state["pieces"]), state)
            self.log.snapshot()


WORDS = r"[^\x20\x09-\x0D]+"
PIECES = r"\p{L}+|\p{N}|[^\x20\x09-\x0D\p{L}\p{N}]"


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, words, pieces, digest) of every whole text; a null text counts 0."""
    count = lambda rule: F.coalesce(F.regexp_count("text", F.lit(rule)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", "lang", count(WORDS).alias("words"), count(PIECES).alias("pieces"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


def op10_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after loading ``documents``, taking exact copies out and recounting.

    Three batches: every document with its words; deletes of the documents whose
    text a smaller doc_id has; revisions of those remaining documents whose count the second
    tokenizer version changes, from words to pieces. The second and third are delivered twice.
    Null and empty texts are one text with 0 tokens; a document without an id is no
    copy; of rows that repeat the smallest id of a text all remain. Texts of any length count whole.
    """
    docs = cut(counted(table(spark, sf_dir, "documents")))
    first = docs.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("digest", "first")
    judged = docs.join(first, "digest", "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    judged = cut(judged.select("source", "lang", "words", "pieces", "copy"))
    by_words = judged.withColumn("tokenizer_version", F.lit("words-1")).withColumn("tokens", F.col("words"))
    by_pieces = judged.withColumn("tokenizer_version", F.lit("pieces-2")).withColumn("tokens", F.col("pieces"))
    again = (~F.col("copy")) & (F.col("words") != F.col("pieces"))
    store = Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}").create()
    store.commit("load", insert(by_words))
    for _ in range(2):
        store.commit("copies", delete(by_words.where("copy")))
        store.commit("recount", revise(by_words.where(again), by_pieces.where(again)))
    return store.totals()


ORACLE = r"""
WITH d AS (
  SELECT source, lang,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
         len(regexp_extract_all(coalesce(text, ''), '\p{L}+|\p{N}|[^\x20\x09-\x0D\p{L}\p{N}]')) AS pieces,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS copy
  FROM documents),
e AS (
  SELECT source, lang, 'words-1' AS tokenizer_version, words AS tokens FROM d
  WHERE NOT copy AND words = pieces
  UNION ALL
  SELECT source, lang, 'pieces-2', pieces FROM d WHERE NOT copy AND words <> pieces)
SELECT source, lang, tokenizer_version, count(*)::BIGINT AS n_docs, sum(tokens)::BIGINT AS n_tokens
FROM e GROUP BY ALL
"""
