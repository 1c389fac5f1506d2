"""A training corpus from ``documents``: language, quality, near copies, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of ``documents``, whatever they are named.
Whole texts of any length are read everywhere, and empty tables give empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm import best_fit_packing, language_id, near_dedup, quality_classifier
from candlewick.llm.common import shared_dir, table

#: Lowest share of a text's n-grams that its language must hold.
LEAST_LANGUAGE = 0.1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those that no known language holds.

    Null and empty texts have no letter. Where two languages hold equally much of a text, it stays
    either way. Rows that repeat stay or go together; a null doc_id or lang changes nothing.
    """
    found = language_id.predict(docs, language_id.fit(docs))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE)).select("row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier, fitted on the labelled ones, rejects.

    A null text scores as an empty one. A score of exactly the threshold stays. Rows that repeat
    stay or go together; without labels of both kinds nothing can be learned and every score is that of the one kind, 0.5 without any.
    """
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.score(docs, model).where(F.col("score") >= quality_classifier.THRESHOLD).select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group that five-word shingles link at 0.8 or more.

    The smallest doc_id of a group stays, of several texts under that id the one with the smallest hash.
    Texts without words are linked with nothing and stay; rows repeated in full, id and text, count as one.
    """
    return near_dedup.one_of_each(docs, "doc_id", words=5, percent=80)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of the remaining documents, a row for each piece of a document.

    Documents without words have one row without a bin; longer ones than a sequence several.
    Rows that repeat, and null ids, are packed like all others; documents of equal size keep the order in which they come.
    """
    return best_fit_packing.packed(docs).withColumnRenamed("id", "doc_id")


STAGES = [("language ID", language), ("quality classifier", quality), ("MinHash near-dedup", near_copies), ("best-fit packing", packing)]

#: Learned models decide, which SQL can't express; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again.

    A stage's folder is deleted once its successor's is written; the last one stays, since the result reads it.
    """
    docs = table(spark, sf_dir, "documents")
    top = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{i}")
        docs = spark.read.parquet(f"{top}/{i}")
        if i:
            done = spark._jvm.org.apache.hadoop.fs.Path(f"{top}/{i - 1}")
            done.getFileSystem(spark._jsc.hadoopConfiguration()).delete(done, True)
    return STAGES[-1][1](spark, docs, sf_dir)
