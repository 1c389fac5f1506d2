"""Quality scores from learned subword embeddings.

A document is the average of the vectors of its features: its words, its pairs
of neighbouring words, the byte n-grams of its words (three and five bytes, word
ends included), and one reserved feature for a word that equals the word before
it. Features are hashed into ``BUCKETS`` vectors of ``DIM`` numbers; a softmax
over the averaged vector gives the label. Vectors and softmax are learned
together by stochastic gradient descent in numpy, on a bounded sample of the
labelled rows (``TRAIN_DOCS`` of each label); scoring covers every whole text.

The score of an average is the average of scores, so the trained model is folded
into one number per bucket before it is sent to the tasks: BUCKETS floats,
whatever the corpus. A repeated row gets the same score each time it comes, and a
labelled document that comes twice teaches twice; texts of any length are read whole, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from candlewick.llm.common import bounded_sample, crc_mod, ship, table
from candlewick.llm.textvec import BYTE_CODE, SPACE, Texts, blocks, mix, span_hash

BUCKETS = 1 << 17
DIM = 8
EPOCHS = 8
RATE = 8.0
SEED = 7
#: Bound of the sample of each label that a model is fitted on.
TRAIN_DOCS = 4000
#: Lowest score that counts as good.
THRESHOLD = 0.3


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of every feature of a block."""
    data = texts.data
    start, end, doc = texts.words()
    with np.errstate(over="ignore"):
        word = span_hash(BYTE_CODE[data], start, end)
        same = (doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, bool)
        pair = mix(word[:-1] * np.uint64(3) + word[1:])[same]
        echo = doc[1:][same & (word[1:] == word[:-1])]
        found = [(word, doc), (pair, doc[1:][same]), (np.full(len(echo), 1, np.uint64), echo)]
        # byte n-grams of words, each word with the white space (or text's end) beside it as a mark
        marked = np.where(SPACE[data], np.uint8(32), data)
        for n in (3, 5):
            if len(data) >= n:
                code = np.zeros(len(data) - n + 1, np.uint64)
                for i in range(n):
                    code = (code << np.uint64(8)) | marked[i : len(data) - n + 1 + i]
                at = np.arange(len(code))
                of = np.repeat(np.arange(texts.n), np.diff(texts.bounds))
                inner = np.zeros(len(code), bool)
                inner[:] = of[: len(code)] == of[n - 1 :]
                space = SPACE[data]
                for i in range(1, n - 1):
                    inner &= ~space[i : len(data) - n + 1 + i]
                found.append((mix(code[inner] * np.uint64(n)), of[at[inner]]))
    key = np.concatenate([f[0] for f in found])
    return (mix(key) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([f[1] for f in found])


def bags(texts: Texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets and their shares of each text."""
    bucket, doc = features(texts)
    key, n = np.unique(doc * BUCKETS + bucket, return_counts=True)
    cut = np.searchsorted(key, np.arange(texts.n + 1) * BUCKETS)
    for i in range(texts.n):
        own = slice(cut[i], cut[i + 1])
        yield key[own] % BUCKETS, n[own] / max(1, n[own].sum())


def sgd(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> np.ndarray:
    """Train, then fold: BUCKETS numbers, and the constant in the last place.

    With rows of one label only there is nothing to tell apart: every score is then that label.
    """
    if len(rows) == 0 or label.min() == label.max():
        return np.append(np.zeros(BUCKETS), 0.0 if len(rows) == 0 else (20.0 if label[0] else -20.0))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    out, bias = np.zeros((DIM, 2)), np.zeros(2)
    done, steps = 0, epochs * len(rows)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            step = rate * (1 - done / steps)
            done += 1
            at, share = rows[i]
            own = vectors[at]
            mean = share @ own
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label[i]] -= 1
            pull = out @ p
            out -= step * 0.1 * np.outer(mean, p)
            bias -= step * 0.01 * p
            vectors[at] = own - (step * share)[:, None] * pull[None, :] * min(50, len(at))
    return np.append(vectors @ (out[:, 1] - out[:, 0]), bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> np.ndarray:
    """Learn from the texts of ``docs`` (doc_id, text) that ``labels`` (doc_id, quality) marks.

    Labels other than 0 and 1, nulls included, teach nothing. About
    ``train_docs`` ids of each label are drawn before any text is read; that
    bounds the list of ids, which is broadcast, so the texts of the rest are
    never shuffled. The drawn texts become bags of buckets on the executors and
    one task trains on the bags.
    """
    ship(docs.sparkSession)
    marked = labels.where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    weight = {r[0]: r[1] for r in marked.groupBy("quality").count().collect()}
    prior = np.log(weight.get(1, 0) + 1) - np.log(weight.get(0, 0) + 1)
    drawn_ids = bounded_sample(marked, "quality", train_docs, F.col("doc_id"))
    sample = docs.select("doc_id", "text").join(F.broadcast(drawn_ids), "doc_id").select("text", "quality")

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                got = list(bags(Texts(block.column("text"))))
                yield pa.RecordBatch.from_arrays(
                    [block.column("quality"), pa.array([a.astype(np.int32).tobytes() for a, _ in got], pa.binary()), pa.array([s.astype(np.float32).tobytes() for _, s in got], pa.binary())],
                    names=["quality", "at", "share"],
                )

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, label = [], []
        for b in batches:
            label += b.column("quality").to_pylist()
            rows += zip(b.column("at").to_pylist(), b.column("share").to_pylist(), strict=True)
        order = sorted(range(len(rows)), key=lambda i: (label[i], rows[i]))  # the same whatever order the rows came in
        model = sgd([(np.frombuffer(rows[i][0], np.int32), np.frombuffer(rows[i][1], np.float32)) for i in order], np.array([label[i] for i in order], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([model.astype(np.float64).tobytes()], pa.binary())], names=["model"])

    trained = sample.mapInArrow(bag, "quality int, at binary, share binary").repartition(1).mapInArrow(train, "model binary")
    model = np.frombuffer(trained.head()[0], np.float64).copy()
    drawn = min(train_docs, weight.get(1, 0)), min(train_docs, weight.get(0, 0))
    model[-1] += prior - (np.log(drawn[0] + 1) - np.log(drawn[1] + 1))  # the sample evens out the labels
    return model


def score(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """(row, score) of every whole text; ``row`` is the input row as a struct. A null text scores as an empty one."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for block in blocks(batch):
                texts = Texts(block.column("text"))
                bucket, doc = features(texts)
                total = np.bincount(doc, weights=model[bucket], minlength=texts.n)
                z = total / np.maximum(1, np.bincount(doc, minlength=texts.n)) + model[-1]
                yield pa.RecordBatch.from_arrays([block.column("row"), pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))))], names=["row", "score"])

    rows = docs.select(F.struct("*").alias("row"), "text")
    return rows.mapInArrow(run, StructType([rows.schema["row"], StructField("score", DoubleType())]))


def held_in(labels: DataFrame) -> DataFrame:
    return labels.where(~F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(True)))


def op7_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; rows whose crc32(doc_id) mod 5 is 0 are held out of the fitting."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, held_in(table(spark, sf_dir, "labels")))
    out = score(docs.select("doc_id", "text"), model).select("row.doc_id", "score")
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
