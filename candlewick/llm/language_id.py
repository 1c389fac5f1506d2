"""Language identification with one bit-sliced Bloom filter for all languages.

Every slot of the filter holds a mask with one bit per language. An n-gram
(four bytes of the text, lower-cased in A-Z, with each run of non-letters as one
space) has ``HASHES`` slots; the AND of their masks names all languages whose
profile holds the n-gram. A document counts the bits of each language over its
n-grams, takes off the share that a filter filled so far would report by chance,
and the language with the largest corrected share decides.

A language's profile is every n-gram that makes up at least ``min_share`` of its
training n-grams, hence at most 1 / min_share n-grams: the filter's load, and so
its error, does not depend on the size of the corpus. The filter is an array of
``SLOTS`` masks, whose size is fixed, which is why it may be broadcast. A repeated row gets the same answer
each time it comes; texts of any length are read whole, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from candlewick.llm.common import bounded_sample, crc_mod, ship, table
from candlewick.llm.textvec import Texts, blocks, mix

SLOTS = 1 << 20
HASHES = 3
#: Longest run of documents per language that a model is fitted on.
TRAIN_DOCS = 6000
MIN_SHARE = 2e-5

_LETTER = np.zeros(256, np.uint8)
_LETTER[list(range(97, 123))] = list(range(97, 123))
_LETTER[list(range(65, 91))] = list(range(97, 123))
_LETTER[128:] = np.arange(128, 256)


def grams(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Packed 4-byte n-grams of a block and the text of each.

    Each text is taken with two spaces before and after it, so that every text
    with a letter has an n-gram.
    """
    n = texts.n
    size = np.diff(texts.bounds)
    code = np.zeros(len(texts.data) + 4 * n, np.uint8)
    place = np.arange(len(texts.data)) + 4 * np.repeat(np.arange(n), size) + 2
    code[place] = _LETTER[texts.data]
    doc = np.repeat(np.arange(n), size + 4)
    # of a run of spaces inside a text one stays, next to a text's ends two
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0)
    ends = np.cumsum(size + 4)
    keep[np.concatenate([ends - 4 - size, ends - 3 - size, ends - 2, ends - 1])] = True
    code, doc = code[keep].astype(np.uint32), doc[keep]
    if len(code) < 4:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    gram = (code[:-3] << 24) | (code[1:-2] << 16) | (code[2:-1] << 8) | code[3:]
    whole = (doc[:-3] == doc[3:]) & ((gram & 0x00FFFF00) != 0)
    return gram[whole], doc[:-3][whole]


def slots(gram: np.ndarray) -> list[np.ndarray]:
    h = mix(gram.astype(np.uint64) + np.uint64(1))
    return [((h >> np.uint64(20 * i)) & np.uint64(SLOTS - 1)).astype(np.int64) for i in range(HASHES)]


def has_letter(texts: list[str | None]) -> np.ndarray:
    return np.array([t is not None and (t[:1].isalpha() or any(map(str.isalpha, t))) for t in texts], bool)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (language, n-gram) of each batch of training rows."""
    for batch in batches:
        for block in blocks(batch):
            names, of = np.unique(np.array(block.column("lang").to_pylist(), object).astype(str), return_inverse=True)
            gram, doc = grams(Texts(block.column("text")))
            key, n = np.unique((of[doc].astype(np.uint64) << np.uint64(32)) | gram, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names[(key >> np.uint64(32)).astype(np.int64)], pa.string()),
                    pa.array((key & np.uint64(0xFFFFFFFF)).astype(np.int64)),
                    pa.array(n.astype(np.int64)),
                ],
                names=["lang", "gram", "n"],
            )


class Filter:
    """Language names, the mask words of every slot, and each language's chance of a false hit."""

    def __init__(self, langs: list[str], profile_lang: np.ndarray, profile_gram: np.ndarray):
        self.langs = langs
        self.masks = np.zeros((max(1, -(-len(langs) // 64)), SLOTS), np.uint64)
        for i in range(len(langs)):
            for s in slots(profile_gram[profile_lang == i]):
                self.masks[i // 64, s] |= np.uint64(1 << (i % 64))
        self.chance = np.array([self._bit(self.masks[i // 64], i).mean() ** HASHES for i in range(len(langs))])

    @staticmethod
    def _bit(mask: np.ndarray, i: int) -> np.ndarray:
        return (mask >> np.uint64(i % 64)) & np.uint64(1)

    def shares(self, texts: Texts) -> np.ndarray:
        """Corrected share of each text's n-grams that each language holds."""
        gram, doc = grams(texts)
        at = slots(gram)
        total = np.maximum(np.bincount(doc, minlength=texts.n), 1)
        out = np.zeros((len(self.langs), texts.n))
        for w, words in enumerate(self.masks):
            hit = words[at[0]] & words[at[1]] & words[at[2]]
            for i in range(w * 64, min(len(self.langs), w * 64 + 64)):
                seen = np.bincount(doc[self._bit(hit, i) != 0], minlength=texts.n) / total
                out[i] = np.clip((seen - self.chance[i]) / max(1e-9, 1 - self.chance[i]), 0, 1)
        return out


def fit(labelled: DataFrame, train_docs: int = TRAIN_DOCS, min_share: float = MIN_SHARE) -> Filter:
    """Fit the filter on (text, lang): about ``train_docs`` whole texts of each language.

    Rows with a null text or language teach nothing. With no rows at all the
    filter knows no language.
    """
    ship(labelled.sparkSession)
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    rows = bounded_sample(rows, "lang", train_docs, F.col("text"))
    counts = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    profile = counts.join(F.broadcast(total), "lang").where(F.col("n") >= F.col("total") * F.lit(min_share))
    got = profile.select("lang", "gram").toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    of = {x: i for i, x in enumerate(langs)}
    lang = np.array([of[x] for x in got.column("lang").to_pylist()], np.int64)
    return Filter(langs, lang, got.column("gram").to_numpy().astype(np.int64))


def predict(docs: DataFrame, model: Filter) -> DataFrame:
    """(row, lang_pred, score) of every whole text; ``row`` is the input row as a struct, so no names clash.

    ``und`` with score 0 for a text that is null or has no letter. A text whose
    n-grams no language holds gets score 0 and the first language by name, as do ties.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.langs, "und"], object)
        for batch in batches:
            for block in blocks(batch):
                share = model.shares(Texts(block.column("text")))
                best = share.argmax(0) if model.langs else np.zeros(block.num_rows, np.int64)
                score = share.max(0) if model.langs else np.zeros(block.num_rows)
                known = has_letter(block.column("text").to_pylist()) & bool(model.langs)
                yield pa.RecordBatch.from_arrays(
                    [block.column("row"), pa.array(names[np.where(known, best, len(names) - 1)], pa.string()), pa.array(np.where(known, score, 0.0))],
                    names=["row", "lang_pred", "score"],
                )

    rows = docs.select(F.struct("*").alias("row"), "text")
    schema = StructType([rows.schema["row"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.mapInArrow(run, schema)


def held_in(docs: DataFrame) -> DataFrame:
    return docs.where(~F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)))


def op3_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; rows whose crc32(doc_id) mod 3 is 1 are held out of the fitting."""
    docs = table(spark, sf_dir, "documents")
    out = predict(docs.select("doc_id", "text"), fit(held_in(docs))).select("row.doc_id", "lang_pred", "score")
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
