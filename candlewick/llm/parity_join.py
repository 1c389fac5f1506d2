"""N-gram Jaccard join by parity sketches: exact groups of sets that overlap by ``percent``.

1. Tasks reduce every whole text to its set of word shingles. Sets of equal
   content form a class; only classes go on.
2. Sizes are cut into bands, each half as wide again as the one before. Of two linked
   sets the larger one's band holds both: a set is in its own band and
   a guest in each further one that could hold a set linked with it (the next, at 67 percent or more). In a band
   two linked sets differ in D elements at most.
3. A band's sketch XORs a bit for every element: chunk and place in it come
   from the element's hash. An element that only one of two sets has changes one
   chunk, so of D + 1 + ``SPARE`` chunks linked sets agree in ``SPARE`` + 1 at least, and
   one of those has elements unless a set leaves more than ``SPARE`` chunks empty; such
   sets also bring their empty ones. Sets that agree in a chunk meet in its bucket: no pair is lost.
   A chunk has 2**32 places, kept as the XOR of the hashes of those that are set.
4. A second sketch of four bits an element or more bounds the difference of two sets from below by its
   Hamming distance: pairs that it refutes are not compared. All others are confirmed on the full sets,
   in the rounds of pivots that ``near_dedup`` has for crowded buckets, which never list a bucket's pairs.

Nothing is missed and nothing capped. Sets whose band allows no difference (below 10 shingles
at 90 percent) are linked with equal ones only. Null or empty texts and texts without words are linked with nothing;
rows that repeat belong to one class; a null doc_id never names a component unless all of its documents have none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm.common import Tables, cut, release, ship, table
from candlewick.llm.near_dedup import grouped, named, set_keys, shingles
from candlewick.llm.textvec import Texts, blocks, mix

#: Pivots that a bucket gets, and how far from them (in 190ths of its size, at 90 percent) a member must be to wait for the next one.
TURNS, STAY = 5, 20
#: Words of 64 bits that a sketch which bounds differences has at least.
LEAST_WORDS = 4
SPARE = 1


def size_bands(most: int) -> np.ndarray:
    """First sizes of the bands, up to two beyond that of ``most``."""
    ends = [1]
    while len(ends) < 3 or ends[-3] <= most:
        ends.append(max(ends[-1] + 1, ends[-1] * 3 // 2))
    return np.array(ends, np.int64)


def parities(key: np.ndarray, of: np.ndarray, n: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of n sets given as elements and the set of each: the values, and where each set's begin (n + 1)."""
    size = np.bincount(of, minlength=n).astype(np.int64)
    ends = size_bands(int(size.max(initial=0)) * 100 // percent)
    home = np.maximum(np.searchsorted(ends, size, side="right") - 1, 0)
    values, owner = [], []
    for guest in range(len(ends)):
        band = np.minimum(home + guest, len(ends) - 2)
        allowed = 2 * (100 - percent) * (ends[band + 1] - 1) // (100 + percent)
        there = (size > 0) & ((100 * size >= percent * ends[band]) | (guest == 0)) & (band == home + guest)
        if not there.any():
            break
        there &= allowed > 0
        chunks = np.where(there, allowed + 1 + SPARE, 0)
        first = np.cumsum(chunks) - chunks
        mine = there[of]
        e, doc = key[mine], of[mine]
        with np.errstate(over="ignore"):
            e = mix(e + mix(band[doc].astype(np.uint64)))
            slot = first[doc] + ((e >> np.uint64(32)) * chunks[doc].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            parity = np.zeros(int(chunks.sum()), np.uint64)
            np.bitwise_xor.at(parity, slot, mix(e & np.uint64(0xFFFFFFFF)))
            sets = np.repeat(np.arange(n), chunks)
            number = (np.arange(len(parity)) - first[sets]).astype(np.uint64)
            value = mix(parity + mix(number + (band[sets].astype(np.uint64) << np.uint64(40))))
        empty = np.bincount(slot, minlength=len(parity)) == 0
        bare = np.bincount(sets[empty], minlength=n) > SPARE
        kept = ~empty | bare[sets]
        values.append(value[kept])
        owner.append(sets[kept])
    value, sets = np.concatenate(values or [np.zeros(0, np.uint64)]), np.concatenate(owner or [np.zeros(0, np.int64)])
    order = np.argsort(sets, kind="stable")
    return value[order].astype(np.int64), np.concatenate([[0], np.cumsum(np.bincount(sets, minlength=n))])


def bit_sketches(key: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of parity bits, and where each set's begin (n + 1); at least four bits an element.

    The Hamming distance of two sketches, the longer folded to the shorter's length, is at most the number of elements in which two sets differ.
    """
    size = np.bincount(of, minlength=n).astype(np.int64)
    words = np.full(n, LEAST_WORDS, np.int64)
    while (small := size > 16 * words).any():
        words[small] *= 2
    at = np.concatenate([[0], np.cumsum(words)])
    out = np.zeros(int(at[-1]), np.uint64)
    bit = mix(key ^ np.uint64(0x94D049BB133111EB))
    np.bitwise_xor.at(out, at[of] + ((bit >> np.uint64(6)) & (words[of] - 1).astype(np.uint64)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out.astype(np.int64), at


def sketched(docs: DataFrame, id_col: str, words: int, percent: int) -> DataFrame:
    """(id, text_key, key, n, sketch, buckets) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                texts = Texts(block.column("text"))
                key, of = shingles(texts, words)
                size, names = set_keys(key, of, texts.n)
                value, at = parities(key, of, texts.n, percent)
                bits, bits_at = bit_sketches(key, of, texts.n)
                sketch = pa.ListArray.from_arrays(bits_at.astype(np.int32), bits)
                yield pa.RecordBatch.from_arrays(
                    [block.column("id"), block.column("text_key"), pa.array(names, pa.binary()), pa.array(size.astype(np.int64)), sketch, pa.ListArray.from_arrays(at.astype(np.int32), value)],
                    names=["id", "text_key", "key", "n", "sketch", "buckets"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, f"id {kind}, text_key long, key binary, n long, sketch array<long>, buckets array<long>")


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", words: int = 5, percent: int = 80) -> DataFrame:
    """(id, text_key, n_shingles, component_id, leads) of every row of ``docs`` (id column and text), as ``near_dedup.near_groups`` returns them."""
    ship(docs.sparkSession)
    tables = Tables(docs.sparkSession)
    whole = tables.cut(sketched(docs, id_col, words, percent))
    rows = cut(whole.select("id", "text_key", "key", "n"))
    classes = whole.where("n > 0").groupBy("key").agg(named().alias("of"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("buckets").alias("buckets"))
    spread = tables.cut(classes.withColumn("num", F.monotonically_increasing_id()))
    one = cut(spread.drop("buckets"))
    tables.drop_since(0, spread)
    release(docs.sparkSession)
    return grouped(docs, id_col, words, percent, rows, one.drop("sketch"), spread.select("num", F.explode("buckets").alias("bucket")), tables, one.select("key", "sketch"), TURNS, STAY * (100 - percent) // 10)


def op13_parity_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of ``documents`` linked at 90 percent of three-word shingles."""
    out = jaccard_groups(table(spark, sf_dir, "documents"), "doc_id", 3, 90)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS e FROM w),
x AS (SELECT doc_id, len(e) AS n, unnest(e) AS one FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.one = b.one AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
g AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id, doc_id AS other FROM s UNION SELECT r.doc_id, g.b FROM r JOIN g ON r.other = g.a),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY 1)
SELECT s.doc_id, len(e)::BIGINT AS n_shingles, component_id FROM s JOIN c USING (doc_id)
"""
