"""BPE encoding and decoding with content-defined chunks that documents share.

1. A rolling hash over the last ``SPAN`` bytes cuts every whole text into chunks
   at places that depend on nothing but those bytes, so a passage that many
   documents hold is cut alike in all of them. Spark counts the chunks by digest.
2. A chunk that occurs more than once is encoded once: tasks emit its text the
   first time they meet it, one text per digest is encoded, and the ids are joined
   to every place that refers to the digest. What lies between shared chunks is
   encoded in place, and a text without shared chunks never leaves its task.
3. A cut may fall inside a word. At each join the stretch from the last white
   space before the cut to the first after it is encoded anew, and the result is
   compared with an encoding of a stretch one word longer on either side: the
   stretch grows until both agree exactly. Of the parts beside it, the tokens
   that the stretch covers are dropped.

Which chunks are shared is told to the tasks as a bitmap of fixed size
(``BITS``), indexed by digest. A false hit sends a chunk through the shared path
that need not take it, and changes no result.

Within a task a memo of words separated by white space spares the tokenizer
repeated words. Null text counts as empty: no ids, empty decoded text. Repeated
rows and ids are encoded like any other.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm.common import cut, ship, table
from candlewick.llm.textvec import BYTE_CODE, Texts, blocks, powers

SPAN = 16
#: Mean and least size of a chunk, in bytes.
MEAN, LEAST = 2048, 256
BITS = 1 << 25
MEMO = 300_000
_WORD = re.compile(r"[^ \t\n\r]+")
_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 13]] = True


class Encoder:
    """A tokenizer of the tokenizers library with a bounded memo of words."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        self.library.no_truncation()
        self.library.no_padding()
        self.tokens = [self.library.id_to_token(i) for i in range(self.library.get_vocab_size())]
        self.kind = np.dtype("<u2" if len(self.tokens) <= 1 << 16 else "<u4")
        self.memo: dict[str, bytes] = {}
        self.plain = self.library.decoder is None
        if not getattr(self.library.model, "end_of_word_suffix", None):
            raise ValueError("only tokenizers whose words end at white space are supported: they have an end-of-word suffix")

    def exact(self, texts: list[str]) -> list[list[int]]:
        """The library's own ids."""
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as bytes; white space always separates words, so they are looked up one by one."""
        words = [_WORD.findall(t) for t in texts]
        memo = self.memo
        new = list({w for ws in words for w in ws if w not in memo})
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = list({w for ws in words for w in ws})
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            memo.update((w, np.array(ids, self.kind).tobytes()) for w, ids in zip(part, self.exact(part), strict=True))
        return [b"".join(map(memo.__getitem__, ws)) for ws in words]

    def decode(self, ids: np.ndarray) -> str:
        """As the library's decode with skip_special_tokens=False: without a decoder, tokens joined by spaces."""
        if self.plain:
            tokens = self.tokens
            return " ".join([tokens[i] for i in ids.tolist()])
        return self.library.decode(ids.tolist(), skip_special_tokens=False)

    def digest(self, raw: bytes) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids as 32-bit integers, SHA-256 of the decoded text."""
        ids = np.frombuffer(raw, self.kind)
        return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(self.decode(ids).encode()).hexdigest()


def chunk_cuts(texts: Texts) -> list[np.ndarray]:
    """Bounds of the chunks of each text, relative to its start, both ends included."""
    data = texts.data
    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        run = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_CODE[data] * up[: len(data)], out=run[1:])
        n = max(0, len(data) - SPAN)
        roll = (run[SPAN : SPAN + n] - run[:n]) * down[:n]  # of the bytes before position i + SPAN
    at = np.flatnonzero(((roll >> np.uint64(44)) % np.uint64(MEAN) == 0) & ((data[SPAN : SPAN + n] & 0xC0) != 0x80)) + SPAN
    out = []
    lo, hi = np.searchsorted(at, texts.bounds[:-1] + SPAN), np.searchsorted(at, texts.bounds[1:] - 1, side="right")
    for i in range(texts.n):
        begin, size = int(texts.bounds[i]), int(texts.bounds[i + 1] - texts.bounds[i])
        cuts = [0]
        for c in at[lo[i] : hi[i]].tolist():
            if c - begin - cuts[-1] >= LEAST:
                cuts.append(c - begin)
        out.append(np.array([*cuts, size] if size else [0], np.int64))
    return out


def _digest(piece: bytes) -> bytes:
    return hashlib.blake2b(piece, digest_size=16).digest()


def _bit(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little") % BITS


def count_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch):
            texts = Texts(block.column("text"))
            raw = texts.data.tobytes()
            found: dict[bytes, int] = {}
            for cuts, begin in zip(chunk_cuts(texts), texts.bounds.tolist()[:-1], strict=True):
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    d = _digest(raw[begin + a : begin + b])
                    found[d] = found.get(d, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["digest", "n"])


def windows(data: np.ndarray, joins: list[int], encoder: Encoder) -> list[tuple[int, int, list[int]]]:
    """(from, to, ids) of the stretches to encode anew around ``joins``, each checked by one a word longer."""
    gaps = np.flatnonzero(_GAP[data])
    raw = data.tobytes()
    size = len(raw)

    def before(c: int) -> int:
        k = int(np.searchsorted(gaps, c))
        return int(gaps[k - 1]) + 1 if k else 0

    def after(c: int) -> int:
        k = int(np.searchsorted(gaps, c))
        return int(gaps[k]) if k < len(gaps) else size

    todo = sorted({(before(c), after(c)) for c in joins if before(c) < c < after(c)})
    done: list[tuple[int, int, list[int]]] = []
    while todo:
        wider = []
        for a, b in todo:
            a2, b2 = a, b
            while a2 > 0 and _GAP[raw[a2 - 1]]:
                a2 -= 1
            a2 = before(a2) if a2 else 0
            while b2 < size and _GAP[raw[b2]]:
                b2 += 1
            b2 = after(b2) if b2 < size else size
            wider.append((a2, b2))
        asked = [raw[x:y].decode() for (a, b), (a2, b2) in zip(todo, wider, strict=True) for x, y in ((a2, b2), (a2, a), (a, b), (b, b2))]
        got = encoder.exact(asked)
        again = []
        for i, ((a, b), w) in enumerate(zip(todo, wider, strict=True)):
            whole, left, mid, right = got[4 * i : 4 * i + 4]
            if whole == left + mid + right:
                done.append((a, b, mid))
            else:
                again.append(w)
        if not again:
            break
        # stretches that have grown into each other are one
        merged: list[tuple[int, int]] = []
        for a, b in sorted(again + [(a, b) for a, b, _ in done if any(x < b and a < y for x, y in again)]):
            if merged and a < merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        done = [d for d in done if not any(x < d[1] and d[0] < y for x, y in merged)]
        todo = merged
    return sorted(done)


PIECE = "row long, n_tokens long, ids_sha256 string, decoded_sha256 string, at int, digest binary, ids binary, lead int, trail int, patch binary, chunk binary"


def encoded(docs: DataFrame, file: str, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row of ``docs`` (id column and text).

    ``file`` is a tokenizer of the tokenizers library that every executor can
    open, with an end-of-word suffix: white space separates its words and is no part of a token.
    """
    ship(docs.sparkSession)
    counts = docs.select("text").mapInArrow(count_chunks, "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n"))
    spark = docs.sparkSession
    Encoder(file)  # refuses other tokenizers before any task starts

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique([_bit(d) for d in batch.column("digest").to_pylist()]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).astype(np.int64))], names=["word", "mask"])

    words = counts.where("n > 1").select("digest").mapInArrow(bits, "word long, mask long").groupBy("word").agg(F.expr("bit_or(mask)").alias("mask")).toArrow()
    bitmap = np.zeros(BITS // 64, np.int64)
    bitmap[words.column("word").to_numpy()] = words.column("mask").to_numpy()
    shared = spark.sparkContext.broadcast(bitmap.view(np.uint64))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, bitmap, met = Encoder(file), shared.value, set()

        def is_shared(digest: bytes) -> bool:
            at = _bit(digest)
            return bool(int(bitmap[at >> 6]) >> (at & 63) & 1)

        for batch in batches:
            for block in blocks(batch):
                texts = Texts(block.column("text"))
                raw, bounds = texts.data.tobytes(), texts.bounds.tolist()
                rows: list[tuple] = []  # of the block: position, then PIECE after row
                whole: list[int] = []
                local: list[tuple[int, str]] = []
                for i, cuts in enumerate(chunk_cuts(texts)):
                    own = raw[bounds[i] : bounds[i + 1]]
                    parts: list[list] = []  # from, to, digest
                    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                        d = _digest(own[a:b])
                        if is_shared(d):
                            parts.append([a, b, d])
                        elif parts and parts[-1][2] is None:
                            parts[-1][1] = b
                        else:
                            parts.append([a, b, None])
                    if not any(p[2] for p in parts):
                        whole.append(i)
                        continue
                    fixed = windows(texts.data[bounds[i] : bounds[i + 1]], [p[1] for p in parts[:-1]], encoder)
                    for at, (a, b, d) in enumerate(parts):
                        head = next((min(y, b) for x, y, _ in fixed if x < a < y), a)
                        tail = next((max(x, a) for x, y, _ in fixed if x < b < y and x >= a), b)
                        patch = next((ids for x, y, ids in fixed if a <= x < b < y), None)
                        if head >= b or tail <= a:
                            lead, trail = -1, 0
                        else:
                            n = [len(e) for e in encoder.exact([own[a:head].decode(), own[tail:b].decode()])]
                            lead, trail = n
                        chunk = None
                        if d is None:
                            local.append((len(rows), own[a:b].decode()))
                        elif d not in met:
                            met.add(d)
                            chunk = own[a:b]
                        rows.append((i, None, None, None, at, d, None, lead, trail, None if patch is None else np.array(patch, encoder.kind).tobytes(), chunk))
                for (k, _), ids in zip(local, encoder.encode([t for _, t in local]), strict=True):
                    rows[k] = (*rows[k][:6], ids, *rows[k][7:])
                for i, ids in zip(whole, encoder.encode([raw[bounds[i] : bounds[i + 1]].decode() for i in whole]), strict=True):
                    rows.append((i, *encoder.digest(ids), None, None, None, None, None, None, None))
                columns = list(zip(*rows, strict=True))
                at = pa.array(columns[0], pa.int64())
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([block.column("id").take(at), block.column("row").take(at), *(pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True))], names=["id", *(f.split()[0] for f in PIECE.split(", "))])

    kind = docs.schema[id_col].dataType.simpleString()
    pieces = cut(docs.select(F.col(id_col).alias("id"), "text", F.monotonically_increasing_id().alias("row")).mapInArrow(split, f"id {kind}, {PIECE}"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(file)
        for batch in batches:
            for block in blocks(batch, "text"):
                yield pa.RecordBatch.from_arrays([block.column("digest"), pa.array(encoder.encode(block.column("text").to_pylist()), pa.binary())], names=["digest", "ids"])

    once = pieces.where("chunk is not null").groupBy("digest").agg(F.first("chunk").cast("string").alias("text")).mapInArrow(encode, "digest binary, ids binary")
    parts = pieces.where("at is not null").select("row", "id", "at", "digest", F.col("ids").alias("own"), "lead", "trail", "patch").join(once, "digest", "left")
    parts = parts.select("row", "id", F.struct("at", F.coalesce("own", "ids").alias("ids"), "lead", "trail", "patch").alias("part"))
    gathered = parts.groupBy("row").agg(F.first("id").alias("id"), F.sort_array(F.collect_list("part")).alias("parts"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(file)
        width = encoder.kind.itemsize
        for batch in batches:
            got = []
            for parts in batch.column("parts").to_pylist():
                raw = b""
                for p in parts:
                    ids = p["ids"]
                    kept = b"" if p["lead"] < 0 else ids[p["lead"] * width : len(ids) - p["trail"] * width]
                    raw += kept + (p["patch"] or b"")
                got.append(encoder.digest(raw))
            n, a, b = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    repaired = gathered.select("id", "parts").mapInArrow(join, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return pieces.where("at is null").select("id", "n_tokens", "ids_sha256", "decoded_sha256").unionByName(repaired)


def op4_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` through word_bpe_49k."""
    import public_tokenizers

    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")
