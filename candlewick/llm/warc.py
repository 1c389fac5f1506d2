"""WARC archives: writing with revisits, reading by verified boundary chains.

Writing: one record per page, as text files whose lines are the records' own.
Of pages with equal payloads the one with the smallest id becomes a response and the
others revisits that name it, so a payload is stored once.

Reading never takes a file as a whole; Spark deals out its byte ranges.

1. Each task goes through the lines of its range. A line that begins with the
   magic ``WARC/1.`` is a candidate, whether it starts a record or lies in a payload.
   The candidate's header, which ends at its blank line and nowhere else, gives the offset of its
   successor. Tasks emit candidates with their successors, after following those that lie in the
   same range. Of a header that its range cuts off they emit the length it has named so far, and
   every range what its leading lines add to such a header, over as many ranges as it takes.
2. The ranges' sizes, added up along each file, make the offsets absolute. From
   offset 0 of every file pointer jumping finds what is reachable: in round i a
   reached candidate reaches the one 2**i successors on. Magic in payloads is never
   anybody's successor and drops out.
3. Each task reads its range again from its first reachable record on, and takes payloads by
   length. A record that runs on into other ranges is put together from its pieces.

Null html is an empty payload, null urls are left out, line breaks in urls become spaces. A page
without an id is a response that nobody refers to. Repeated rows are written
as often as they occur; rows with equal id and payload are all responses. Records after a broken
chain (a successor that is no record) are not reachable and not returned; ``read`` warns of
files whose chain stops before their end, and ``broken`` lists them.

Windows go along one archive file and hold a row for each of its byte ranges.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import warnings
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlewick.llm.common import cut, few, shared_dir, ship, table

MAGIC = b"WARC/1."
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Byte ranges whose starting points are sent to the tasks at once; more are read in turns, each with files of its own.
RANGES = 100_000
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: 160 bits, 5 at a time."""
    hexed = F.sha1(data)
    groups = [F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 10).cast("int") for i in range(8)]
    chars = [F.substring(F.lit(_ALPHABET), F.shiftright(g, 5 * (3 - k)).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for g in groups for k in range(4)]
    return F.concat(*chars)


def _urn(page: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("/", page.cast("string"), digest))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """(record) without its last line feed, of each row of (page_id, url, html); payloads below ``least`` bytes are never revisited."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", base32_sha1(F.encode("html", "UTF-8"))).withColumn("size", F.octet_length("html").cast("long"))
    first = rows.where(F.col("size") >= least).groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # payloads stay where they are unless very many of them repeat
    rows = rows.join(few(cut(first)), ["digest", "size"], "left").withColumn("again", F.coalesce(F.col("page_id") > F.col("first"), F.lit(False)))
    eol = "\r\n"
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(eol))).otherwise("")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{eol}Content-Type: text/html; charset=utf-8{eol}Content-Length: "), F.col("size").cast("string"), F.lit(eol + eol))
    block = F.concat(http, F.when(F.col("again"), "").otherwise(F.col("html")))
    revisit = F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _urn(F.col("first"), F.col("digest"))), line("WARC-Refers-To-Page-ID", F.col("first")))
    record = F.concat(
        F.lit(f"WARC/1.1{eol}"),
        line("WARC-Type", F.when(F.col("again"), "revisit").otherwise("response")),
        line("WARC-Record-ID", _urn(F.col("page_id"), F.col("digest"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.regexp_replace("url", r"\s+", " ")),
        line("WARC-Page-ID", F.col("page_id")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(F.col("again"), revisit).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block)),
        F.lit(eol),
        block,
        F.lit(eol + "\r"),
    )
    return rows.select(record.alias("record"))


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    """Archive the pages under ``path``; the text writer ends each record with its line feed."""
    records(pages, least).write.option("lineSep", "\n").text(path)


def digits(value: str) -> bool:
    """Whether a header's content length is one."""
    return value.isascii() and value.isdigit() and len(value) < 19


def header(lines: list[bytes]) -> dict[str, str] | None:
    """Fields of a record header (names in lower case), or None if it is none."""
    out = {}
    for one in lines[1:]:
        name, colon, value = one.decode("utf-8", "replace").rstrip("\r").partition(":")
        if not colon:
            return None
        out[name.strip().lower()] = value.strip()
    return out if digits(out.get("content-length", "")) else None


def payload_row(record: bytes) -> tuple:
    """(page_id, type, refers_to, length, digest) of a whole record; a revisit's digest is the one that its header states, of the payload it refers to."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = header(head.split(b"\n"))
    block = rest[: int(fields["content-length"])]
    if fields.get("content-type", "").startswith("application/http"):
        block = block.partition(b"\r\n\r\n")[2]
    number = lambda k: int(fields[k]) if k in fields else None
    stated = fields.get("warc-payload-digest", "").rpartition(":")[2] if fields.get("warc-type") == "revisit" else ""
    return number("warc-page-id"), fields.get("warc-type"), number("warc-refers-to-page-id"), len(block), stated or base64.b32encode(hashlib.sha1(block).digest()).decode()


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select(F.col("value").cast("binary").alias("line"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, Iterator[bytes]]]:
    """The byte ranges of a task, each with its lines in order."""
    waiting: list = []

    def lines(file: int, block: int) -> Iterator[bytes]:
        while True:
            while not waiting:
                batch = next(batches, None)
                if batch is None:
                    return
                waiting.extend(reversed(list(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), batch.column("line").to_pylist(), strict=True))))
            f, b, one = waiting[-1]
            if (f, b) != (file, block):
                return
            waiting.pop()
            yield one

    while True:
        while not waiting:
            batch = next(batches, None)
            if batch is None:
                return
            waiting.extend(reversed(list(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), batch.column("line").to_pylist(), strict=True))))
        f, b, _ = waiting[-1]
        yield f, b, lines(f, b)


CANDIDATE = "file long, block long, kind string, at long, leaves long, last long, length long, names boolean"


def _named(line: bytes) -> tuple[bool, int | None]:
    """Whether a header line names the content length, and the length (None: not a number)."""
    name, _, value = line.partition(b":")
    if name.decode("utf-8", "replace").strip().lower() != "content-length":
        return False, None
    text = value.decode("utf-8", "replace").strip()
    return True, int(text) if digits(text) else None


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range: its size; its candidates (``at``) with the offset at which their chain leaves the
    range (``leaves``) and the chain's last record (``last``), all from the start of the range; the
    candidates whose headers its end cuts off, with the ``length`` named so far; and what the leading lines
    mean to a header of the range before: it ends (at ``leaves``), goes on or is none, and whether they
    name the length (``names``).

    All open headers see the same lines, so they differ only in whether a length was named since they began.
    """
    for file, block, lines in _ranges(batches):
        rows: list[tuple] = []
        pos, leading, names, named, ends = 0, "goes on", False, None, None
        known: list[int] = []
        unknown: list[int] = []
        length = 0
        found: list[tuple[int, int]] = []
        for one in lines:
            end = pos + len(one) + 1
            if leading == "goes on" or known or unknown:
                if one == b"\r":
                    found += [(at, end + length + 4) for at in known]
                    known, unknown = [], []
                    if leading == "goes on":
                        leading, ends = "ends", end
                elif b":" not in one:
                    known, unknown = [], []
                    if leading == "goes on":
                        leading = "none"
                else:
                    here, value = _named(one)
                    if here:
                        known, unknown = (known, unknown) if value is not None else (unknown, known)
                        known.extend(unknown)
                        known, unknown, length = (known, [], value) if value is not None else ([], known, 0)
                        if leading == "goes on":
                            names, named = True, value
            if one.startswith(MAGIC) and len(one) < 16:
                unknown.append(pos)
            pos = end
        follows = {at: (after, at) for at, after in found}
        cut_off = {*known, *unknown}
        for at in sorted(follows, reverse=True):  # the later ones are known already
            after, _ = follows[at]
            if after in follows:
                follows[at] = follows[after]
            elif after in cut_off:
                follows[at] = (after, at)
        rows += [("size", pos, None, None, None, None), (leading, None, ends, None, named, names)]
        rows += [("record", at, leaves, last, None, None) for at, (leaves, last) in follows.items()]
        rows += [("cut", at, pos, at, length, None) for at in known] + [("cut", at, pos, at, None, None) for at in unknown]
        kind, at, leaves, last, size, name = zip(*rows, strict=True)
        n = len(rows)
        yield pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array([block] * n), pa.array(kind), *(pa.array(c, pa.int64()) for c in (at, leaves, last, size)), pa.array(name, pa.bool_())], names=[f.split()[0] for f in CANDIDATE.split(", ")])


def _completed(cuts: DataFrame, leading: DataFrame) -> DataFrame:
    """(file, block, start, leaves, last) of the candidates whose headers run into later ranges.

    ``leading`` has (file, block, base, kind, leaves, length, names) of every range. A header ends where the
    first later range that does not just go on says so; of several lengths the last one named counts.
    """
    along = Window.partitionBy("file").orderBy("block")
    later = along.rowsBetween(1, Window.unboundedFollowing)
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = F.last(F.when(F.col("names"), F.struct("block", "length")), ignorenulls=True).over(so_far)
    stops = leading.withColumn("told", told).withColumn("stop", F.when(F.col("kind") != "goes on", F.struct("kind", (F.col("base") + F.col("leaves")).alias("ends"), "told")))
    stops = stops.select("file", "block", F.first("stop", ignorenulls=True).over(later).alias("stop"))
    out = cuts.join(stops, ["file", "block"]).where("stop.kind = 'ends'")
    size = F.when(F.col("stop.told.block") > F.col("block"), F.col("stop.told.length")).otherwise(F.col("length"))
    return out.select("file", "block", "start", (F.col("stop.ends") + size + 4).alias("leaves"), F.col("start").alias("last")).where("leaves is not null")


def chains(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, base, entry, owner, size, reached) of every range: absolute offsets of its start, of its first
    reachable record (null: none) and of the record that runs into it (null: none), and the size of its file with the offset its chain gets to."""
    seen = cut(_lines(spark, path).mapInArrow(_candidates, CANDIDATE))
    along = Window.partitionBy("file").orderBy("block")
    sizes = seen.where("kind = 'size'").select("file", "block", F.col("at").alias("size"))
    bases = cut(sizes.select("file", "block", "size", (F.sum("size").over(along) - F.col("size")).alias("base")))
    placed = seen.where("kind in ('record', 'cut')").join(bases, ["file", "block"])
    whole = placed.where("kind = 'record'").select("file", "block", (F.col("base") + F.col("at")).alias("start"), (F.col("base") + F.col("leaves")).alias("leaves"), (F.col("base") + F.col("last")).alias("last"))
    split = placed.where("kind = 'cut'").select("file", "block", (F.col("base") + F.col("at")).alias("start"), "length")
    leading = seen.where("kind in ('ends', 'goes on', 'none')").join(bases, ["file", "block"]).select("file", "block", "base", "kind", "leaves", "length", "names")
    whole = cut(whole.unionByName(_completed(split, leading)))
    reached = cut(whole.where("start = 0").select("file", "start"))
    jump = whole.select("file", "start", F.col("leaves").alias("to"))
    while True:
        there = reached.join(jump, ["file", "start"]).select("file", F.col("to").alias("start")).join(whole.select("file", "start"), ["file", "start"], "left_semi")
        new = cut(there.join(reached, ["file", "start"], "left_anti").distinct())
        if new.isEmpty():
            break
        reached = cut(reached.union(new))
        jump = cut(jump.join(jump.select("file", F.col("start").alias("to"), F.col("to").alias("far")), ["file", "to"]).select("file", "start", F.col("far").alias("to")))
    entries = whole.join(reached, ["file", "start"])
    first = entries.groupBy("file", "block").agg(F.min("start").alias("entry"))
    marks = entries.select("file", F.col("start").alias("at"), F.struct("last", "leaves").alias("runs"), F.lit(None).cast("long").alias("block"), F.lit(None).cast("long").alias("base"))
    marks = marks.unionByName(bases.select("file", F.col("base").alias("at"), F.lit(None).cast("struct<last:long,leaves:long>").alias("runs"), "block", "base"))
    # the record in progress where a range begins: of the latest entry before it, the chain's last record
    before = Window.partitionBy("file").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    owned = marks.withColumn("run", F.last("runs", ignorenulls=True).over(before)).where("block is not null")
    owned = owned.select("file", "block", "base", F.when(F.col("run.leaves") > F.col("base"), F.col("run.last")).alias("owner"))
    ends = bases.groupBy("file").agg(F.sum("size").alias("size")).join(entries.groupBy("file").agg(F.max("leaves").alias("reached")), "file", "left")
    owned = owned.join(ends, "file").join(first, ["file", "block"], "left")
    return owned.select("file", "block", "base", "entry", "owner", "size", F.coalesce("reached", F.lit(0)).cast("long").alias("reached"))


RECORD = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string"
PIECE = ", file long, start long, piece long, data binary"


def broken(where: DataFrame) -> DataFrame:
    """(file, size, reached) of the files in ``chains`` whose records do not reach to the end."""
    return where.where("reached <> size").select("file", "size", "reached").distinct()


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record_type, refers_to, payload_bytes, payload_digest) of every reachable record, of revisits the digest of an empty payload."""
    ship(spark)
    parts, lost = [], 0
    for files in _turns(spark, path):
        where = cut(chains(spark, files))
        lost += broken(where).count()
        parts.append(_read_ranges(spark, files, where))
    if lost:
        warnings.warn(f"{lost} archive files have a broken chain; records behind the break are not read", stacklevel=2)
    return reduce(DataFrame.unionByName, parts)


def _turns(spark: SparkSession, path: str) -> list[str | list[str]]:
    """The files under ``path``, dealt out so that those of a turn have about ``RANGES`` byte ranges; from their sizes alone."""
    sizes = spark.read.format("binaryFile").load(path).select("path", "length")
    span = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    ranges = F.ceil(F.col("length") / span) + 1
    if (sizes.agg(F.sum(ranges)).first()[0] or 0) <= RANGES:
        return [path]
    turns: list[list[str]] = []
    room = 0
    for file, n in sizes.select("path", ranges).collect():
        if n > room:
            turns.append([])
            room = RANGES
        turns[-1].append(file)
        room -= n
    return turns


def _read_ranges(spark: SparkSession, path: str | list[str], where: DataFrame) -> DataFrame:
    shared = spark.sparkContext.broadcast({(r["file"], r["block"]): (r["base"], r["entry"], r["owner"]) for r in where.collect()})
    names = [f.split()[0] for f in (RECORD + PIECE).split(", ")]

    def batch_of(rows: list[tuple], pieces: list[tuple]) -> pa.RecordBatch:
        full = [(*r, None, None, None, None) for r in rows] + [(None,) * 5 + p for p in pieces]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        columns = list(zip(*full, strict=True)) or [()] * 9
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, block, lines in _ranges(batches):
            base, entry, owner = shared.value.get((file, block), (0, None, None))
            pos, rows, pieces = base, [], []
            held: list[bytes] = []
            start, ends = (owner, None) if entry is None or owner is not None and entry > base else (entry, None)
            current = owner if start == owner and owner is not None else None  # a record begun in an earlier range
            for one in lines:
                if entry is not None and pos == entry:
                    if current is not None and held:
                        pieces.append((file, current, base, b"\n".join(held) + b"\n"))
                    current, held, start, ends = None, [], pos, None
                if current is not None:
                    held.append(one)
                elif entry is not None and pos >= entry:
                    if not held:
                        start, ends = pos, None
                    held.append(one)
                    if ends is None and one == b"\r":
                        fields = header(held[:-1])
                        if fields is None:
                            break
                        ends = pos + 2 + int(fields["content-length"]) + 4
                    if ends is not None and pos + len(one) + 1 >= ends:
                        rows.append(payload_row(b"\n".join(held) + b"\n"))
                        held = []
                        if len(rows) >= 500:
                            yield batch_of(rows, [])
                            rows = []
                pos += len(one) + 1
            for _ in lines:
                pass
            if held:
                pieces.append((file, current if current is not None else start, base, b"\n".join(held) + b"\n"))
            if rows or pieces:
                yield batch_of(rows, pieces)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for parts in batch.column("parts").to_pylist():
                record = b"".join(p["data"] for p in parts)
                fields = header(record.partition(b"\r\n\r\n")[0].split(b"\n"))
                if fields is not None and len(record.partition(b"\r\n\r\n")[2]) >= int(fields["content-length"]):
                    rows.append(payload_row(record))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()], strict=True)], names=names[:5])

    got = cut(_lines(spark, path).mapInArrow(run, RECORD + PIECE))
    cut_up = got.where("data is not null").groupBy("file", "start").agg(F.sort_array(F.collect_list(F.struct("piece", "data"))).alias("parts"))
    return got.where("data is null").select(*names[:5]).unionByName(cut_up.select("parts").mapInArrow(join, RECORD))


def resolved(read_back: DataFrame) -> DataFrame:
    """Records with the length and digest of the full payload: a revisit has those of the response it refers to.

    A page id may name several payloads; the digest that a revisit states tells which of them it means.
    """
    rows = cut(read_back)
    full = rows.where("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.min("payload_bytes").alias("payload_bytes"))
    revisits = rows.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "payload_digest").join(full, ["refers_to", "payload_digest"], "left")
    revisits = revisits.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return rows.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").unionByName(revisits)


def op2_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive ``pages``, then read the archives back."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "pages"), path)
    return resolved(read(spark, path))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::INT >> (5 * (3 - i % 4))::INT) & 31), 1)), '') AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM d
"""
