"""Near-duplicate groups by SuperMinHash, banding, exact confirmation and components.

1. Tasks reduce every whole text to its set of word shingles, an order-free
   128-bit key of that set, a SuperMinHash signature and the signature's bands.
   Documents with equal sets form a class; only classes go on.
2. Classes that share a band value form a bucket. A bucket never lists its
   pairs. Its most popular class is its pivot; every member is compared with the
   pivot on the full sets, and links are merged. What a bucket holds of several
   components is compared by its members' differences from the pivot: in a group
   of near copies those are short and seldom shared, so elements that few
   members have in common name the few pairs that can still be linked, and
   counts and parity bits refute the rest without listing them. Members too far from their
   pivot get a second one, then are compared by their own rarest elements.
   Whatever these lists of rare elements hold is met by pivots in rounds until
   every pair is confirmed, refuted or already connected. Nothing is capped, and
   only the bands can miss a link.
3. Components are found by contraction (``components``).

SuperMinHash: an element's values for the M places are j + r_j in the order of a
random permutation of the places, so one pass over j gives every place one
candidate. Once all places of a text are below j + 1, no later j can lower
one, and the text's elements stop there.

Null or empty texts and texts without words are linked with nothing. Rows with
the same text belong to one class, repeated rows included; a null doc_id never
becomes a component's name unless all of its documents have none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm.common import Tables, few, release, ship, table
from candlewick.llm.common import cut as checkpointed
from candlewick.llm.components import components
from candlewick.llm.textvec import BYTE_CODE, Texts, blocks, mix, span_hash

ROWS = 5
PLACES = 32 * ROWS
#: Pivots that a band's bucket gets, one a turn, before its members are compared by their own rarest elements.
TURNS = 2
#: Pivots of a list of rare elements by round.
PIVOTS = (64, 256, 1024)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(texts: Texts, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a block, in order of (text, hash), and the text of each."""
    start, end, doc = texts.words()
    word = span_hash(BYTE_CODE[_LOWER[texts.data]], start, end)
    with np.errstate(over="ignore"):
        count = max(0, len(word) - words + 1)
        key = np.zeros(count, np.uint64)
        for i in range(words):
            key = mix(key * np.uint64(0xD6E8FEB86659FD93) + word[i : i + count])
        whole = np.flatnonzero(doc[:count] == doc[words - 1 :]) if count else np.zeros(0, np.int64)
        key, of = key[whole], doc[whole]
        # texts with fewer words: the whole sequence
        n = np.bincount(doc, minlength=texts.n)
        first = np.cumsum(n) - n
        for k in range(1, words):
            at = np.flatnonzero(n == k)
            short = np.full(len(at), k, np.uint64)
            for i in range(k):
                short = mix(short * np.uint64(0xD6E8FEB86659FD93) + word[first[at] + i] + np.uint64(k))
            key, of = np.concatenate([key, short]), np.concatenate([of, at])
    order = np.argsort(key)
    order = order[np.argsort(of[order], kind="stable")]
    key, of = key[order], of[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
    return key[new], of[new]


def superminhash(key: np.ndarray, of: np.ndarray, n: int, places: int = PLACES) -> np.ndarray:
    """Signatures (n x places) of n sets given as elements and the set of each.

    The upper 32 bits of a value are j, the lower r_j.
    """
    sig = np.full((n, places), np.iinfo(np.uint64).max, np.uint64)
    alive = np.arange(len(key))
    perm = None
    with np.errstate(over="ignore"):
        for j in range(places):
            if not len(alive):
                break
            draw = mix(key[alive] + np.uint64(j + 1) * np.uint64(0x9E3779B97F4A7C15))
            value = (draw >> np.uint64(32)) | np.uint64(j << 32)
            k = j + ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(places - j) >> np.uint64(32)).astype(np.int64)
            if perm is None:
                place = k
            else:
                row = np.arange(len(alive))
                place = perm[row, k].astype(np.int64)
                perm[row, k], perm[row, j] = perm[row, j], place
            np.minimum.at(sig.reshape(-1), of[alive] * places + place, value)
            open_ = (sig >= np.uint64((j + 1) << 32)).any(axis=1)
            go = open_[of[alive]]
            if perm is None:
                perm = np.tile(np.arange(places, dtype=np.uint16), (int(go.sum()), 1))
                row = np.arange(len(perm))
                perm[row, k[go]], perm[row, 0] = 0, k[go]
            else:
                perm = perm[go]
            alive = alive[go]
    return sig


def band_values(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.zeros((len(sig), sig.shape[1] // rows), np.uint64)
        for i in range(rows):
            out = mix(out * np.uint64(31) + sig[:, i::rows][:, : out.shape[1]])
        return mix(out + np.arange(out.shape[1], dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)).astype(np.int64)


def set_keys(key: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, list[bytes]]:
    """Size and 128-bit order-free key of each set."""
    size = np.bincount(of, minlength=n)
    at = np.concatenate([[0], np.cumsum(size)])
    with np.errstate(over="ignore"):
        parts = []
        for salt in (0x632BE59BD9B4E019, 0x9FB21C651E98DF25):
            run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(key ^ np.uint64(salt)))])
            parts.append(mix(run[at[1:]] - run[at[:-1]] + size.astype(np.uint64)))
    both = np.stack(parts, 1)
    return size, [x.tobytes() for x in both]


def classes_of(docs: DataFrame, id_col: str, words: int, places: int) -> DataFrame:
    """(id, text_key, key, n, bands) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                texts = Texts(block.column("text"))
                key, of = shingles(texts, words)
                size, names = set_keys(key, of, texts.n)
                values = band_values(superminhash(key, of, texts.n, places)).reshape(-1)
                yield pa.RecordBatch.from_arrays(
                    [block.column("id"), block.column("text_key"), pa.array(names, pa.binary()), pa.array(size.astype(np.int64)), pa.ListArray.from_arrays(np.arange(texts.n + 1, dtype=np.int32) * (places // ROWS), values)],
                    names=["id", "text_key", "key", "n", "bands"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, f"id {kind}, text_key long, key binary, n long, bands array<long>")


def sets_of(docs: DataFrame, id_col: str, wanted: DataFrame, words: int, cut) -> DataFrame:
    """(key, elements) for the classes in ``wanted`` (id, text_key, key), from one text of each."""
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64("text").alias("text_key"), "text")
    own = own.join(few(wanted.toDF("_id", "_text_key", "key")), F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_text_key"))).select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                texts = Texts(block.column("text"))
                key, of = shingles(texts, words)
                size, names = set_keys(key, of, texts.n)
                at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                same = pa.array([a == b for a, b in zip(names, block.column("key").to_pylist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([block.column("key"), pa.ListArray.from_arrays(at, key.astype(np.int64))], names=["key", "elements"]).filter(same)

    found = cut(own.mapInArrow(run, "key binary, elements array<long>"))
    # only rows repeated in full, id and text, give a class's set twice
    twice = not found.groupBy("key").count().where("count > 1").isEmpty()
    return cut(found.dropDuplicates(["key"])) if twice else found


def with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (p, m and more) with the elements of both, ``sp`` and ``sm``.

    Only the sets that the pairs name are moved. The sets of the pivots p, few
    in most rounds, are sent to the pairs if they are small (8 MB, about what Spark sends by default); else both sides are shuffled.
    """
    own = sets.join(few(pairs.select(F.col("m").alias("key")).distinct()), "key", "left_semi").toDF("m", "sm")
    pivots = sets.join(few(pairs.select(F.col("p").alias("key")).distinct()), "key", "left_semi").toDF("p", "sp")
    return pairs.join(own, "m").join(few(pivots, F.size("sp"), 1_000_000), "p")


def linked(d: Column | str, n: Column, percent: int) -> Column:
    """Whether ``d`` elements in one set only, of ``n`` in both sets together, leave 100 * intersection >= percent * union."""
    return (100 + percent) * (F.col(d) if isinstance(d, str) else d) <= (100 - percent) * n


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (p, m) whose full sets are linked."""
    common = F.size(F.array_intersect("sp", "sm"))
    return with_sets(pairs, sets).where(100 * common >= percent * (F.size("sp") + F.size("sm") - common)).select(*pairs.columns)


def relabelled(labels: DataFrame | None, ends: DataFrame, cut) -> DataFrame | None:
    """Labels (node, comp) after the links ``ends`` (a, b) between components; a node without a row is its own component."""
    ends = cut(ends.where("a <> b").distinct())
    if ends.isEmpty():
        return labels
    new = components(ends, cut)
    if labels is None:
        return new
    moved = labels.join(new.toDF("comp", "to"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    return cut(moved.union(new.join(labels, "node", "left_anti").select("node", "comp")))


def labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``members`` with the component of their key."""
    if labels is None:
        return members.withColumn("comp", F.col("key"))
    return members.join(few(labels.toDF("key", "_comp")), "key", "left").withColumn("comp", F.coalesce("_comp", "key")).drop("_comp")


def reach(members: DataFrame, by: str, percent: int) -> DataFrame:
    """``members`` that may still be linked to another component of their group ``by``.

    ``d`` counts a member's elements and ``f`` = 2 * (those that nobody else has) - d.
    What two members share is at most d - (f + d) / 2 of either, so a link needs
    f of the one plus d of the other to be within the difference that a link allows.
    Three minima a group, pre-aggregated, tell who meets that with nobody.
    """
    f, d = ((100 + percent) * F.col(c) - (100 - percent) * F.col("n") for c in "fd")
    group = members.groupBy(by).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(f).alias("least_f"), F.min(d).alias("least_d")).where("lo <> hi")
    return members.join(group, by).where((d + F.col("least_f") <= 0) & (f + F.col("least_d") <= 0)).select(*members.columns)


def parity_words(elements: str) -> list[Column]:
    """``w0`` and ``w1``: 128 parity bits of an array of hashes. Two arrays' words differ in no more bits than the arrays in elements."""
    bit = lambda e: F.call_function("shiftleft", F.lit(1).cast("long"), e.bitwiseAND(F.lit(63)).cast("int"))
    word = lambda i: F.aggregate(elements, F.lit(0).cast("long"), lambda x, e: F.when(F.shiftright(e, 6).bitwiseAND(F.lit(1)) == i, x.bitwiseXOR(bit(e))).otherwise(x))
    return [word(i).alias(f"w{i}") for i in (0, 1)]


def postings(members: DataFrame, percent: int, cut) -> DataFrame:
    """(bucket, key, n, d, f, w0, w1) of ``members`` (space, key, n, comp, d, least, elements), one row per rare element.

    A space compares its members by the difference of their elements from the
    space's pivot, or by the elements themselves (no pivot): both leave what two
    members differ in unchanged. ``least`` elements at least are common to a
    member and whatever it links to, so of two linked members each holds one of
    the other's d - least + 1 rarest, by any order of rarity that both use.
    Elements that nobody else in the space has are rarest; they fill places and make no bucket.
    ``w0`` and ``w1`` are parity bits of a member's elements. Spaces of one component are left out; elements are listed once.
    """
    several = members.groupBy("space").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("space")
    members = members.join(few(several), "space", "left_semi")
    own = cut(members.select("space", "key", F.explode("elements").alias("e")).select("space", "key", F.xxhash64("space", "e").alias("bucket")))
    often = own.groupBy("bucket").agg(F.count("*").alias("often")).where("often > 1")
    ranked = own.join(often, "bucket").groupBy("space", "key").agg(F.sort_array(F.collect_list(F.struct("often", "bucket"))).alias("shared"))
    ranked = cut(ranked.join(members.select("*", *parity_words("elements")).drop("elements"), ["space", "key"]).withColumn("f", F.col("d") - 2 * F.size("shared")))
    places = F.col("d") - F.col("least") + 1 - (F.col("d") - F.size("shared"))
    first = F.when(places > 0, F.slice("shared", F.lit(1), F.greatest(places, F.lit(1)).cast("int")))
    return reach(ranked, "space", percent).select("key", "n", "d", "f", "w0", "w1", F.explode(first).alias("one")).select(F.col("one.bucket").alias("bucket"), "key", "n", "d", "f", "w0", "w1")


def near_groups(docs: DataFrame, id_col: str = "doc_id", words: int = 5, percent: int = 80, places: int = PLACES) -> DataFrame:
    """(id, text_key, n_shingles, component_id, leads) of every row of ``docs`` (id column and text).

    component_id is the smallest id that can be reached over links of at least
    ``percent`` of the union; ``leads`` marks the row that stands for its
    component: that id, and of its texts the one with the smallest text_key
    (xxhash64). A pair with similarity s shares a band with probability
    1 - (1 - s**5)**(places/5): all but 3 in a million at 0.8 and 160 places, and
    but 0.8 in a million at 0.85 and 120 places. Every later step is exact.
    """
    ship(docs.sparkSession)
    tables = Tables(docs.sparkSession)
    whole = tables.cut(classes_of(docs, id_col, words, places))
    banded = tables.cut(whole.where("n > 0").groupBy("key").agg(named().alias("of"), F.first("n").alias("n"), F.first("bands").alias("bands")).withColumn("num", F.monotonically_increasing_id()))
    rows, one = checkpointed(whole.drop("bands")), checkpointed(banded.drop("bands"))
    tables.drop_since(0, banded)
    return grouped(docs, id_col, words, percent, rows, one, banded.select("num", F.explode("bands").alias("bucket")), tables)


def named() -> Column:
    """What stands for a class: its smallest id that is not null, and of that id's texts the one with the smallest text_key."""
    return F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "text_key"))


def bits_apart(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """``pairs`` (p, np, m, n and more) with ``apart``, a lower bound of the elements that only one of the two has.

    It is the bits in which their sketches (key, sketch) differ, the longer of two folded to the shorter's length, or the difference of the sizes.
    """
    half = lambda c: (F.size(c) / 2).cast("int")
    folded = lambda c: F.zip_with(F.slice(c, 1, half(c)), F.slice(c, half(c) + 1, half(c)), lambda x, y: x.bitwiseXOR(y))
    # sketches that differ more than four times in length: the sizes differ by more than half of the two together
    fit = lambda c, other: F.when(F.size(c) == 2 * F.size(other), folded(c)).when(F.size(c) == 4 * F.size(other), folded(folded(F.col(c)))).otherwise(F.col(c))
    differ = F.aggregate(F.zip_with(fit("_a", "_b"), fit("_b", "_a"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    same = (F.size("_a") <= 4 * F.size("_b")) & (F.size("_b") <= 4 * F.size("_a"))
    # only the sketches that the pairs name are moved
    own = lambda side, name: sketches.join(few(pairs.select(F.col(side).alias("key")).distinct()), "key", "left_semi").toDF(side, name)
    both = pairs.join(own("p", "_a"), "p").join(own("m", "_b"), "m")
    return both.withColumn("apart", F.greatest(F.abs(F.col("n") - F.col("np")), F.when(same, differ).otherwise(0)).cast("long")).drop("_a", "_b")


def grouped(docs: DataFrame, id_col: str, words: int, percent: int, rows: DataFrame, one: DataFrame, spread: DataFrame, tables: Tables, sketches: DataFrame | None = None, turns: int = TURNS, stay: int | None = None) -> DataFrame:
    """The groups that ``near_groups`` returns, from buckets in which every linked pair meets or is lost.

    rows: (id, text_key, key, n) of every document; one: (num, key, of, n) of every class; spread: (num, bucket),
    where num is a class's number: of the long table of buckets only numbers, which compress, are shuffled.
    What ``tables`` holds, ``spread`` is read from it, is deleted once it has been read, as are the tables of the rounds.
    ``sketches`` (key, sketch) may bound differences from below: pairs that they refute are not compared on full sets.
    A member that differs from its pivot in more than ``stay`` / (100 + percent) of its size stays in the bucket for the next of the ``turns``.
    """
    stay = 3 * percent - 100 if stay is None else stay
    # two linked members are both compared by their differences from the pivot, or both stay: these differ by no more than a link allows
    near_by = -(-(stay + 100 - percent) * 100 // percent) + 100 - percent
    cut = tables.cut
    crowded = cut(spread.join(spread.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "bucket"))
    weight = cut(crowded.groupBy("num").agg(F.sum("size").alias("weight")).join(one.select("num", "key", "n"), "num"))
    members = cut(crowded.join(weight, "num").select("bucket", "key", "n", "weight"))
    tables.drop_since(0, members, weight)
    if sketches is not None:
        sketches = cut(sketches.join(few(weight.select("key")), "key", "left_semi"))
    sets = sets_of(docs, id_col, one.join(weight, "key", "left_semi").select("of.id", "of.text_key", "key"), words, cut)
    labels, dealt = None, []
    for _ in range(turns):
        mark = len(tables.made)
        # one pivot a bucket, the class that meets the most others, so that a group's buckets share theirs
        pivots = members.groupBy("bucket").agg(F.max(F.struct("weight", "key", "n")).alias("p"))
        seated = cut(members.join(pivots, "bucket").where("p.key <> key").select("bucket", "key", "n", "weight", F.col("p.key").alias("p"), F.col("p.n").alias("np")))
        if seated.isEmpty():
            break
        pairs = cut(seated.select("p", "np", F.col("key").alias("m"), "n").distinct())
        far = None
        if sketches is not None:
            told = cut(bits_apart(pairs, sketches).withColumn("far", (100 + percent) * F.col("apart") > near_by * F.col("n")))
            pairs, far = told.where("not far").select(*pairs.columns), told.where("far").select("p", F.col("m").alias("key"), F.col("apart").alias("d"), F.lit(False).alias("hit"))
        # the sets are moved once: what the near ones differ in is kept
        met = with_sets(pairs, sets).select("p", F.col("m").alias("key"), "n", "np", F.concat(F.array_except("sm", "sp"), F.array_except("sp", "sm")).alias("elements"))
        met = met.withColumn("d", F.size("elements").cast("long")).select("p", "key", "d", linked("d", F.col("n") + F.col("np"), percent).alias("hit"), F.when((100 + percent) * F.col("d") <= near_by * F.col("n"), F.col("elements")).alias("elements"))
        met = cut(met if far is None else met.unionByName(far, allowMissingColumns=True))
        told = met.drop("elements")
        hits = met.where("hit").select(F.col("p").alias("a"), F.col("key").alias("b"))
        labels = relabelled(labels, labelled(labelled(hits.withColumnRenamed("a", "key"), labels).select(F.col("comp").alias("a"), F.col("b").alias("key")), labels).select("a", F.col("comp").alias("b")), cut)
        seated = labelled(seated, labels)
        mixed = seated.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
        seated = cut(seated.join(mixed, "bucket").join(told, ["p", "key"]))
        # who is near its pivot is compared there, who is not stays in the bucket, who is between does both
        near = seated.where((100 + percent) * F.col("d") <= near_by * F.col("n")).select("p", "np", "key", "n", "comp", "d", "hit").distinct()
        members = cut(seated.where((100 + percent) * F.col("d") > stay * F.col("n")).select("bucket", "key", "n", "weight"))
        sizes = (100 - percent) * (F.col("n") + F.col("np"))
        apart = F.greatest(F.lit(1), F.ceil(((100 + percent) * F.col("d") - sizes) / 200))
        close = F.floor(((100 + percent) * F.col("d") + (100 - percent) * (F.col("np") - F.col("n"))) / (2 * (100 + percent))) + 1
        space = cut(near).join(met.select("p", "key", "elements"), ["p", "key"]).select(
            F.col("p").alias("space"), "key", "n", "comp", "d",
            F.when(F.col("hit"), close).otherwise(apart).alias("least"),
            "elements",
        )
        dealt.append(cut(postings(cut(space), percent, cut)))
        members = cut(members)
        tables.drop_since(mark, members, labels, dealt[-1])
        release(docs.sparkSession)
    if turns > TURNS:  # most buckets have one member left by now, or one component
        members = labelled(members, labels)
        several = members.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
        members = members.join(several, "bucket", "left_semi")
    left = labelled(members.groupBy("key").agg(F.first("n").alias("n")), labels)
    own = sets.join(few(left), "key").select(F.lit(b"").alias("space"), "key", "n", "comp", F.col("n").alias("d"), F.ceil(F.col("n") * percent / 100).alias("least"), "elements")
    dealt.append(postings(cut(own), percent, cut))
    members = cut(reduce(DataFrame.union, dealt))
    turn = 0
    while True:
        mark = len(tables.made)
        members = cut(reach(labelled(members.select("bucket", "key", "n", "d", "f", "w0", "w1"), labels), "bucket", percent))
        if members.isEmpty():
            break
        width = PIVOTS[min(turn, len(PIVOTS) - 1)]
        turn += 1
        pivots = members.groupBy("bucket", F.pmod(F.hash("key"), F.lit(width)).alias("slot")).agg(F.min(F.struct("key", "n", "comp", "d", "f", "w0", "w1")).alias("p"))
        may = (F.col("p.comp") != F.col("comp")) & (100 * F.least("n", "p.n") >= percent * F.greatest("n", "p.n"))
        may = may & linked(F.col("f") + F.col("p.d"), F.col("n") + F.col("p.n"), percent) & linked(F.col("d") + F.col("p.f"), F.col("n") + F.col("p.n"), percent)
        # the bits in which two members' words differ refute most pairs before they are listed
        may = may & linked(sum(F.bit_count(F.col(w).bitwiseXOR(F.col(f"p.{w}"))) for w in ("w0", "w1")), F.col("n") + F.col("p.n"), percent)
        met = members.join(pivots.select("bucket", "p"), "bucket").where(may)
        pairs = met.select(F.col("p.key").alias("p"), F.col("key").alias("m"), F.col("p.comp").alias("cp"), F.col("comp").alias("cm"), F.col("p.n").alias("np"), "n").distinct()
        pairs = cut(pairs)
        if sketches is not None:
            pairs = cut(bits_apart(pairs, sketches).where(linked("apart", F.col("n") + F.col("np"), percent)).drop("apart"))
        found = confirmed(pairs, sets, percent).select(F.col("cp").alias("a"), F.col("cm").alias("b"))
        labels = relabelled(labels, found, cut)
        members = members.join(pivots.select("bucket", F.col("p.key").alias("key")), ["bucket", "key"], "left_anti")
        members = cut(members)
        tables.drop_since(mark, members, labels)
        release(docs.sparkSession)
    labels = None if labels is None else checkpointed(labels)
    tables.drop()
    if labels is None:
        found = one.select("key", F.col("of").alias("lead"))
    else:
        own = one.select("key", "of").join(labels.withColumnRenamed("node", "key"), "key", "left")
        lowest = own.where("comp is not null").groupBy("comp").agg(F.min("of").alias("lead"))
        found = own.join(lowest, "comp", "left").select("key", F.coalesce("lead", "of").alias("lead"))
    out = rows.select("id", "text_key", "key", "n").join(found, "key", "left")
    alone = F.col("n") == 0
    return out.select(
        "id",
        "text_key",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("id")).otherwise(F.col("lead.id")).alias("component_id"),
        (alone | (F.col("id").eqNullSafe(F.col("lead.id")) & (F.col("text_key") == F.col("lead.text_key")))).alias("leads"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that lead their component, with all their columns.

    Rows repeated in full, id and text alike, count as one document.
    """
    chosen = near_groups(docs, id_col, words, percent).where("leads").select(F.col("id").alias("_lead_id"), F.col("text_key").alias("_lead_key")).distinct()
    whole = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("_id"), F.xxhash64("text").alias("_key"))
    kept = whole.join(chosen, F.col("_id").eqNullSafe(F.col("_lead_id")) & (F.col("_key") == F.col("_lead_key")), "left_semi")
    return kept.dropDuplicates(["_id", "_key"]).select("row.*")


def op9_superminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of ``documents``: three-word shingles, 85 percent.

    24 bands of 5 places: a pair at exactly 85 percent shares a band but for 0.8 in a million.
    """
    out = near_groups(table(spark, sf_dir, "documents"), "doc_id", 3, 85, 24 * ROWS)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS e FROM w),
x AS (SELECT doc_id, len(e) AS n, unnest(e) AS one FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.one = b.one AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
g AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id, doc_id AS other FROM s UNION SELECT r.doc_id, g.b FROM r JOIN g ON r.other = g.a),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY 1)
SELECT s.doc_id, len(e)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""
