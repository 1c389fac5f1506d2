"""Exact hard-negative mining over Hilbert-ordered blocks with zone maps.

1. A task turns vectors into integers floor(256 x) and gives each row its place on
   a Hilbert curve through the dimensions that vary most. Rows are written as
   Parquet, dealt by ranges of (label, place, hash of the id) into blocks of about
   ``BLOCK_ROWS`` rows, a folder each, 4096 blocks at most: beyond 4 million rows the
   blocks grow, not their number.
2. A zone map holds the smallest and largest value of every dimension, and of
   the label, in each block (``ZONE_BYTES`` at most, so it may be sent to all tasks).
   For an anchor q interval arithmetic bounds every product with a block's
   rows: from sum min(q_i lo_i, q_i hi_i) to sum max(q_i lo_i, q_i hi_i).
3. Positives: an anchor's own block gives its k-th best so far; only blocks that hold
   its label and whose upper bound reaches that are read for it.
4. Negatives: each positive opens a window of scores. The blocks whose
   bounds lie nearest to the windows' upper ends are read first and give each
   window its tenth best so far; then only blocks whose bounds meet a window between
   that score and the window's upper end.
5. The anchors sent to a block are dealt into lots and a large block into parts;
   each lot and part is one matrix product. Parquet folders that no anchor
   asks for are not read.

Scores are exact integers, ties go to the smaller id. Rows with a null id, label or vector, or
with an entry that is null, non-finite or 16384 and more in size (whose products a long need not hold), take
no part; vectors of different lengths are not compared. Rows repeated in full
(id, label and vector) count once; no row with the anchor's id is among its positives or negatives.
Rows of one id with different vectors or labels are anchors of their own, whose lists all carry that id.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlewick.llm.common import cut, dropped, shared_dir, ship, table
from candlewick.llm.knn_join import products
from candlewick.llm.textvec import mix
from candlewick.llm.vectors import matrices

SCALE = 256
LIMIT = 2.0**22 / SCALE
BLOCK_ROWS, BLOCKS, ZONE_BYTES = 1024, 4096, 16_000_000
PART = 8192
"""Rows of a block, or anchors sent to one, that are multiplied at once."""
CURVE = 12
"""Dimensions of the Hilbert curve at most."""
FIRST = 4
"""Blocks that an anchor's windows read before the others."""


def hilbert_places(grid: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of a matrix of coordinates below 2**bits (Skilling, 2004)."""
    x = [c.astype(np.int64) for c in grid.T]
    for level in range(bits - 1, 0, -1):
        below = (1 << level) - 1
        for i in range(len(x)):
            far = (x[i] >> level & 1).astype(bool)
            swap = np.where(far, 0, (x[0] ^ x[i]) & below)
            x[0] = x[0] ^ np.where(far, below, swap)
            x[i] = x[i] ^ swap if i else x[0]
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros(len(grid), np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> level & 1, (1 << level) - 1, 0)
    place = np.zeros(len(grid), np.int64)
    for level in range(bits - 1, -1, -1):
        for c in x:
            place = place << 1 | ((c ^ flip) >> level & 1)
    return place


def _integers(entries: np.ndarray) -> np.ndarray:
    return np.floor(entries * SCALE).astype(np.int32)


def _row_hash(label: np.ndarray, x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = mix(label.astype(np.uint64))
        for column in x.T:
            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + column.astype(np.uint64))
    return h.astype(np.int64)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _spread(rows: DataFrame) -> dict[int, pd.DataFrame]:
    """Length of vectors -> n, least, most and variance of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, entries in matrices(batch, "v", LIMIT):
                x = _integers(entries).astype(np.float64)
                n, dims = x.shape
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(dims, dims, np.int32)), pa.array(np.arange(dims, dtype=np.int32)), pa.array(np.full(dims, n, np.int64)), *(pa.array(c) for c in (x.min(axis=0), x.max(axis=0), x.sum(axis=0), (x * x).sum(axis=0)))],
                    names=["dims", "j", "n", "lo", "hi", "s", "ss"],
                )

    found = rows.mapInArrow(run, "dims int, j int, n long, lo double, hi double, s double, ss double").groupBy("dims", "j")
    found = found.agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).toPandas()
    return {int(d): own.sort_values("j").assign(var=own["ss"] / own["n"] - (own["s"] / own["n"]) ** 2) for d, own in found.groupby("dims")}


def write_blocks(rows: DataFrame, dims: int, spread: pd.DataFrame, path: str, block_rows: int = BLOCK_ROWS) -> None:
    """Write the rows (id, label, v) of one length as Hilbert-ordered blocks (id, label, own, x) by ``block``."""
    chosen = np.sort(spread["var"].to_numpy().argsort(kind="stable")[::-1][:CURVE])
    lo, hi = (spread[c].to_numpy()[chosen] for c in ("lo", "hi"))
    bits = min(16, 62 // len(chosen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, entries in matrices(batch, "v", LIMIT):
                if entries.shape[1] != dims:
                    continue
                x = _integers(entries)
                ids, label = (batch.column(c).take(pa.array(at)).to_numpy(zero_copy_only=False) for c in ("id", "label"))
                own = _row_hash(label, x)
                one = np.unique(np.stack([ids, own], 1), axis=0, return_index=True)[1]  # a row that repeats is sent on once
                ids, label, own, x = ids[one], label[one], own[one], x[one]
                place = hilbert_places(((x[:, chosen] - lo) / (hi - lo + 1) * (1 << bits)).astype(np.int64), bits)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(label), pa.array(own), pa.array(place), _lists(x)], names=["id", "label", "own", "place", "x"])

    wanted = int(min(BLOCKS, max(1, ZONE_BYTES // (8 * dims)), max(1, -(-int(spread["n"].iloc[0]) // block_rows))))
    dealt = rows.mapInArrow(run, "id long, label long, own long, place long, x array<int>").repartitionByRange(wanted, "label", "place", F.xxhash64("id"))
    dealt.withColumn("block", F.spark_partition_id()).sortWithinPartitions("block", "label", "place").drop("place").write.partitionBy("block").parquet(path)


class Zones:
    """The zone map: arrays with an entry a block."""

    def __init__(self, blocks: DataFrame):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                block, label = (batch.column(c).to_numpy() for c in ("block", "label"))
                x = batch.column("x").flatten().to_numpy().reshape(len(block), -1)
                for b in np.unique(block):
                    own = block == b
                    part, d = x[own], x.shape[1]
                    same = lambda v, kind: pa.array(np.full(d, v, kind))
                    yield pa.RecordBatch.from_arrays(
                        [same(b, np.int32), pa.array(np.arange(d, dtype=np.int32)), pa.array(part.min(axis=0)), pa.array(part.max(axis=0)), same(own.sum(), np.int64), same(label[own].min(), np.int64), same(label[own].max(), np.int64)],
                        names=["block", "j", "lo", "hi", "n", "least", "most"],
                    )

        found = blocks.select("block", "label", "x").mapInArrow(run, "block int, j int, lo int, hi int, n long, least long, most long").groupBy("block", "j")
        found = found.agg(*(f(c).alias(c) for f, c in ((F.min, "lo"), (F.max, "hi"), (F.sum, "n"), (F.min, "least"), (F.max, "most")))).toArrow().to_pandas().sort_values(["block", "j"])
        self.block = found["block"].unique()
        grid = lambda c: found[c].to_numpy().reshape(len(self.block), -1)
        self.lo, self.hi = grid("lo").astype(np.float64), grid("hi").astype(np.float64)
        self.n, self.least, self.most = grid("n")[:, 0], grid("least")[:, 0], grid("most")[:, 0]

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the products of each row of q with each block's rows."""
        up, down = np.maximum(q, 0).astype(np.float64), np.minimum(q, 0).astype(np.float64)
        lower, upper = up @ self.lo.T + down @ self.hi.T, up @ self.hi.T + down @ self.lo.T
        slack = 1e-9 * np.maximum(np.abs(lower), np.abs(upper))  # only products beyond 2**53 are rounded at all
        return lower - slack, upper + slack


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64)


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k first of a few scores, in order."""
    return np.lexsort((ids, -score))[:k]


def mine(rows: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` is a condition on ``id``; labels are integers. For each anchor and each of its ``positives`` best rows of
    the same label: the ``negatives`` best rows of other labels whose score is from ``low`` to ``high`` percent of the positive's.
    """
    spark = rows.sparkSession
    ship(spark)
    shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    told = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and label is not null")
    out = spark.createDataFrame([], shape)
    for dims, spread in _spread(told.select("v")).items():
        path = f"{shared_dir(spark)}/blocks-{uuid.uuid4().hex}"
        write_blocks(told, dims, spread, path, block_rows)
        found = cut(_mine_blocks(spark.read.parquet(path), anchors, positives, negatives, low, high).select(*out.columns))
        dropped(spark, path)
        out = out.unionByName(found)
    return out


def _mine_blocks(blocks: DataFrame, anchors: Column, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    spark = blocks.sparkSession
    zones = Zones(blocks)
    size = dict(zip(zones.block.tolist(), zones.n.tolist(), strict=True))
    sent_zones = spark.sparkContext.broadcast(zones)
    asked = cut(blocks.where(anchors).dropDuplicates(["id", "own"]).withColumnRenamed("block", "home"))

    def solved(sent: DataFrame, solve, extra: str, result: str) -> DataFrame:
        """``solve`` of each lot of the anchors in ``sent`` (id, label, own, x, to and ``extra``) with each part of the block ``to``."""
        asking = sent.groupBy("to").count().collect()  # a row a block
        lots = [(r["to"], -(-size[r["to"]] // PART), -(-r["count"] // PART)) for r in asking]
        if not lots:
            return spark.createDataFrame([], result)
        plan = F.broadcast(spark.createDataFrame(lots, "block int, parts int, lots int"))
        part, lot = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"), F.pmod(F.xxhash64("own"), F.col("lots")).cast("int")
        q = sent.withColumnRenamed("to", "block").join(plan, "block").withColumn("lot", lot).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        x = blocks.where(F.col("block").isin([b for b, _, _ in lots])).join(plan, "block").withColumn("part", part).withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
        q, x = q.select("block", "part", "lot", "id", "label", "own", "x", *extra.split()), x.select("block", "part", "lot", "id", "label", "own", "x")

        def group(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({c.split()[0]: [] for c in result.split(", ")})
            b = b.drop_duplicates(["id", "own"])
            return solve(a, b, products(_matrix(a["x"]), _matrix(b["x"])))

        return q.groupBy("block", "part", "lot").cogroup(x.groupBy("block", "part", "lot")).applyInPandas(group, result)

    # positives
    pairs = "id long, own long, other long, score long"

    def same_label(q: pd.DataFrame, x: pd.DataFrame, score: np.ndarray) -> pd.DataFrame:
        ids, label, out = x["id"].to_numpy(), x["label"].to_numpy(), []
        for row, me, mine_, own in zip(score, q["id"], q["label"], q["own"], strict=True):
            at = np.flatnonzero((label == mine_) & (ids != me))
            at = at[_first(row[at], ids[at], positives)]
            out += [(me, own, int(ids[i]), int(row[i])) for i in at]
        return pd.DataFrame(out, columns=["id", "own", "other", "score"])

    best = Window.partitionBy("id", "own").orderBy(F.desc("score"), "other")
    near = cut(solved(asked.withColumn("to", F.col("home")), same_label, "", pairs).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= positives))
    reached = near.where(F.col("rank") == positives).select("id", "own", F.col("score").alias("reached"))

    def other_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = sent_zones.value
        for pdf in batches:
            if not len(pdf):
                continue
            label, home = pdf["label"].to_numpy()[:, None], pdf["home"].to_numpy()[:, None]
            go = (z.least <= label) & (label <= z.most) & (z.block != home) & (z.bounds(_matrix(pdf["x"]))[1] >= pdf["reached"].fillna(-np.inf).to_numpy(np.float64)[:, None])
            at, to = np.nonzero(go)
            yield pdf[["id", "label", "own", "x"]].iloc[at].assign(to=z.block[to].astype(np.int32))

    sent = cut(asked.join(reached, ["id", "own"], "left").mapInPandas(other_blocks, "id long, label long, own long, x array<int>, to int"))
    ranked = near.drop("rank").unionByName(solved(sent, same_label, "", pairs)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= positives)
    # an anchor's positives and their windows
    windows = ranked.groupBy("id", "own").agg(F.sort_array(F.collect_list(F.struct("rank", "other", "score"))).alias("p"))
    windows = asked.join(windows, ["id", "own"]).select("id", "label", "own", "x", F.col("p.other").alias("positive"), F.col("p.score").alias("ps"))
    windows = cut(windows)
    hits = "id long, own long, positive long, ps long, other long, score long"

    def in_windows(q: pd.DataFrame, x: pd.DataFrame, score: np.ndarray) -> pd.DataFrame:
        ids, label, out = x["id"].to_numpy(), x["label"].to_numpy(), []
        for row, me, mine_, own, who, ps in zip(score, q["id"], q["label"], q["own"], q["positive"], q["ps"], strict=True):
            ps = np.asarray(ps)
            least, most = -(-low * ps // 100), high * ps // 100
            at = np.flatnonzero((label != mine_) & (ids != me) & (row >= least.min()) & (row <= most.max()))
            at = at[_first(row[at], ids[at], len(at))]
            falling = -row[at]
            for p, s, a, b in zip(who, ps, least, most, strict=True):
                begin, end = np.searchsorted(falling, -b), np.searchsorted(falling, -a, side="right")
                out += [(me, own, int(p), int(s), int(ids[i]), int(row[i])) for i in at[begin : min(end, begin + negatives)]]
        return pd.DataFrame(out, columns=["id", "own", "positive", "ps", "other", "score"])

    def window_blocks(first: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            z = sent_zones.value
            for pdf in batches:
                if not len(pdf):
                    continue
                lower, upper = z.bounds(_matrix(pdf["x"]))
                label = pdf["label"].to_numpy()[:, None]
                other = (z.least != label) | (z.most != label)
                meets = np.zeros(lower.shape, bool)
                widest = np.full(len(pdf), -np.inf)
                for i, (ps, found) in enumerate(zip(pdf["ps"], [[]] * len(pdf) if first else pdf["reached"], strict=True)):
                    reached = {} if found is None else {r["positive"]: r["score"] for r in found}
                    for who, s in zip(pdf["positive"].iloc[i], ps, strict=True):
                        most = high * int(s) // 100
                        least = max(-(-low * int(s) // 100), reached.get(who, -(2**62)))
                        if least <= most:
                            meets[i] |= (upper[i] >= least) & (lower[i] <= most)
                            widest[i] = max(widest[i], most)
                meets &= other
                # the first blocks of an anchor, the same in both rounds: those that lie nearest to its highest window
                away = np.where(other, np.abs((lower + upper) / 2 - np.where(np.isfinite(widest), widest, 0)[:, None]), np.inf)
                early = np.zeros(meets.shape, bool)
                early[np.arange(len(pdf))[:, None], np.argsort(away, axis=1, kind="stable")[:, :FIRST]] = True
                if not first:
                    early = np.zeros(meets.shape, bool)
                    block = {int(b): k for k, b in enumerate(z.block)}
                    for i, seen in enumerate(pdf["seen"]):
                        early[i, [block[int(b)] for b in (seen if seen is not None else [])]] = True
                at, to = np.nonzero(meets & (early if first else ~early))
                yield pdf[["id", "label", "own", "x", "positive", "ps"]].iloc[at].assign(to=z.block[to].astype(np.int32))

        return run

    route = "id long, label long, own long, x array<int>, positive array<long>, ps array<long>, to int"
    top = Window.partitionBy("id", "own", "positive", "ps").orderBy(F.desc("score"), "other")
    kept = lambda df: df.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= negatives)
    early = cut(windows.mapInPandas(window_blocks(True), route))
    so_far = cut(kept(solved(early, in_windows, "positive ps", hits)))
    tenth = so_far.where(F.col("rank") == negatives).groupBy("id", "own").agg(F.collect_list(F.struct("positive", "score")).alias("reached"))
    seen = early.groupBy("id", "own").agg(F.collect_list("to").alias("seen"))
    late = cut(windows.join(tenth, ["id", "own"], "left").join(seen, ["id", "own"], "left").mapInPandas(window_blocks(False), route))
    found = kept(so_far.drop("rank").unionByName(solved(late, in_windows, "positive ps", hits)))
    return found.select(F.col("id").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("other").alias("negative_id"), F.col("ps").alias("positive_score"), F.col("score").alias("negative_score"))


def op12_hilbert_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every row whose vec_id is divisible by 100, after labels of ids divisible by 7 move on by one."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", "embedding", moved.alias("label")), F.col("id") % 100 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS a, d.vec_id AS b, q.label = d.label AS same, list_inner_product(q.e, d.e)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS place FROM s WHERE same) WHERE place <= 5),
n AS (
  SELECT p.a, p.b AS positive_id, p.score AS positive_score, s.b AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT a AS anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
