"""Exact top-k inner-product search as a Voronoi kNN join.

1. Pivots are drawn by hash from the vectors, about the fourth part of the
   square root of their number and from 64 to 2048 of each length, and every vector joins
   the cell of its nearest pivot (its distance to it is kept).
2. One aggregate summarises each cell: number of ids, radius, longest
   vector, and the same for the queries in it. The summaries are one row a
   pivot, whatever the data.
3. Bounds from the summaries: with q in a cell of pivot p and radius r and x in
   a cell of pivot s and radius t, the product q.x lies within
   p.s +- (r |s| + t |p| + r t), and never above |q| |x|. The cells with the
   largest lower bounds that hold k + 1 ids together bound the k-th best
   score of every query of a cell from below; a data cell whose upper bound is
   lower than that is never sent.
4. First pass: each query is solved against the data nearest to it, its own
   cell, which gives its true k-th best so far. Second pass: the query is sent
   only to those remaining cells whose upper bound, now for this query alone
   (q.s + t |q| and |q| times the cell's longest vector), still reaches it.
5. A large cell is dealt into blocks of about ``BLOCK`` vectors, and the
   queries sent to it into lots, so no task holds a whole hot cell. Data of a cell
   is copied once for each lot that asks for it and not at all if none does.
   Each block is solved by one matrix product; the best k of all blocks of a
   query are merged by ranks that Spark limits before the shuffle.

Scores are integer products of components floor(1024 x); products are exact in
float64 as long as |q| |x| < 2**53, and are computed in int64 otherwise. Ties go to the
smaller id. Vectors that are null, or hold null or non-finite components, and rows
without an id take no part; vectors of different lengths are not compared.
Rows repeated in full, id and vector, count once. Rows of one id with different
vectors are candidates and queries of their own: such an id has k ranks for each of
its vectors. No row with the query's id is among its candidates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlewick.llm.common import cut, ship, table

SCALE = 1024
PIVOTS = (64, 2048)
BLOCK = 8192
"""Vectors or queries in a block; a block of each is multiplied at once."""


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) with v the integer components, of the rows that take part."""
    x = F.col(vector_col)
    whole = x.isNotNull() & ~F.exists(x, lambda y: y.isNull() | F.isnan(y) | (F.abs(y) == float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & whole & (F.size(x) > 0))
    return rows.select(F.col(id_col).alias("id"), F.transform(x, lambda y: F.floor(y.cast("double") * SCALE).cast("long")).alias("v"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64) if len(column) else np.zeros((0, 0), np.int64)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows of q with all rows of x."""
    reach = np.abs(q).max(initial=0).astype(float) * np.abs(x).max(initial=0) * max(1, q.shape[1])
    if reach < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def best(score: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """For each row of scores its k best (score, id), ties to the smaller id, the own id left out."""
    out = []
    for row, me in zip(score, own, strict=True):
        other = np.flatnonzero(ids != me)
        if len(other) > k:
            floor = np.partition(row[other], len(other) - k)[len(other) - k]
            other = other[row[other] >= floor]
        order = np.lexsort((ids[other], -row[other]))[:k]
        out.append([(int(row[i]), int(ids[i])) for i in other[order]])
    return out


def _lengths(column: pd.Series):
    """(length, positions) for each length of the vectors of a column."""
    size = column.map(len).to_numpy()
    for dim in np.unique(size):
        yield int(dim), np.flatnonzero(size == dim)


def knn_join(vectors: DataFrame, queries, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, pivots: int | None = None, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, id, score): each query's k best of all other rows; ``queries`` is a condition on ``id``."""
    ship(vectors.sparkSession)
    spark = vectors.sparkSession
    nothing = spark.createDataFrame([], "query_id long, rank int, id long, score long")
    rows = quantised(vectors, id_col, vector_col).withColumn("own", F.xxhash64("id", "v"))
    wanted = pivots or int(min(PIVOTS[1], max(PIVOTS[0], rows.count() ** 0.5 / 4)))
    # the same pivots in every run: of each length and each remainder of the hash the vector with the smallest hash
    hashed = rows.select("v", F.size("v").alias("dim"), F.xxhash64("v").alias("h"))
    drawn = hashed.groupBy("dim", F.pmod("h", F.lit(wanted)).alias("slot")).agg(F.min_by("v", "h").alias("v")).orderBy("dim", "slot").collect()
    if not drawn:
        return nothing
    dims = np.array([r["dim"] for r in drawn])
    # length -> numbers of its cells, their pivots
    centres = {int(d): (np.flatnonzero(dims == d), np.array([r["v"] for r in drawn if r["dim"] == d], np.float64)) for d in np.unique(dims)}
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches):
        for pdf in batches:
            for dim, at in _lengths(pdf["v"]):
                cells, c = shared.value[dim]
                part = pdf.iloc[at]
                v = _matrix(part["v"]).astype(np.float64)
                d = np.maximum(0, (v * v).sum(1)[:, None] - 2 * v @ c.T + (c * c).sum(1)[None, :])
                cell = d.argmin(1)
                norm = np.sqrt((v * v).sum(1))
                yield part.assign(cell=cells[cell].astype(np.int32), away=np.sqrt(d[np.arange(len(v)), cell]) + 1e-6 * norm + 1e-3, norm=norm * (1 + 1e-9))

    dealt = cut(rows.mapInPandas(assign, "id long, v array<long>, own long, cell int, away double, norm double").withColumn("asks", queries))
    per_id = dealt.groupBy("cell", "id").agg(F.max("away").alias("away"), F.max("norm").alias("norm"), F.first("asks").alias("asks"))
    summary = per_id.groupBy("cell").agg(
        F.count("*").alias("n"), F.max("away").alias("radius"), F.max("norm").alias("norm"),
        F.count_if("asks").alias("nq"), F.max(F.when(F.col("asks"), F.col("away"))).alias("q_radius"), F.max(F.when(F.col("asks"), F.col("norm"))).alias("q_norm"),
    ).toPandas().set_index("cell").reindex(np.arange(len(dims)))
    if not summary["nq"].sum():
        return nothing
    counted = summary["n"].fillna(0).to_numpy()
    geometry = {}  # length -> cells, pivots, radii, longest vectors, and which data cells each query cell may need
    for dim, (cells, centre) in centres.items():
        there = counted[cells] > 0
        cells, centre = cells[there], centre[there]
        own = summary.loc[cells]
        radius, norm, n = own["radius"].to_numpy(), own["norm"].to_numpy(), own["n"].to_numpy()
        length = np.sqrt((centre * centre).sum(1))
        needed = np.zeros((len(cells), len(cells)), bool)
        for i in np.flatnonzero(own["nq"].to_numpy() > 0):
            r = own["q_radius"].iloc[i]
            slack = r * length + radius * length[i] + r * radius
            middle = centre @ centre[i]
            lower, upper = middle - slack, np.minimum(middle + slack, own["q_norm"].iloc[i] * norm)
            order = np.argsort(-lower)
            enough = np.searchsorted(np.cumsum(n[order]), k + 1)
            needed[i] = upper >= (lower[order[enough]] if enough < len(order) else -np.inf)
        geometry[dim] = (cells, centre, radius, norm, needed)
    asked = dealt.where("asks").select("id", "v", "own", "cell", "norm").dropDuplicates(["id", "own"])
    shape = "query_id long, own long, score long, id long"

    def solve(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": [], "own": [], "score": [], "id": []})
        x = x.drop_duplicates(["id", "own"])
        tops = best(products(_matrix(q["q"]), _matrix(x["v"])), x["id"].to_numpy(), q["query_id"].to_numpy(), k)
        flat = [(a, o, s, i) for a, o, top in zip(q["query_id"], q["asker"], tops, strict=True) for s, i in top]
        return pd.DataFrame(flat, columns=["query_id", "own", "score", "id"])

    def solved(sent: DataFrame) -> DataFrame:
        """Each query (id, v, own, to) against the cell ``to``."""
        asking = sent.groupBy("to").count().collect()  # a row a cell
        lots = {r["to"]: (int(-(-counted[r["to"]] // block)), int(-(-r["count"] // block))) for r in asking}
        if not lots:
            return spark.createDataFrame([], shape)
        plan = F.broadcast(spark.createDataFrame([(int(c), b, n) for c, (b, n) in lots.items()], "cell int, blocks int, lots int"))
        part, lot = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("own"), F.col("lots")).cast("int")
        q = sent.withColumnRenamed("to", "cell").join(plan, "cell").withColumn("lot", lot).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        x = dealt.select("cell", "id", "own", "v").join(plan, "cell").withColumn("part", part).withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
        q, x = q.select("cell", "part", "lot", F.col("id").alias("query_id"), F.col("own").alias("asker"), F.col("v").alias("q")), x.select("cell", "part", "lot", "id", "own", "v")
        return q.groupBy("cell", "part", "lot").cogroup(x.groupBy("cell", "part", "lot")).applyInPandas(solve, shape)

    ranked = Window.partitionBy("query_id", "own").orderBy(F.desc("score"), "id")
    top = lambda hits: hits.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    near = cut(top(solved(asked.select("id", "v", "own", F.col("cell").alias("to")))))
    reached = near.where(F.col("rank") == k).select(F.col("query_id").alias("id"), "own", F.col("score").alias("reached"))
    sent_to = spark.sparkContext.broadcast(geometry)

    def route(batches):
        for pdf in batches:
            for dim, rows_at in _lengths(pdf["v"]):
                cells, centre, radius, norm, needed = sent_to.value[dim]
                part = pdf.iloc[rows_at]
                q = _matrix(part["v"]).astype(np.float64)
                length = part["norm"].to_numpy()[:, None]
                upper = np.minimum(q @ centre.T + radius[None, :] * length, length * norm[None, :]) + 1.0
                floor = part["reached"].fillna(-np.inf).to_numpy(np.float64)[:, None]
                mine = np.searchsorted(cells, part["cell"].to_numpy())
                go = (upper >= floor) & needed[mine]
                go[np.arange(len(mine)), mine] = False
                at, to = np.nonzero(go)
                yield pd.DataFrame({"id": part["id"].to_numpy()[at], "v": part["v"].to_numpy()[at], "own": part["own"].to_numpy()[at], "to": cells[to].astype(np.int32)})

    routed = asked.join(reached, ["id", "own"], "left").mapInPandas(route, "id long, v array<long>, own long, to int")
    found = top(near.drop("rank").unionByName(solved(routed)))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def op5_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best of every row whose vec_id is divisible by 100."""
    found = knn_join(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.e, d.e)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 10
"""
