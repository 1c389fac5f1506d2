import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewick.llm import hard_negatives, whitening

NAN, INF = float("nan"), float("inf")
ODD = [(901, None), (902, []), (903, [1.0, None, 2.0]), (904, [1.0, NAN, 2.0]), (905, [1.0, INF, 0.0]), (906, [-INF, 0.0, 1.0])]


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, "x", 5) for i, v in rows], f"vec_id long, embedding array<{kind}>, n string, component int").repartition(3)


def exact_whitening(rows):
    """x, n * x - S and the covariance by Python's integers."""
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for _, v in rows], object)
    n, total = len(x), x.sum(axis=0)
    centred = x * n - total
    return centred, (centred.T @ centred / n**3).astype(float)


def test_cross_products_are_exact():
    rng = np.random.default_rng(1)
    for low, high, rows, dims in ((0, 2048, 700, 5), (0, 2, 64, 3), (0, 1, 3, 2), (0, 2**45, 130, 3)):
        u = rng.integers(low, high, (rows, dims))
        got, want = whitening.cross_products(u), u.astype(object).T @ u.astype(object)
        assert all(int(got[i, j]) == (want[i, j] if i <= j else 0) for i in range(dims) for j in range(dims))
        sums = whitening.Sums(dims)
        for part in np.array_split(u - 77, 3):
            if len(part):
                sums.add(part)
        x = (u - 77).astype(object)
        assert sums.n == rows and (sums.total == x.sum(axis=0)).all() and all(sums.cross[i, j] == (x.T @ x)[i, j] for i in range(dims) for j in range(i, dims))


@pytest.mark.parametrize("dims", [2, 12])
def test_whitening_against_exact_integers(spark, dims):
    rng = np.random.default_rng(dims)
    mixed = rng.normal(size=(300, dims)) @ rng.normal(size=(dims, dims)) + rng.normal(size=dims) * 3
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(mixed)]
    rows += [rows[3], (None, rows[4][1])]
    df = whitening.whiten(table(spark, rows + ODD))
    got = df.collect()
    assert len(got) == len(rows) * min(8, dims) and df.columns == ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    centred, cov = exact_whitening(rows)
    e = np.sort(np.linalg.eigvalsh(cov))[::-1]
    where = {}
    for k, (i, _) in enumerate(rows):
        where.setdefault(i, k)
    values = {}
    for r in got:
        assert r["n"] == len(rows) and int(r["deviation"]) == sum(int(c) ** 2 for c in centred[where[r["id"]]])
        assert r["explained"] == pytest.approx(e[r["component"] - 1] / e.sum(), rel=1e-9) and r["identity_error"] < 1e-9
        values.setdefault(r["component"], []).append((where[r["id"]], r["whitened"]))
    for c, own in values.items():
        # the column is the data along some unit eigenvector: solving for it gives that vector back
        x = (centred[[k for k, _ in own]] / len(rows)).astype(float)
        u = np.linalg.lstsq(x, np.array([w for _, w in own]) * math.sqrt(e[c - 1]), rcond=None)[0]
        assert np.linalg.norm(u) == pytest.approx(1, abs=1e-8) and np.allclose(cov @ u, e[c - 1] * u, atol=1e-6 * e[0])


def test_whitening_without_variance_and_by_length(spark):
    assert whitening.whiten(table(spark, [])).count() == 0 and whitening.whiten(table(spark, ODD)).count() == 0
    got = whitening.whiten(table(spark, [(1, [0.5, 0.25])] * 2 + [(2, [1.0, 2.0, 3.0]), (3, [2.0, 2.0, 3.0])])).collect()
    two, three = [r for r in got if r["id"] == 1], [r for r in got if r["id"] != 1]
    assert len(two) == 4 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in two)
    assert [r["n"] for r in three] == [2] * 6 and sorted(r["whitened"] for r in three if r["component"] == 1) == [-1, 1]
    assert all(r["whitened"] is None for r in three if r["component"] > 1) and {r["deviation"] for r in three} == {1024**2}


def test_whitening_of_large_numbers(spark):
    rows = [(i, [float(2**30 + i), -(2.0**35) * (i % 3)]) for i in range(40)]
    got = whitening.whiten(table(spark, rows, "double")).collect()
    centred, _ = exact_whitening(rows)
    assert {(r["id"], int(r["deviation"])) for r in got} == {(i, sum(int(c) ** 2 for c in centred[i])) for i in range(40)}


def test_op11_query(spark):
    df = whitening.op11_bitsliced_whitening(spark, "/root/testdata/sf0.001")
    assert dict(df.dtypes) | {"deviation": "bigint", "component": "int", "n": "bigint"} == dict(df.dtypes)
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    centred, cov = exact_whitening(rows)
    got = df.collect()
    want = {i: sum(int(c) ** 2 for c in centred[k]) for k, (i, _) in enumerate(rows)}
    assert len(got) == 8 * len(rows) and all(r["deviation"] == want[r["vec_id"]] and r["identity_error"] < 1e-4 for r in got)


def test_hilbert_curve_steps_to_a_neighbour():
    for dims, bits in ((2, 4), (3, 3), (5, 2), (1, 6)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        place = hard_negatives.hilbert_places(grid, bits)
        assert sorted(place) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def mined(rows, every, k, m, low=30, high=90):
    """Rows (id, label, vector): positives and negatives by comparing each anchor with all rows."""
    whole = {(i, y, tuple(math.floor(256 * c) for c in v)) for i, v, y in rows if i is not None and y is not None and v and all(c is not None and math.isfinite(c) for c in v)}
    out = []
    for i, y, q in whole:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, x)), j, z) for j, z, x in whole if j != i and len(x) == len(q))
        for s, j, _ in [t for t in scored if t[2] == y][:k]:
            inside = [(n, -t) for t, n, z in scored if z != y and low * -s <= 100 * -t <= high * -s][:m]
            out += [(i, j, r + 1, n, -s, t) for r, (n, t) in enumerate(inside)]
    return sorted(out)


def negatives_table(spark, rows):
    return spark.createDataFrame([(*r, "x", 5) for r in rows], "vec_id long, embedding array<float>, label int, id string, own int").repartition(3)


@pytest.mark.parametrize(("dims", "block"), [(3, 16), (16, 40)])
def test_negatives_against_brute_force(spark, dims, block):
    rng = np.random.default_rng(dims)
    rows = []
    for i in range(500):
        y = int(rng.integers(4))
        v = rng.normal(size=dims) * 0.3 + (np.arange(dims) % 4 == y) * (i % 3)
        rows.append((i, [float(np.float32(c)) for c in v], y))
    rows += [(500 + i, rows[7][1], 1 + i % 2) for i in range(120)]  # one vector, many ids: ties
    rows += [rows[10]] * 30 + [(20, rows[3][1], 2), (1000, [1.0] * (dims + 1), 1), (1003, [2.0] * (dims + 1), 1), (1001, [1.0] * (dims + 1), 0)]
    rows += [(None, rows[0][1], 1), (1002, rows[0][1], None)] + [(i + 2000, v, 1) for i, v in ODD]
    df = hard_negatives.mine(negatives_table(spark, rows), F.col("id") % 10 == 0, block_rows=block)
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, df.collect())) == mined(rows, 10, 5, 10)
    few = hard_negatives.mine(negatives_table(spark, rows[:40]), F.col("id") % 2 == 0, positives=50, negatives=3, low=0, high=100)
    assert sorted(map(tuple, few.collect())) == mined(rows[:40], 2, 50, 3, 0, 100)


def test_negatives_of_empty_tables_and_one_label(spark):
    anchors = F.col("id") % 2 == 0
    assert hard_negatives.mine(negatives_table(spark, []), anchors).count() == 0
    assert hard_negatives.mine(negatives_table(spark, [(i, v, 1) for i, v in ODD]), anchors).count() == 0
    assert hard_negatives.mine(negatives_table(spark, [(i, [1.0, i / 9], 1) for i in range(9)]), anchors).count() == 0
    assert hard_negatives.mine(negatives_table(spark, [(1, [1.0], 1), (3, [1.0], 2)]), anchors).count() == 0


def test_zone_bounds_hold(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = negatives_table(spark, [(i, [float(c) for c in rng.normal(size=4)], i % 3) for i in range(300)])
    told = rows.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    hard_negatives.write_blocks(told, 4, hard_negatives._spread(told)[4], str(tmp_path / "b"), 20)
    blocks = spark.read.parquet(str(tmp_path / "b"))
    zones = hard_negatives.Zones(blocks)
    assert len(zones.block) > 8 and zones.n.sum() == 300
    q = rng.integers(-300, 300, (7, 4))
    lower, upper = zones.bounds(q)
    at = {int(b): k for k, b in enumerate(zones.block)}
    for r in blocks.collect():
        s, k = q @ np.array(r["x"]), at[r["block"]]
        assert (lower[:, k] <= s).all() and (s <= upper[:, k]).all() and zones.least[k] <= r["label"] <= zones.most[k]
    plan = blocks.where(F.col("block").isin([0, 3]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan
