"""T12 between samples against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitaplate.operators import samples as SM


def brute(rows, k):
    out = []
    for i, (a, x) in enumerate(rows):
        d = sorted((float(np.sqrt(np.square(np.array(x) - np.array(y)).sum())), b is None, b or 0) for j, (b, y) in enumerate(rows) if i != j)
        out += [(a, n, None if missing else b, round(dist, 9)) for n, (dist, missing, b) in enumerate(d[:k], 1)]
    return sorted(out, key=str)


def got(spark, rows, k, **kw):
    df = spark.createDataFrame(rows, "id long, vec array<double>").repartition(4)
    return sorted(((r[0], r[1], r[2], round(r[3], 9)) for r in SM.sample_neighbours(df, "id", "vec", k=k, **kw).collect()), key=str)


@pytest.mark.parametrize("tile", [4, 16, 512])
def test_neighbours_match_brute_force(spark, tile):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=5) * (1 + i % 7)).tolist()) for i in range(150)]
    rows += [(500 + i, rows[i][1]) for i in range(6)]  # equal vectors: ties by id
    assert got(spark, rows, 3, tile=tile) == brute(rows, 3)


def test_all_vectors_on_one_sphere(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(rng.normal(size=(60, 3)))]
    assert got(spark, rows, 2, tile=8) == brute(rows, 2)


def test_few_samples_repeated_and_missing_ids(spark):
    rows = [(1, [0.0, 0.0]), (1, [3.0, 4.0]), (None, [0.0, 1.0])]
    assert got(spark, rows, 10) == brute(rows, 10)


def test_incomplete_vectors_are_left_out(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, None]), (3, [1.0]), (4, None), (5, [1.0, float("nan")]), (6, [0.0, 2.0])]
    assert got(spark, rows, 5) == [(1, 1, 6, 2.0), (6, 1, 1, 2.0)]
    assert got(spark, [(1, None)], 5) == []


def test_norms_skip_tiles(spark):
    """Two far groups of norms: tiles of one never meet those of the other."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3)) * 0.1 + np.array([1.0, 0, 0])
    y = rng.normal(size=(200, 3)) * 0.1 + np.array([1000.0, 0, 0])
    stats = [(t, float(n.min()), float(n.max()), 0.5) for t, n in enumerate(np.linalg.norm(part, axis=1) for part in np.split(np.concatenate([x, y]), 16))]
    pairs = SM.tile_pairs(spark.createDataFrame(stats, "tile long, lo double, hi double, reach double"))
    seen = {(r.a, r.b) for r in pairs.collect()}
    want = {(a, b) for a, lo, hi, reach in stats for b, b_lo, b_hi, _ in stats if b_lo <= hi + reach and b_hi >= lo - reach}
    assert seen == want
    assert not any((a < 8) != (b < 8) for a, b in seen)
    assert pairs.groupBy("a", "b").count().where(F.col("count") > 1).count() == 0


def test_near_rows_by_products_hold_the_nearest_and_few_others():
    """Far from the origin, where products round, with equal rows, and where products overflow."""
    rng = np.random.default_rng(4)
    for x in (rng.normal(size=(40, 8)) + 1e6, np.repeat(rng.normal(size=(10, 8)), 4, axis=0), rng.normal(size=(40, 8)) * 1e152, np.zeros((40, 8))):
        d = np.sqrt(np.square(x[:, None, :] - x[None, :, :]).sum(axis=2))
        np.fill_diagonal(d, np.inf)
        i, j, got = SM._near(x, x, np.full(len(x), np.inf), 3, 0)
        assert (got == d[i, j]).all()
        found = set(zip(i.tolist(), j.tolist()))
        third = np.sort(d, axis=1)[:, 2]
        assert found >= set(zip(*map(np.ndarray.tolist, np.nonzero(d <= third[:, None]))))


def test_squares_are_not_shuffled(spark):
    """Disk grows with the rows: above the squares nothing is dealt out, and each tile meets all others in one task."""
    rng = np.random.default_rng(5)
    rows = [(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(rng.normal(size=(120, 6)))]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near = SM.sample_neighbours(spark.createDataFrame(rows, "id long, vec array<double>"), "id", "vec", k=3, tile=4)
        above, squares = near._jdf.queryExecution().executedPlan().toString().split("CartesianProduct")
        assert "Exchange" not in above and "Coalesce 1" in squares
        assert squares.count("REPARTITION_BY_NUM") == 2 and "Window" not in squares
        assert near.rdd.getNumPartitions() > 1
        assert sorted(((r[0], r[1], r[2], round(r[3], 9)) for r in near.collect()), key=str) == brute(rows, 3)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_equal_vectors_over_tiles_go_by_id(spark):
    rng = np.random.default_rng(6)
    same = [0.5, -1.0, 2.0]
    rows = [(None if i % 9 == 0 else i, same) for i in range(30)] + [(100 + i, rng.normal(size=3).tolist()) for i in range(20)]
    rng.shuffle(rows)
    for k in (2, 6):  # fewer and more than a tile has
        assert got(spark, rows, k, tile=4) == brute(rows, k)


@pytest.mark.parametrize("scale", [1e-120, 1.0, 1e120])
def test_large_small_and_single_precision_vectors(spark, scale):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(90, 5)) * scale
    x[:30] += 1e4 * scale  # far from the origin, close to each other
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    want = {}
    for i, a in enumerate(x):
        want[i] = sorted((float(np.sqrt(np.square(a - b).sum())), j) for j, b in enumerate(x) if i != j)[:3]
    found = {(r[0], r[1]): (r[3], r[2]) for r in SM.sample_neighbours(df, "id", "vec", k=3, tile=16).collect()}
    assert found == {(i, n): pair for i, pairs in want.items() for n, pair in enumerate(pairs, 1)}
    if scale == 1.0:
        short = [(i, np.float32(v).astype(float).tolist()) for i, v in rows]
        single = spark.createDataFrame(short, "id long, vec array<float>")
        near = sorted(((r[0], r[1], r[2], round(r[3], 9)) for r in SM.sample_neighbours(single, "id", "vec", k=3, tile=16).collect()), key=str)
        assert near == brute(short, 3)


def test_rough_products_leave_out_no_near_row():
    """Rows right at the limit pass, whatever single precision makes of them; few others do."""
    rng = np.random.default_rng(8)
    for move, scale in ((0.0, 1.0), (1e5, 1.0), (0.0, 1e-90), (0.0, 1e90)):
        x, y = (rng.normal(size=(300, 64)) * scale + move * scale for _ in range(2))
        d = np.sqrt(np.square(x[:, None, :] - y[None, :, :]).sum(axis=2))
        limit = np.sort(d, axis=1)[:, 4]
        u, v, least = SM._rough(x, y, limit)
        inside = u @ v >= least[:, None]
        assert inside[d <= limit[:, None]].all()
        assert inside.sum() < 6 * len(x)
    assert SM._rough(np.zeros((3, 2)), np.zeros((3, 2)), np.zeros(3)) is None
    assert SM._rough(np.full((3, 2), 1e160), np.zeros((3, 2)), np.zeros(3)) is None
