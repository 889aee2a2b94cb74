"""Feature tables: scaling properties, distances and densities against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from vitaplate.functions.names import clean_feature_label, survey_header, syntactic_name
from vitaplate.operators import features as FT


def _wide(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(400):
        rows.append((f"E{i % 3}", ["P1", "P2"][i % 2], "Media", i % 4,
                     rnd.uniform(10, 60), rnd.uniform(1e3, 9e4), None if i % 37 == 0 else rnd.random(), i))
    return spark.createDataFrame(
        rows, "exp_id string, patient string, compound string, day int, `Region Area [µm²]` double, "
              "`Region Intensity Mean 1 px` double, `Region Texture  SER Spot 1 px` double, "
              "`Object No in Organoids` long")


def test_feature_selection_and_labels(spark):
    df = _wide(spark)
    feats = FT.select_features(df, ["exp_id", "patient", "compound", "day"])
    assert feats == ["Region Area [µm²]", "Region Intensity Mean 1 px", "Region Texture  SER Spot 1 px"]
    assert [clean_feature_label(f) for f in feats] == ["Area [µm²]", "Intensity Mean", "Texture SER Spot"]
    long = FT.feature_long(df, ids=["exp_id", "patient", "compound", "day"])
    assert long.count() == 1200 and long.where("value IS NULL").count() == 11


def test_zscore_and_rms_properties(spark):
    df = _wide(spark)
    z = FT.heatmap(df, keys=("exp_id", "patient", "day"), sample_keys=("patient", "day", "exp_id"), scale="z")
    for feat in ["Area [µm²]", "Intensity Mean"]:
        v = np.array([r.scaled for r in z.where(z.variable == feat).collect()])
        assert abs(v.mean()) < 1e-9 and abs(v.std(ddof=1) - 1) < 1e-9
    tex = [r.scaled for r in z.where(z.variable == "Texture SER Spot").collect()]
    assert all(t is None for t in tex) or any(t is None for t in tex)  # missing means stay missing
    rms = FT.heatmap(df, keys=("exp_id", "patient", "day"), sample_keys=("patient", "day", "exp_id"), scale="rms")
    v = np.array([r.scaled for r in rms.where(rms.variable == "Area [µm²]").collect()])
    assert abs((v ** 2).sum() / (len(v) - 1) - 1) < 1e-9


def test_distance_matches_r_dist_with_missing(spark):
    m = spark.createDataFrame(
        [("s1", "a", 1.0), ("s1", "b", 2.0), ("s2", "a", 3.0), ("s2", "b", None), ("s3", "a", 0.0), ("s3", "b", 4.0)],
        "sample string, variable string, scaled double")
    got = FT.feature_distance(m, ["a", "b"]).collect()[0]
    # usable samples s1, s3: sum of squares 1 + 16, scaled by 3 samples / 2 usable
    assert got.n_samples == 2 and math.isclose(got.distance, math.sqrt(17 * 3 / 2))


def test_quartiles_are_type_7(spark):
    vals = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0, 5.0, 3.0, 5.0]
    df = spark.createDataFrame([("g", v) for v in vals] + [("h", 7.0), ("h", 8.0)], "g string, value double")
    got = {r.g: (r.q1, r.q3) for r in FT.group_quartiles(df, ["g"]).collect()}
    assert got["g"] == pytest.approx(tuple(np.percentile(vals, [25, 75])))
    assert got["h"] == pytest.approx((7.25, 7.75))


def _brute_density(x: np.ndarray):
    n = len(x)
    sd = x.std(ddof=1)
    q1, q3 = np.percentile(x, [25, 75])
    lo = min(sd, (q3 - q1) / 1.34)
    lo = lo if lo > 0 else (sd if sd > 0 else (np.abs(x).max() if np.abs(x).max() > 0 else 1.0))
    bw = 0.9 * lo * n ** -0.2
    g0 = x.min() - 3 * bw
    step = (x.max() - x.min() + 6 * bw) / 511
    w = np.zeros(512)
    pos = (x - g0) / step
    b = np.floor(pos).astype(int)
    f = pos - b
    np.add.at(w, b, 1 - f)
    np.add.at(w, b + 1, f)
    grid = np.arange(512)
    u = (grid[:, None] - grid[None, :]) * step / bw
    dens = (np.exp(-0.5 * u * u) / math.sqrt(2 * math.pi)) @ w / (n * bw)
    exact = (np.exp(-0.5 * ((g0 + grid * step)[:, None] - x[None, :]) ** 2 / bw ** 2)
             / math.sqrt(2 * math.pi)).sum(axis=1) / (n * bw)
    return g0 + grid * step, dens, exact


def test_density_matches_brute_force(spark):
    rnd = np.random.default_rng(5)
    x = np.concatenate([rnd.normal(10, 2, 300), rnd.normal(20, 1, 100)])
    df = spark.createDataFrame([("v", "Media", "P", float(v)) for v in x] + [("v", "Media", "Q", 1.0)],
                               "variable string, compound string, patient string, value double")
    out = FT.feature_density(df, ["variable", "compound", "patient"])
    rows = sorted(out.where(out.patient == "P").collect(), key=lambda r: r.g)
    assert out.where(out.patient == "Q").count() == 0  # a single value gives no density
    grid, dens, exact = _brute_density(x)
    assert len(rows) == 512
    assert np.allclose([r.x for r in rows], grid)
    assert np.allclose([r.density for r in rows], dens, rtol=1e-9, atol=1e-12)
    # linear binning stays close to the exact kernel sum
    assert np.max(np.abs(dens - exact)) < 0.01 * exact.max()
    assert max(r.scaled for r in rows) == 1.0


def test_header_rules():
    assert syntactic_name("Region Area [µm²]") == "Region.Area..µm²."
    assert syntactic_name("1st") == "X1st"
    assert survey_header("Organoid A-15 (A.15)") == "A.15"
    assert clean_feature_label("Region.Area.1.2.1.px", dotted=True) == "Area 1.2"


def test_column_distance_matches_long_form(spark):
    rnd = np.random.default_rng(9)
    rows = []
    for s in range(60):
        vals = rnd.normal(size=5)
        rows.append((f"s{s}", *[None if (s + j) % 11 == 0 else float(v) for j, v in enumerate(vals)]))
    cols = ["a", "b", "c", "d", "e"]
    wide = spark.createDataFrame(rows, "sample string, " + ", ".join(f"{c} double" for c in cols))
    got = {(r.feature_a, r.feature_b): (r.distance, r.n_samples) for r in FT.column_distance(wide, cols).collect()}
    long = wide.unpivot(["sample"], cols, "variable", "scaled")
    want = {(r.feature_a, r.feature_b): (r.distance, r.n_samples) for r in FT.feature_distance(long, cols).collect()}
    assert got.keys() == want.keys() and len(got) == 10
    for key in got:
        assert got[key][1] == want[key][1]
        assert math.isclose(got[key][0], want[key][0], rel_tol=1e-9)


def test_rms_of_an_all_zero_feature_is_missing(spark):
    long = spark.createDataFrame([("s1", "z", 0.0), ("s2", "z", 0.0), ("s1", "a", 3.0), ("s2", "a", 4.0)],
                                 "sample string, variable string, mean_val double")
    got = {(r.sample, r.variable): r.scaled for r in FT.rms_scale(long).collect()}
    assert got[("s1", "z")] is None and got[("s2", "z")] is None
    assert math.isclose(got[("s1", "a")], 3.0 / 5.0) and math.isclose(got[("s2", "a")], 4.0 / 5.0)


def test_distance_of_close_large_columns(spark):
    """Two columns near 1e8 that differ by 0.01 over 50 rows."""
    from vitaplate.operators.features import column_distance

    df = spark.createDataFrame([(1e8 + i, 1e8 + i + 0.01) for i in range(50)], "`a.x` double, b double")
    (r,) = column_distance(df, ["a.x", "b"]).collect()
    assert abs(r.distance - 0.0707) < 1e-4 and r.n_samples == 50


def test_quartiles_of_large_tied_groups(spark):
    """Exact beyond the sketch's size, with two thirds of a group on one value."""
    import numpy as np

    from vitaplate.operators.features import group_quartiles

    df = spark.range(60_000).selectExpr("if(id % 3 = 0, 'tied', 'spread') as g", "if(id % 3 = 0, if(id % 9 < 6, 0.0d, id * 0.5d), sin(id)) as value")
    got = {r.g: (r.q1, r.q3) for r in group_quartiles(df, ["g"]).collect()}
    rows = df.toPandas()
    for g, part in rows.groupby("g"):
        assert np.allclose(got[g], np.quantile(part["value"], [0.25, 0.75]), rtol=0, atol=1e-12)
