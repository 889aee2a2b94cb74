"""Unpivot, unify, restack, unique keys and majority votes."""

from __future__ import annotations

from vitaplate.operators import clean as C
from vitaplate.operators import compare as M
from vitaplate.operators import reshape as R


def test_melt_keeps_missing_and_infers_ids(spark):
    df = spark.createDataFrame([("a", 1, 2.0, None), ("b", 2, None, 5.0)], "k string, day int, x double, y double")
    long = R.melt(df, ids=["k"])
    assert long.count() == 6 and long.where("value IS NULL").count() == 2
    inferred = R.melt(df)  # text columns are ids, numbers are values (day included)
    assert set(inferred.columns) == {"k", "variable", "value"}
    assert sorted({r.variable for r in inferred.collect()}) == ["day", "x", "y"]


def test_spread_is_inverse_of_melt(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", None, 5.0)], "k string, x double, y double")
    back = R.spread(R.melt(df, ids=["k"]), ["k"], "variable", "value", ["x", "y"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_unify_collapse_rules(spark):
    left = spark.createDataFrame([("u1", "Live", 1.0, "x"), ("u2", "Dead", 2.0, "y"), ("u3", "Dead", 3.0, "z")],
                                 "uid string, ld string, q double, only_l string")
    right = spark.createDataFrame([("u1", "Dead", 1.0), ("u2", "Dead", None)], "uid string, ld string, q double")
    u = R.unify(left, right, "uid", "_L", "_R")
    assert u.columns == ["uid", "only_l", "ld_R", "ld_L", "q"]
    got = {r.uid: r.q for r in u.collect()}
    assert got == {"u1": 1.0, "u2": None, "u3": None}  # collapsed column keeps the right side's value


def test_unify_without_shared_columns_and_all_null_pairs(spark):
    left = spark.createDataFrame([("u1", 1.0)], "uid string, a double")
    right = spark.createDataFrame([("u1", 2.0)], "uid string, b double")
    assert R.unify(left, right, "uid", "_L", "_R").columns == ["uid", "a", "b"]
    left2 = spark.createDataFrame([("u1", None)], "uid string, a double")
    right2 = spark.createDataFrame([("u1", 3.0)], "uid string, a double")
    # every pair has a missing side: nothing disagrees, the column collapses
    assert R.unify(left2, right2, "uid", "_L", "_R").columns == ["uid", "a"]


def test_restack_two_rows_per_object(spark):
    df = spark.createDataFrame([("u1", "STA", "Live", "Dead"), ("u2", None, "Dead", None)],
                               "uid string, compound string, ld_VD string, ld_Imaging string")
    rs = R.restack(df, "ld", "_VD", "_Imaging")
    got = sorted((r.uid, r.compound, r.ld, r.assay, r.treatment) for r in rs.collect())
    assert got[0] == ("u1", "STA_Imaging", "Dead", "_Imaging", "STA_Imaging")
    assert ("u2", "NA_VD", "Dead", "_VD", "NA_VD") in got


def test_unique_by_drops_every_copy(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), (None, 5), ("c", 6)], "uid string, v int")
    kept, report = C.unique_by(df, "uid")
    assert sorted(r.uid for r in kept.collect()) == ["b", "c"]
    r = report.collect()[0]
    assert (r.total_rows, r.kept_rows, r.removed_rows) == (6, 2, 4)


def test_majority_tie_goes_to_first_value_and_skips_missing(spark):
    long = spark.createDataFrame(
        [("q", "b"), ("q", "a"), ("q", "b"), ("q", "a"), ("q", None), ("q", None), ("q", None), ("r", "z")],
        "variable string, value string")
    got = {r.variable: r.value for r in M.majority_long(long).collect()}
    assert got == {"q": "a", "r": "z"}


def test_consensus_votes_appends_majority(spark):
    survey = spark.createDataFrame(
        [("1", "experts", "L", "D"), ("2", "experts", "L", "L"), ("3", "ML", "D", "L")],
        "respondent string, grp string, o1 string, o2 string")
    got = {(r.variable, r.value, r.grp): r.n for r in M.consensus_votes(survey).collect()}
    assert got[("o1", "L", "Majority")] == 1 and got[("o2", "L", "Majority")] == 1
    assert got[("o1", "L", "experts")] == 2
    assert sum(v for (var, _, g), v in got.items() if g == "Majority") == 2


def test_clean_input_canonicalises(spark):
    df = spark.createDataFrame(
        [("12415 CRC", None, "5"), ("x", "control", ""), ("x", "Control", " 2.5 "), ("x", "STA 5", None),
         ("x", "media", "abc")],
        "patient string, compound string, concentration string")
    got = [(r.patient, r.compound, r.concentration) for r in C.clean_input(df).collect()]
    assert got == [("12415", "Media", 5.0), ("x", "Media", None), ("x", "Media", 2.5), ("x", "STA 5", None),
                   ("x", "Media", None)]
    fixed = [(r.compound, r.concentration) for r in C.clean_input(df, repair_embedded_dose=True).collect()]
    assert fixed[3] == ("STA", 5.0)


def test_infer_numeric(spark):
    df = spark.createDataFrame([("1", "a", ""), ("2.5", "3", None)], "x string, y string, z string")
    out = C.infer_numeric(df)
    assert dict(out.dtypes) == {"x": "double", "y": "string", "z": "string"}


def test_recode_unlisted_is_null(spark):
    df = spark.createDataFrame([("panel",), ("imaging",), ("other",)], "g string")
    out = C.recode(df, "g", ["panel", "Majority", "imaging", "dye"], ["Panel", "Majority", "Image", "Dye"])
    got = {r.g: (r.g_label, r.g_rank) for r in out.collect()}
    assert got == {"panel": ("Panel", 1), "imaging": ("Image", 3), "other": (None, None)}


def test_split_and_link_group(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("media_VD", "0_L-ML_L-VD"), ("STA_Imaging", "1_D-ML_L-VD")], "c string, s string")
    a, b = C.split_pair(F.col("c"))
    got = [(r.a, r.b, r.g) for r in df.select(a.alias("a"), b.alias("b"), C.link_group("s").alias("g")).collect()]
    assert got == [("media", "VD", "type_b"), ("STA", "Imaging", "type_a")]


def test_seconds_to_days_half_even(spark):
    df = spark.createDataFrame([(129600.0,), (216000.0,), (0.0,), (None,)], "s double")  # 1.5, 2.5, 0 days
    assert [r.d for r in df.select(C.seconds_to_days("s").alias("d")).collect()] == [2, 2, 0, None]


def test_restack_overwrites_its_columns(spark):
    from vitaplate.operators.reshape import restack

    df = spark.createDataFrame([("IRI", "old", "Live", "Dead", 1.0)], "compound string, treatment string, ld_VD string, ld_ML string, `Object.ID` double")
    out = restack(df, "ld", "_VD", "_ML")
    assert out.columns == ["compound", "Object.ID", "ld", "treatment", "assay"]
    assert sorted(r.treatment for r in out.collect()) == ["IRI_ML", "IRI_VD"]


def test_unify_with_dotted_names_and_known_collapse(spark):
    from vitaplate.operators.reshape import unify

    left = spark.createDataFrame([(1, 5, "a"), (2, 6, "b")], "k int, `Object.ID` int, `l.d` string")
    right = spark.createDataFrame([(1, 5, "z")], "k int, `Object.ID` int, `l.d` string")
    found = unify(left, right, "k", "_L", "_R")
    told = unify(left, right, "k", "_L", "_R", collapse=["Object.ID"])
    assert found.columns == told.columns == ["k", "Object.ID", "l.d_R", "l.d_L"]
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, told.collect())) == [(1, 5, "z", "a"), (2, None, None, "b")]
