"""Wells, viability, baselines and treatment order on hand fixtures."""

from __future__ import annotations

import math

from vitaplate.operators import wells as W

OBJ_SCHEMA = "exp_id string, patient string, compound string, concentration double, day int, ld string, plate_row long, plate_col int"


def _objects(spark, rows):
    return spark.createDataFrame(rows, OBJ_SCHEMA)


def test_well_counts_zero_fill_and_keys(spark):
    rows = [
        ("E1", "P", "Media", None, 0, "Live", 1, 1),
        ("E1", "P", "Media", None, 0, "Live", 1, 1),
        ("E1", "P", "Media", None, 0, "Dead", 1, 2),
        ("E2", "P", "Media", None, 0, "Dead", 1, 1),  # same position, other experiment: another well
    ]
    wells = W.well_measurements(W.with_well_key(_objects(spark, rows)))
    got = sorted((r.well_row, r.well_col, r.live, r.dead) for r in wells.collect())
    assert got == [("1_E1", 1, 2, 0), ("1_E1", 2, 0, 1), ("1_E2", 1, 0, 1)]
    nofill = W.well_measurements(W.with_well_key(_objects(spark, rows)), missing_as_zero=False)
    got = sorted((r.well_row, r.well_col, r.live, r.dead) for r in nofill.collect())
    assert got[1] == ("1_E1", 2, None, 1)


def test_ratio_inf_counts_as_a_well(spark):
    wells = spark.createDataFrame(
        [("P", "A", 1.0, 1, 2, 0), ("P", "A", 1.0, 1, 1, 1), ("P", "A", 1.0, 1, 0, 0)],
        "patient string, compound string, concentration double, day int, live long, dead long",
    )
    out = W.normalise_viability(wells, metric="ratio").collect()[0]
    assert out.n_wells == 2  # +Inf and 1.0 count; 0/0 is missing
    assert out.live_mean == math.inf and out.live_sd is None
    assert out.nlive is None  # Inf / Inf


def test_baseline_is_earliest_day_present(spark):
    stats = spark.createDataFrame(
        [("P", "A", None, 1, 0.5, 0.1), ("P", "A", None, 3, 0.25, 0.05), ("P", "B", 2.0, 0, None, None),
         ("P", "B", 2.0, 1, 0.4, 0.1)],
        "patient string, compound string, concentration double, day int, live_mean double, live_sd double",
    )
    got = {(r.compound, r.day): (r.nlive, r.nlive_sd) for r in W.baseline_normalise(stats).collect()}
    assert got[("A", 1)] == (1.0, 0.2)  # first day 1, not 0
    assert got[("A", 3)] == (0.5, 0.1)
    assert got[("B", 1)] == (None, None)  # missing first mean -> whole curve missing


def _order(spark, pairs):
    df = spark.createDataFrame(pairs, "compound string, concentration double")
    return [(r.treatment, r.treatment_rank) for r in W.treatment_order(df).orderBy("treatment_rank").collect()]


def test_treatment_order_pins_single_control(spark):
    got = _order(spark, [("STA", 5.0), ("Media", None), ("IRI", 20.0), ("IRI", 0.74), ("IRI", None), ("ATP", 0.0)])
    assert got == [("Media", 1), ("ATP_0", 2), ("STA_5", 3), ("IRI_0.74", 4), ("IRI_20", 5), ("IRI", 6)]


def test_treatment_order_zero_and_two_controls(spark):
    # no control at all
    assert _order(spark, [("B", 1.0), ("A", 1.0)]) == [("A_1", 1), ("B_1", 2)]
    # two single-dose controls: nothing is pinned, alphabetical order holds
    got = _order(spark, [("media", None), ("Control", None), ("Ab", 1.0)])
    assert got == [("Ab_1", 1), ("Control", 2), ("media", 3)]


def test_curve_extents_rules(spark):
    curves = spark.createDataFrame(
        [("P", 0, 1.0, 0.2), ("P", 1, 1.31, 0.1), ("Q", 0, 2.5, 0.6), ("Q", 1, 0.5, None)],
        "patient string, day int, val double, dev double",
    ).selectExpr("*", "val - dev AS lower", "val + dev AS upper")
    got = {r.patient: (r.y_min, r.y_max, r.n_days) for r in W.curve_extents(curves).collect()}
    assert got["P"] == (0.0, 1.4, 2)  # 1.41 < 2 -> one decimal, half-even
    assert got["Q"] == (0.0, 4.0, 2)  # 3.1 >= 2 -> ceiling


def test_single_replicate_and_dead_only_condition(spark):
    wells = spark.createDataFrame(
        [("P", "A", 1.0, 0, 3, 1), ("P", "A", 1.0, 2, 1, 1),        # one well per day: sd is missing
         ("P", "D", 2.0, 0, 0, 4), ("P", "D", 2.0, 2, 0, 2)],       # Dead objects only
        "patient string, compound string, concentration double, day int, live long, dead long",
    )
    got = {(r.compound, r.day): (r.n_wells, r.live_mean, r.live_sd, r.nlive) for r in
           W.normalise_viability(wells).collect()}
    assert got[("A", 0)] == (1, 0.75, None, 1.0)
    assert got[("A", 2)] == (1, 0.5, None, 0.5 / 0.75)
    # proportion 0 on the baseline day: 0/0 is missing, not an error
    assert got[("D", 0)] == (1, 0.0, None, None) and got[("D", 2)] == (1, 0.0, None, None)


def test_treatment_order_keeps_missing_compounds(spark):
    from vitaplate.operators.wells import treatment_order

    df = spark.createDataFrame([("Media", None), (None, None), ("STA", 5.0), ("IRI", 20.0), ("IRI", 1e-7), ("IRI", 2e-7)], "compound string, concentration double")
    rows = treatment_order(df).orderBy("treatment_rank").collect()
    assert [(r.compound, r.treatment, r.compound_rank) for r in rows] == [
        ("Media", "Media", 1), ("STA", "STA_5", 2), (None, None, 3), ("IRI", "IRI_1e-07", 4), ("IRI", "IRI_2e-07", 4), ("IRI", "IRI_20", 4)]
    assert {(r.n_compounds, r.n_controls) for r in rows} == {(4, 1)}


def test_extents_below_zero(spark):
    from vitaplate.operators.wells import curve_extents

    df = spark.createDataFrame([("p", 1, -1.5, 3.2), ("p", 2, 0.5, 2.0)], "patient string, day int, lower double, upper double")
    assert [tuple(r) for r in curve_extents(df, clamp=False).collect()] == [("p", -2.0, 4.0, 2)]
    assert [tuple(r) for r in curve_extents(df).collect()] == [("p", 0.0, 4.0, 2)]


def test_with_treatments_ranks_distinct_treatments_only(spark):
    """Many rows per treatment: the numbers are those of the treatment table, and no window sees the rows."""
    from vitaplate.operators import wells as W

    rows = [("Media", None)] * 50 + [("STA", 5.0)] * 40 + [("IRI", float(d)) for d in (20, 60, 20)] * 30 + [(None, 1.0)] * 3
    df = spark.createDataFrame([(c, d, float(i)) for i, (c, d) in enumerate(rows)], "compound string, concentration double, v double").repartition(6)
    out = W.with_treatments(df)
    assert out.columns == ["compound", "concentration", "v", "treatment", "treatment_rank"]
    table = {(r.compound, r.concentration): (r.treatment, r.treatment_rank) for r in W.treatment_order(df).collect()}
    got = out.collect()
    assert sorted(r.v for r in got) == [float(i) for i in range(len(rows))]
    assert all(table[r.compound, r.concentration] == (r.treatment, r.treatment_rank) for r in got)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    windows = plan[plan.index("Window"):]
    assert "Aggregate" in windows and "v#" not in windows.split("Aggregate", 1)[0]
