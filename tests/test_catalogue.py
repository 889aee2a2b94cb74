"""Every catalogue query against its DuckDB oracle, the driver entry point, and plan properties."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from vitaplate.plans import catalogue, oracle
from vitaplate.sources.tables import TABLES

QUERIES = catalogue.queries()
ORACLE = oracle.oracle_sql()


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v if v is None or isinstance(v, (int, bool, str)) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    yield con
    con.close()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = Counter(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    rel = duck.execute(ORACLE[name])
    ocols = [d[0] for d in rel.description]
    assert sorted(ocols) == cols
    idx = {c: i for i, c in enumerate(ocols)}
    want = Counter(tuple(_norm(r[idx[c]]) for c in cols) for r in rel.fetchall())
    assert got == want


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["patient", "compound", "concentration", "day", "n_wells", "live_mean", "live_sd", "nlive", "nlive_sd"]
    assert df.count() > 100


def test_entry_registers_the_catalogue():
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


# Columns that hold no value on the small tables, and why.
ALL_NULL = {
    ("feature_long", "concentration"): "untreated objects have no dose",
    ("growth_curve", "concentration"): "untreated objects have no dose",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_column_is_all_null(duck, name):
    """A column without a single value checks nothing."""
    rel = duck.execute(ORACLE[name]).df()
    assert len(rel) > 0
    empty = {c for c in rel.columns if rel[c].isna().all()} - {c for q, c in ALL_NULL if q == name}
    assert not empty


def test_assay_rows_are_fitted(duck):
    """A14, A15, F6, F7, P2, P3, W2 and the ratio metric act on the surrogates."""
    import numpy as np

    def rows(name):
        return duck.execute(ORACLE[name]).df()

    fit = rows("assay_fit")
    assert (fit["n_points"] >= 3).any() and fit["slope"].notna().any() and fit["r2"].notna().any()
    assert (rows("assay_points")["n"] > 1).any()
    ratio = rows("dose_response_ratio")["live_mean"]
    assert np.isinf(ratio).any() and np.isfinite(ratio).any()
    assert len(rows("curve_table")) < len(rows("dose_response_proportion"))
    plates = duck.execute("WITH " + oracle.PLATES + " SELECT (SELECT count(*) FROM plates) AS n, (SELECT count(*) FROM bgp) AS m, "
                          "(SELECT count(DISTINCT compound) FROM plates) AS c").fetchone()
    assert plates[1] < plates[0] and plates[2] >= 6
    assert len(rows("assay_concordance")["day"].unique()) == 3


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["dose_response_proportion", "feature_heatmap_z", "transition_links",
                                  "method_compare_same", "feature_density", "majority_vote", "curve_extents"])
def test_no_python_in_plans(spark, monkeypatch, name):
    """Neither the query's plan nor that of any table it materialises on the way runs Python
    (the numbering of visits, in its own module, is the one exception and is left out here)."""
    from vitaplate.functions import ranking
    from vitaplate.operators import features, transitions

    plans = []

    def recorded(df):
        plans.append(_plan(df))
        return ranking.checkpointed(df)

    for module in (features, transitions):
        monkeypatch.setattr(module, "checkpointed", recorded)
    plans.append(_plan(QUERIES[name](spark, SF_SMALL)))
    if name in ("feature_density", "transition_links"):
        assert len(plans) > 1
    for plan in plans:
        assert not any(w in plan for w in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "InPandas", "InArrow"))


def test_heatmap_scan_reads_only_selected_features(spark):
    plan = _plan(QUERIES["feature_heatmap_z"](spark, SF_SMALL))
    scan = [ln for ln in plan.splitlines() if "lineitem" in ln][0]
    assert "l_partkey" in scan  # the NA pattern of the texture feature needs it
    # well column and dose are not keys of this heatmap: their columns are never read
    assert "l_linenumber" not in scan and "l_discount" not in scan


def test_transitions_limit_rows_per_object_before_shuffle(spark):
    from vitaplate.operators import transitions as TR
    from vitaplate.plans import surrogates as S

    df = TR.link_table(TR.tracked_cohort(S.visits(spark, SF_SMALL)))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
          "date": "DATE", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_types_match_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    got = {f.name: _TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    want = {r[0]: r[1] for r in duck.execute(f"DESCRIBE {ORACLE[name]}").fetchall()}
    assert got == want


@pytest.mark.parametrize("name", ["dose_response_ratio", "plate_normalised", "assay_concordance", "feature_heatmap_rms"])
def test_same_results_with_ansi_mode_off(spark, duck, name):
    old = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        df = QUERIES[name](spark, SF_SMALL)
        cols = sorted(df.columns)
        got = Counter(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.ansi.enabled", old)
    rel = duck.execute(ORACLE[name])
    idx = {d[0]: i for i, d in enumerate(rel.description)}
    assert got == Counter(tuple(_norm(r[idx[c]]) for c in cols) for r in rel.fetchall())


def test_censoring_and_both_extent_rules_act_on_the_surrogates(spark):
    """F10 drops points of some treatment, and A12's two rules give different lower limits."""
    fits = QUERIES["assay_fit_censored"](spark, SF_SMALL).collect()
    assert sum(r.n_points or 0 for r in fits) < sum(r.all_points for r in fits)
    limits = {(r.compound, r.clamp): r.y_min for r in QUERIES["change_extents"](spark, SF_SMALL).collect()}
    assert any(limits[c, True] == 0.0 > limits[c, False] for c, clamp in limits if clamp)


def test_entry_swallows_only_a_missing_subpackage():
    import subprocess
    import sys

    from tests.conftest import ROOT

    code = "import sys; sys.modules['{}'] = None; import __spark_entry__ as e; print(len(e.queries()))"
    gone = subprocess.run([sys.executable, "-c", code.format("vitaplate.llm")], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert gone.returncode == 0 and int(gone.stdout.split()[-1]) == len(QUERIES)
    broken = subprocess.run([sys.executable, "-c", code.format("pyarrow") + ""], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert broken.returncode != 0
