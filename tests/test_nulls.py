
from __future__ import annotations

import math

from pyspark.sql import functions as F

from vitaplate.functions.nulls import (
    finite,
    ieee_div,
    key_concat,
    mean_strict,
    nan_to_null,
    not_in_keep_null,
    null_safe_on,
    num_label,
)


def test_ieee_div_cases(spark):
    df = spark.createDataFrame(
        [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (0.0, 2.0), (3.0, 2.0), (None, 1.0), (1.0, None),
         (float("inf"), float("inf")), (2.0, float("inf"))],
        "n double, d double",
    )
    got = [r.q for r in df.select(ieee_div("n", "d").alias("q")).collect()]
    assert got[0] == math.inf and got[1] == -math.inf
    assert got[2] is None  # 0/0 is NaN in R -> missing
    assert got[3] == 0.0 and got[4] == 1.5
    assert got[5] is None and got[6] is None
    assert got[7] is None  # Inf/Inf is NaN -> missing
    assert got[8] == 0.0


def test_mean_strict_propagates_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 4.0)], "k string, v double")
    got = {r.k: r.m for r in df.groupBy("k").agg(mean_strict("v").alias("m")).collect()}
    assert got == {"a": None, "b": 3.0}


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "v double")
    got = [r.v for r in df.select(nan_to_null("v").alias("v")).collect()]
    assert got == [None, 1.0]


def test_num_label_prints_like_r(spark):
    df = spark.createDataFrame([(20.0,), (0.74,), (0.082,), (0.00001,), (100.0,), (0.0,), (None,), (2.5,),
                                (1e-7,), (2e-7,), (1e13,), (100000.0,), (123456.0,), (-0.5,), (12345678.25,), (0.00012,)], "x double")
    got = [r.t for r in df.select(num_label("x").alias("t")).collect()]
    assert got == ["20", "0.74", "0.082", "1e-05", "100", "0", None, "2.5",
                   "1e-07", "2e-07", "1e+13", "1e+05", "123456", "-0.5", "12345678.25", "0.00012"]


def test_key_concat_prints_na(spark):
    df = spark.createDataFrame([("p", 3, None), ("p", None, 20.0)], "a string, b int, c double")
    got = [r.k for r in df.select(key_concat("_", "a", "b", "c", schema=df.schema).alias("k")).collect()]
    assert got == ["p_3_NA", "p_NA_20"]


def test_not_in_keeps_missing(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    got = sorted((r.x or "NULL") for r in df.where(not_in_keep_null("x", ["a"])).collect())
    assert got == ["NULL", "b"]


def test_finite_filter(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),), (float("-inf"),), (None,)], "v double")
    assert [r.v for r in df.where(finite("v")).collect()] == [1.0]


def test_null_safe_join_matches_missing_dose(spark):
    left = spark.createDataFrame([("Media", None, 1.0), ("IRI", 20.0, 2.0)], "c string, d double, x double")
    right = spark.createDataFrame([("Media", None, 10.0), ("IRI", 20.0, 20.0)], "c string, d double, y double")
    j = left.join(right, null_safe_on(left, right, ["c", "d"]))
    assert j.count() == 2
    plain = left.join(right, (left.c == right.c) & (left.d == right.d))
    assert plain.count() == 1  # the Media row vanishes without null-safe keys


def test_bround_half_even(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (-2.5,)], "x double")
    assert [r.r for r in df.select(F.bround("x").alias("r")).collect()] == [2.0, 4.0, -2.0]
