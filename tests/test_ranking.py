"""sequence_index must equal row_number() - 1, including for a group holding most rows."""

from __future__ import annotations

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from vitaplate.functions.ranking import dense_codes, sequence_index, window_index


def _data(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        g = "hot" if rnd.random() < 0.6 else f"g{rnd.randint(0, 20)}"
        rows.append((g if rnd.random() > 0.02 else None, rnd.randint(0, 50), i))
    return spark.createDataFrame(rows, "g string, v int, id int")


def test_grouped_index_matches_row_number(spark):
    df = _data(spark)
    got = sequence_index(df, ["v", "id"], groups=["g"], name="ix", slices=7)
    w = Window.partitionBy("g").orderBy("v", "id")
    want = df.withColumn("ix", F.row_number().over(w) - 1)
    a = sorted((r.id, r.ix) for r in got.select("id", "ix").collect())
    b = sorted((r.id, r.ix) for r in want.select("id", "ix").collect())
    assert a == b


def test_global_index_is_a_permutation_in_order(spark):
    df = _data(spark, n=1000, seed=3)
    got = sequence_index(df, [F.col("v").desc(), "id"], name="ix", slices=5).collect()
    got.sort(key=lambda r: r.ix)
    assert [r.ix for r in got] == list(range(1000))
    keys = [(-r.v, r.id) for r in got]
    assert keys == sorted(keys)


def test_dense_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",), (None,)], "x string")
    got = sorted(((r.x or ""), r.code) for r in dense_codes(df, "x", "code").collect())
    assert got == [("", None), ("a", 1), ("a", 1), ("b", 2), ("c", 3)]


def test_index_survives_small_arrow_batches(spark):
    df = _data(spark, n=2500, seed=13)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = sequence_index(df, ["v", "id"], groups=["g"], name="ix", slices=3)
        a = sorted((r.id, r.ix) for r in got.select("id", "ix").collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    w = Window.partitionBy("g").orderBy("v", "id")
    b = sorted((r.id, r.ix) for r in df.withColumn("ix", F.row_number().over(w) - 1).select("id", "ix").collect())
    assert a == b


def test_index_of_empty_and_single_group_inputs(spark):
    empty = spark.createDataFrame([], "g string, v int")
    assert sequence_index(empty, ["v"], groups=["g"]).count() == 0
    assert sequence_index(empty, ["v"], groups=["g"]).count() == 0
    one = spark.createDataFrame([("a", i) for i in range(50)], "g string, v int")
    got = sorted(r._idx for r in sequence_index(one, ["v"], groups=["g"], slices=6).collect())
    assert got == list(range(50))


def test_domain_codes_match_dense_codes(spark):
    from vitaplate.functions.ranking import domain_codes

    df = spark.createDataFrame([("c",), ("a",), ("c",), (None,), ("e",)], "x string")
    got = sorted(((r.x or ""), r.k) for r in domain_codes(df, "x", "k", ["e", "d", "c", "b", "a"]).collect())
    want = sorted(((r.x or ""), r.k) for r in dense_codes(df, "x", "k").collect())
    assert got == want == [("", None), ("a", 1), ("c", 2), ("c", 2), ("e", 3)]


def test_window_index_numbers_alike(spark):
    df = _data(spark, n=500, seed=21)
    got = window_index(df, ["v", "id"], groups=["g"], name="ix")
    w = Window.partitionBy("g").orderBy("v", "id")
    want = df.withColumn("ix", F.row_number().over(w) - 1)
    assert sorted((r.id, r.ix) for r in got.collect()) == sorted((r.id, r.ix) for r in want.collect())


def test_checkpoint_dir_is_reused_within_a_session(spark):
    from vitaplate.session import ensure_checkpoint_dir

    assert ensure_checkpoint_dir(spark) == ensure_checkpoint_dir(spark)


def test_release_materialised_removes_only_own_tables(spark):
    import os

    from vitaplate.functions.ranking import checkpointed, release_materialised

    release_materialised(spark)  # forget tables of earlier tests
    t = checkpointed(spark.range(10))
    assert t.count() == 10
    path = t.inputFiles()[0].split("/part-")[0].replace("file:", "")
    assert os.path.isdir(path)
    assert release_materialised(spark) == 1
    assert not os.path.exists(path)


def test_tied_values_are_spread_over_slices(spark, monkeypatch):
    """Two thirds of the rows share one group and one value; no slice gets much more than its share."""
    from vitaplate.functions import ranking

    written = []
    plain = ranking.checkpointed
    monkeypatch.setattr(ranking, "checkpointed", lambda df: written.append(plain(df)) or written[-1])
    df = spark.range(30_000).select(F.when(F.col("id") % 3 < 2, "hot").otherwise("cold").alias("g"),
                                    F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id")).alias("v"))
    got = sequence_index(df, ["v"], groups=["g"], name="ix", slices=10)
    assert got.groupBy("g").agg(F.count("ix"), F.countDistinct("ix"), F.max("ix")).count() == 2
    assert {(r.g, r.n, r.d, r.m) for r in got.groupBy("g").agg(
        F.count("ix").alias("n"), F.countDistinct("ix").alias("d"), F.max("ix").alias("m")).collect()} == {
        ("hot", 20_000, 20_000, 19_999), ("cold", 10_000, 10_000, 9_999)}
    sizes = [r["count"] for r in written[1].where("_kind = 0").groupBy("_slice").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 2 * 30_000 / 10
