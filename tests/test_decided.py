"""Operators that decide from observed metrics, the type lattice, sheets in folders and the replacing sink."""

from __future__ import annotations

from collections import Counter

import pytest

from vitaplate.operators import clean as C
from vitaplate.operators import transitions as TR
from vitaplate.operators.reshape import unify
from vitaplate.plans.workflows import objects_from_exports
from vitaplate.sources import files as S


def test_unify_decides_each_column_from_the_data(spark):
    left = spark.createDataFrame([(1, "x", "p", None, 1.0), (2, "y", "q", None, 2.0), (3, "z", None, None, 3.0)], "k int, a string, b string, c string, only_l double")
    right = spark.createDataFrame([(1, "x", "p", "1", 9), (2, "y", "other", "2", 8)], "k int, a string, b string, c string, only_r int")
    out = unify(left, right, "k", "_l", "_r")
    # a agrees on all pairs, b differs once, c has no complete pair
    assert out.columns == ["k", "only_l", "only_r", "a", "b_r", "b_l", "c"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, 1.0, 9, "x", "p", "p", "1"), (2, 2.0, 8, "y", "other", "q", "2"), (3, 3.0, None, None, None, None, None)], key=str)


def test_unify_of_empty_tables_collapses(spark):
    empty = spark.createDataFrame([], "k int, a string")
    assert unify(empty, empty, "k", "_l", "_r").columns == ["k", "a"]


def test_unify_reads_its_input_once(spark, tmp_path):
    path = str(tmp_path / "l")
    spark.createDataFrame([(i, "a") for i in range(50)], "k int, a string").write.parquet(path)
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    left = spark.read.parquet(path).mapInArrow(count, "k int, a string")
    unify(left, spark.read.parquet(path), "k", "_l", "_r").collect()
    assert reads.value == 50


def test_unique_rows_match_unique_by(spark):
    rows = [("a", 1), ("a", 2), ("b", 3), (None, 4), ("c", None)] + [("hot", i) for i in range(500)]
    df = spark.createDataFrame(rows, "key string, _n int").repartition(5)
    kept, report = C.unique_rows(df, "key")
    want, old = C.unique_by(df, "key")
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert report == old.first().asDict() == {"total_rows": 505, "kept_rows": 3, "removed_rows": 502}
    kept, report = C.unique_rows(df.where("key = 'none'"), "key")
    assert kept.count() == 0 and report == {"total_rows": 0, "kept_rows": 0, "removed_rows": 0}


@pytest.mark.parametrize("values, kind", [
    (["T", "false", "NA"], "logical"), (["1", " -20 ", ""], "integer"), (["1", "2.5", ".5", "1e3"], "double"),
    (["2020-02-29", None], "date"), (["2020-02-30"], "text"), (["T", "1"], "text"), (["2020-01-01", "3"], "text"),
    (["NA", "", None], "logical"), (["1d", "2"], "text"), (["NaN"], "text"), (["99999999999999999999"], "double"), (["a"], "text"),
])
def test_type_lattice(spark, values, kind):
    df = spark.createDataFrame([(v,) for v in values], "`a b` string")
    assert C.column_types(df) == {"a b": kind}
    simple = {"logical": "boolean", "integer": "bigint", "double": "double", "date": "date", "text": "string"}
    out = C.infer_types(df)
    assert out.dtypes == [("a b", simple[kind])]
    assert sum(r[0] is None for r in out.collect()) == sum(v is None or v.strip() in ("", "NA") for v in values)


def test_type_lattice_is_independent_of_row_order(spark):
    cells = ["NA", "7", "8.5", "2021-03-04", "TRUE"]
    for drop in range(2, 5):
        rows = [(c,) for c in cells[:drop]]
        a, b = (C.column_types(spark.createDataFrame(r, "v string")) for r in (rows, rows[::-1]))
        assert a == b


def test_sheets_in_folders_round_trip(spark, tmp_path):
    root = str(tmp_path / "all exports")
    live = spark.createDataFrame([("E 1", 0, "Live", "A", "control", "NA", "1.5", "T"), ("E2", 10, "Live", "B", "IRI", "20", None, "F")],
                                 "ExpID string, Day int, LD string, Row string, Compound string, Concentration string, `Live Area` string, Seen string")
    dead = spark.createDataFrame([("E 1", 0, "Dead", "A", None, "5", "2")], "ExpID string, Day int, LD string, Row string, Compound string, Concentration string, `- Area` string")
    S.write_experiments(live, root)
    S.write_experiments(dead, root)
    files = S.list_files(spark, f"{root}/*/*/*.csv")
    layouts = S.sheet_layouts(spark, files)
    assert sorted(map(len, layouts.values())) == [1, 2] and sorted(sum(layouts.values(), [])) == files
    out = objects_from_exports(spark, root, all_types=True)
    assert dict(out.dtypes)["Seen"] == "boolean"
    got = {(r.exp_id, r.day, r.ld, r.plate_row, r.compound, r.concentration, r.Area, r.Seen) for r in out.collect()}
    assert got == {("E 1", 0, "Live", "A", "Media", None, 1.5, True), ("E2", 10, "Live", "B", "IRI", 20, None, False), ("E 1", 0, "Dead", "A", "Media", 5, 2.0, None)}


def test_partitioned_sink_replaces_only_what_it_writes(spark, tmp_path):
    out = str(tmp_path / "sink")
    S.write_partitioned(spark.createDataFrame([("E1", 0, 1.0), ("E1", 3, 2.0), ("E2", 3, 3.0)], "exp_id string, day int, v double"), out)
    S.write_partitioned(spark.createDataFrame([("E1", 3, 20.0)], "exp_id string, day int, v double"), out)
    assert sorted((r.exp_id, r.day, r.v) for r in spark.read.parquet(out).collect()) == [("E1", 0, 1.0), ("E1", 3, 20.0), ("E2", 3, 3.0)]
    S.write_partitioned(spark.createDataFrame([("E9", 1, 5.0)], "exp_id string, day int, v double"), out, whole=True)
    assert [tuple(r)[0] for r in spark.read.parquet(out).select("v").collect()] == [5.0]


def test_links_of_any_state_match_brute_force(spark):
    import random

    rnd = random.Random(5)
    rows = []
    for i in range(300):
        for day in (0, 1, 3, 7):
            if rnd.random() < 0.8:
                rows.append((f"o{i}", rnd.choice(["Media", "STA"]) if i % 9 == 0 else ["Media", "STA"][i % 2], day, rnd.choice(["open", "shut", "ajar", None]), rnd.random()))
    df = spark.createDataFrame(rows, "id string, compound string, day long, mood string, intensity double")
    want = Counter()
    objects = {}
    for o, g, day, mood, x in rows:
        objects.setdefault((g, o), []).append((day, mood or "NA"))
    for (g, _), seen in objects.items():
        seen.sort()
        for stage, (pos, d0, d1) in enumerate(TR.STAGES, 1):
            if len(seen) > pos and seen[pos - 1][0] == d0 and seen[pos][0] == d1:
                want[g, stage, f"{d0}_{seen[pos - 1][1]}", f"{d1}_{seen[pos][1]}"] += 1
    links = TR.link_table(df, tiebreak=("intensity",), state="mood", states=None)
    got = links.collect()
    assert {(r.compound, r.stage, r.source, r.target): r["count"] for r in got} == dict(want)
    for g in ("Media", "STA"):
        order = sorted((r.link_order, r.stage, r.source, r.target) for r in got if r.compound == g)
        by_target = sorted(((s, a, b) for _, s, a, b in order), key=lambda x: x[2])
        assert [x[1:] for x in order] == sorted(sorted(by_target, key=lambda x: x[1], reverse=True), key=lambda x: x[0])
    some = TR.link_table(df, tiebreak=("intensity",), state="mood", states=("shut", "open"))
    assert {(r.compound, r.stage, r.source, r.target): r["count"] for r in some.collect()} == {k: n for k, n in want.items() if {k[2][2:], k[3][2:]} <= {"open", "shut"}}
