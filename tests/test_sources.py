"""Sources and sinks on small generated files (the reference ships no data)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from vitaplate.operators.clean import clean_input, infer_numeric
from vitaplate.sources import files as S
from vitaplate.streaming.ingest import ingest, sheet_stream


def _write(path, text, encoding="utf-8"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding=encoding) as fh:
        fh.write(text)


def test_read_experiments_binds_by_name(spark, tmp_path):
    root = str(tmp_path / "raw")
    _write(f"{root}/20170530_12737_IRI/D0_Live.csv",
           "Display,Row,Column,Compound,Concentration,Cell Type,Live Region Area [µm²]\n"
           "1,A,1,IRI,20,12737 CRC,100.5\n2,A,2,,,12737 CRC,80\n")
    _write(f"{root}/20170530_12737_IRI/D0_Dead.csv",
           "Display,Row,Column,Compound,Concentration,Cell Type,Dead Region Area [µm²],- Object ID\n"
           "3,A,1,IRI,20,12737 CRC,50,7\n")
    _write(f"{root}/20171012_12415_OXA/D3_Live.csv",
           "Row,Display,Column,Compound,Cell Type,Concentration,Live Region Area [µm²]\n"
           "B,9,4,control,12415,5,42\n")
    df = S.read_experiments(spark, root)
    assert {"Region Area [µm²]", "Object ID", "ExpID", "Day", "LD"} <= set(df.columns)
    rows = {(r.ExpID, r.Day, r.LD, r.Display): r for r in df.collect()}
    assert len(rows) == 4
    dead = rows[("20170530_12737_IRI", 0, "Dead", "3")]
    assert dead["Object ID"] == "7" and dead["Region Area [µm²]"] == "50"
    other = rows[("20171012_12415_OXA", 3, "Live", "9")]
    assert other.Row == "B" and other.Concentration == "5" and other["Object ID"] is None
    cleaned = clean_input(df, compound="Compound", concentration="Concentration", patient="Cell Type")
    typed = infer_numeric(cleaned, columns=[c for c in df.columns if c != "Cell Type"])  # patient stays a label
    got = {r.Display: (r.Compound, r.Concentration, r["Cell Type"]) for r in typed.collect()}
    assert got[2.0] == ("Media", None, "12737") and got[9.0] == ("Media", 5.0, "12415")  # Display is numeric too
    assert dict(typed.dtypes)["Region Area [µm²]"] == "double"


def test_read_plate_files(spark, tmp_path):
    text = ("Compound,1,2,3\nA,IRI,IRI,ATP\nB,media,STA,ATP\n\n"
            "Concentration,1,2,3\nA,20,40,0\nB,,5,0\n\n"
            "Signal,1,2,3\nA,100,90,5\nB,120,30,7\n")
    _write(str(tmp_path / "plates" / "p1.csv"), text)
    df = S.read_plate_files(spark, str(tmp_path / "plates"))
    got = {r.well: (r.Compound, r.Concentration, r.Signal) for r in df.collect()}
    assert got["A01"] == ("IRI", 20.0, 100.0) and got["B01"] == ("media", None, 120.0) and len(got) == 6


def test_plate_wells_from_grid(spark):
    grid = spark.createDataFrame([("A", 1.0, None), ("B", 3.0, 4.0)], "r string, `1` double, `2` double")
    got = sorted(tuple(r) for r in S.plate_wells(grid, "r", "signal").collect())
    assert got == [("A01", "A", 1, 1.0), ("A02", "A", 2, None), ("B01", "B", 1, 3.0), ("B02", "B", 2, 4.0)]


def test_survey_and_tracked_csv(spark, tmp_path):
    _write(str(tmp_path / "survey.csv"),
           "Timestamp,Email Address,Group,Organoid 1 (A.15),Organoid 2 (C.41)\n"
           "2018-01-01,a@x,experimental,Live,Dead\n")
    sv = S.read_survey(spark, str(tmp_path / "survey.csv"))
    assert sv.columns == ["Timestamp", "Email.Address", "Group", "A.15", "C.41"]
    _write(str(tmp_path / "tracked.csv"), "Row,Time [s],Intensity µ\n1,86400,2.5\n", encoding="latin-1")
    tr = S.read_tracked(spark, str(tmp_path / "tracked.csv"))
    assert tr.columns == ["Row", "Time..s.", "Intensity.µ"]
    assert tr.collect()[0]["Time..s."] == 86400


def test_partitioned_sink_prunes(spark, tmp_path):
    df = spark.createDataFrame([("E1", 0, 1.0), ("E1", 3, 2.0), ("E2", 3, 3.0)], "exp_id string, day int, v double")
    out = str(tmp_path / "sink")
    S.write_partitioned(df, out)
    back = spark.read.parquet(out).where((F.col("exp_id") == "E1") & (F.col("day") == 3))
    assert [r.v for r in back.collect()] == [2.0]
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "exp_id" in plan


def test_streaming_ingest_is_incremental(spark, tmp_path):
    root = str(tmp_path / "incoming")
    header = "Display,Compound,Live Region Area\n"
    _write(f"{root}/ExpA/D0_Live.csv", header + "1,IRI,10\n2,IRI,11\n")
    stream = sheet_stream(spark, root, ["Display", "Compound", "Live Region Area"])
    sink, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    q = ingest(stream, sink, checkpoint=ckpt)
    q.awaitTermination(120)
    assert spark.read.parquet(sink).count() == 2
    _write(f"{root}/ExpB/D3_Live.csv", header + "3,STA,12\n")
    q = ingest(sheet_stream(spark, root, ["Display", "Compound", "Live Region Area"]), sink, checkpoint=ckpt)
    q.awaitTermination(120)
    back = spark.read.parquet(sink)
    assert back.count() == 3
    assert sorted((r.ExpID, r.Day, r.LD) for r in back.select("ExpID", "Day", "LD").distinct().collect()) == [
        ("ExpA", 0, "Live"), ("ExpB", 3, "Live")]
    assert "Region Area" in back.columns


# Measurement headers of a tracked-object table, the unused ones invented.
TRACKED_HEADERS = ["Tracked.Organoids.Selected.Selected..." + h for h in (
    "Live", "Dead", "Count", "Dead..DRAQ7..", "Live..DRAQ7..", "Intensity.Nucleus.Mean.Smoothed.Mean")]


def test_tracked_csv_to_transitions(spark, tmp_path):
    from vitaplate.operators import transitions as TR

    hdr = ["Row", "Column", "Field", "Object.ID", "Compound", "Timepoint", "Time..s."] + TRACKED_HEADERS
    lines = [",".join(hdr)]
    # one object, visits at 0, 1, 2 (1.5 days rounds to 2), 3 and 7 days; calls flip at day 1
    for i, secs in enumerate([0, 86400, 129600, 259200, 604800]):
        live = 1 if secs == 0 else 0
        lines.append(",".join(map(str, [1, 2, 3, 4, "Media", i, secs, live, 1 - live, 5, 0, live, 1.5])))
    _write(str(tmp_path / "tracked.csv"), "\n".join(lines) + "\n", encoding="latin-1")
    visits = TR.prepare_tracked(S.read_tracked(spark, str(tmp_path / "tracked.csv")))
    assert sorted(r.day for r in visits.collect()) == [0, 1, 2, 3, 7]
    assert {r.id for r in visits.collect()} == {"1_2_3_4"}
    links = TR.transition_links(TR.tracked_cohort(visits))
    got = sorted((r.source, r.target) for r in links.collect())
    assert got == [("0_L-ML_L-VD", "1_D-ML_D-VD"), ("1_D-ML_D-VD", "3_D-ML_D-VD"), ("3_D-ML_D-VD", "7_D-ML_D-VD")]


def test_sheet_layouts_match_first_line(spark, tmp_path):
    paths = []
    for i in range(5):
        p = str(tmp_path / "h" / f"f{i}.csv")
        _write(p, f"col{i},x\n" + "".join(f"{j},{j}\n" for j in range(200)))
        paths.append(p)
    files = S.list_files(spark, str(tmp_path / "h" / "*.csv"))
    got = S.sheet_layouts(spark, files)
    assert {f: header for header, fs in got.items() for f in fs} == {f: S.first_line(spark, f) for f in files}
    assert sorted(got) == [f"col{i},x" for i in range(5)]


def test_read_experiments_from_parquet_exports(spark, tmp_path):
    import pandas as pd

    root = str(tmp_path / "pq")
    os.makedirs(f"{root}/E1")
    pd.DataFrame({"Display": ["1"], "Row": ["A"], "Compound": ["IRI"], "Concentration": ["20"]}) \
        .to_parquet(f"{root}/E1/D0_Live.parquet")
    pd.DataFrame({"Display": ["2"], "Row": ["B"], "Compound": ["media"], "Concentration": [None],
                  "- Object ID": ["7"]}).to_parquet(f"{root}/E1/D3_Dead.parquet")
    df = S.read_experiments(spark, root, fmt="parquet")
    got = sorted((r.Display, r.ExpID, r.Day, r.LD, r["Object ID"]) for r in df.collect())
    assert got == [("1", "E1", 0, "Live", None), ("2", "E1", 3, "Dead", "7")]


def test_plate_layout_files_to_normalised_signal(spark, tmp_path):
    from vitaplate.operators import assay as A

    text = ("Compound,1,2,3,4\nA,ATP,ATP,media,IRI\nB,media,IRI,IRI,STA\n\n"
            "Concentration,1,2,3,4\nA,0,0,,20\nB,,20,40,5\n\n"
            "Signal,1,2,3,4\nA,10,12,111,61\nB,91,41,31,71\n")
    _write(str(tmp_path / "plates" / "p1.csv"), text)
    raw = S.read_plate_files(spark, str(tmp_path / "plates"))
    plates = raw.select(
        F.lit("p1").alias("plate"), F.lit(3).alias("day"), F.col("Compound").alias("compound"),
        F.col("Concentration").try_cast("double").alias("concentration"),
        F.col("Signal").try_cast("double").alias("signal"),
    )
    bg = A.subtract_background(plates)
    got = {(r.compound, r.concentration): r.signal for r in bg.collect()}
    assert got[("Media", None)] in (100.0, 80.0) and got[("IRI", 20.0)] in (50.0, 30.0)
    norm = {(r.compound, r.concentration, r.day): (r.mean, r.norm_mean) for r in A.plate_normalised(bg).collect()}
    assert norm[("Media", None, 3)] == (90.0, 1.0)          # (100 + 80) / 2, relative to itself
    assert norm[("IRI", 20.0, 3)] == (40.0, 40.0 / 90.0)    # (50 + 30) / 2
    assert norm[("STA", 5.0, 3)] == (60.0, 60.0 / 90.0)


def test_streaming_layout_from_existing_sheet(spark, tmp_path):
    root = str(tmp_path / "incoming2")
    _write(f"{root}/ExpA/D1_Dead.csv", "Display,Compound,Dead Region Area\n1,STA,3\n")
    q = ingest(sheet_stream(spark, root), str(tmp_path / "out2"), checkpoint=str(tmp_path / "ckpt2"))
    q.awaitTermination(120)
    back = spark.read.parquet(str(tmp_path / "out2"))
    assert back.count() == 1 and "Region Area" in back.columns
    assert [(r.ExpID, r.Day, r.LD) for r in back.collect()] == [("ExpA", 1, "Dead")]


def test_folder_names_with_space_and_plus(spark, tmp_path):
    root = str(tmp_path / "odd names")
    _write(f"{root}/IRI 20+STA/D2_Live.csv", "Display,Compound\n1,IRI\n")
    _write(f"{root}/IRI 20+STA/D2_Dead.csv", "Display,Compound,Extra\n2,STA,x\n")
    df = S.read_experiments(spark, root)
    got = sorted((r.ExpID, r.Day, r.LD, r.Display, r.Extra) for r in df.collect())
    assert got == [("IRI 20+STA", 2, "Dead", "2", "x"), ("IRI 20+STA", 2, "Live", "1", None)]


def test_na_cells_and_repeated_headers(spark, tmp_path):
    _write(str(tmp_path / "s.csv"), "Time (s),Vote: A.1,Vote: A.1\n86400,1,NA\nNA,2,x\n")
    df = S.read_tracked(spark, str(tmp_path / "s.csv"))
    assert df.columns == ["Time..s.", "Vote..A.1", "Vote..A.1.1"]
    assert [tuple(r) for r in df.collect()] == [(86400, 1, None), (None, 2, "x")]
    from vitaplate.operators.clean import infer_numeric, seconds_to_days

    assert [r.d for r in df.select(seconds_to_days(F.col("`Time..s.`")).alias("d")).collect()] == [1, None]
    text = spark.createDataFrame([("1", "a"), ("NA", "NA"), ("2.5", "")], "`Object.ID` string, b string")
    typed = infer_numeric(text)
    assert dict(typed.dtypes) == {"Object.ID": "double", "b": "string"}
    assert [r[0] for r in typed.collect()] == [1.0, None, 2.5]


def test_wide_plates_keep_their_wells(spark, tmp_path):
    grid = spark.createDataFrame([tuple(["A", *range(120)])], "r string, " + ", ".join(f"`{i}` int" for i in range(1, 121)))
    wells = [r.well for r in S.plate_wells(grid, "r").collect()]
    assert len(set(wells)) == 120 and {"A01", "A99", "A100", "A120"} <= set(wells)
    head = ",".join(map(str, range(1, 121)))
    _write(str(tmp_path / "w" / "p.csv"), f"Signal,{head}\nA," + ",".join(str(10 * i) for i in range(1, 121)) + "\n")
    got = {r.well: r.Signal for r in S.read_plate_files(spark, str(tmp_path / "w"), blocks=["Signal"]).collect()}
    assert len(got) == 120 and got["A120"] == 1200.0


def test_unreadable_parquet_is_an_error(spark, tmp_path):
    import pytest

    _write(str(tmp_path / "x" / "E1" / "D0_Live.parquet"), "not parquet")
    with pytest.raises(Exception, match="(?i)parquet|footer"):
        S.read_experiments(spark, str(tmp_path / "x"), fmt="parquet").count()


def test_large_sheet_is_written_in_parts(spark, tmp_path):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "20000")
    try:
        df = spark.range(20000, numPartitions=8).selectExpr("'E1' as ExpID", "0 as Day", "'Live' as LD", "id", "sha2(string(id), 256) as text")
        S.write_experiments(df, str(tmp_path / "x"))
    finally:
        spark.conf.set(key, before)
    assert len(S.list_files(spark, f"{tmp_path}/x/*/*/*.csv")) > 1
    read = S.read_experiments(spark, str(tmp_path / "x"))
    assert read.count() == 20000
    assert [tuple(r) for r in read.select("ExpID", "Day", "LD").distinct().collect()] == [("E1", 0, "Live")]
