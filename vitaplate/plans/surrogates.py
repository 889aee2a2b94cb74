"""Surrogate inputs derived from the driver tables (FIXTURES.md §2).

The reference ships no data, so each input it reads is stood in for by a view
over the driver's parquet tables.  The views are written with the DataFrame
API here and in plain SQL in :mod:`vitaplate.plans.oracle`; the two are
independent spellings of the same definition.

The modulo expressions below are part of the surrogate *definitions* (they
decide which visits and which imaging rows are absent, so that the semantic
traps are exercised); no query uses them to shrink its input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitaplate.functions.ranking import checkpointed, sequence_index
from vitaplate.sources.tables import read_table

# Reference-style headers given to the surrogate feature columns, so that the
# feature-name pattern and cleanup rules (F3, F5, P20) act on names shaped like the real ones.
FEATURE_HEADERS = {
    "region_area": "Region Area [µm²]",
    "region_intensity": "Region Intensity Mean 1 px",
    "region_texture": "Region Texture  SER Spot 1 px",
    "object_no": "Object No in Organoids",
}


def object_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem joined to its order and customer.

    Orders meet customers first, so the large lineitem side is shuffled once
    (on the order key); Catalyst prunes every column the caller does not use.
    """
    li = read_table(spark, sf_dir, "lineitem")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    oc = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
    return li.join(oc, li["l_orderkey"] == oc["o_orderkey"])


def _imaging_day():
    """Years 1995 to 2001 as imaging days 0, 1, 2, 3, 5, 7 and 10."""
    y = F.year("l_shipdate") - 1995
    return F.when(y == 4, 5).when(y == 5, 7).when(y == 6, 10).otherwise(y).cast("int")


def _object_columns() -> dict:
    """Output column name -> expression over ``object_base`` (FIXTURES.md §2.1)."""
    rf, ls = F.col("l_returnflag"), F.col("l_linestatus")
    null_dbl = F.lit(None).cast(T.DoubleType())
    return {
        "exp_id": F.concat(F.lit("E"), (F.col("o_custkey") % 4).cast("string")),
        "patient": F.col("c_mktsegment"),
        "compound": F.when(rf == "N", "Media").when(rf == "A", "IRI").otherwise("STA"),
        "concentration": F.when(rf == "N", null_dbl)
        .when(rf == "A", (F.lit(20) * (F.round(F.col("l_discount") * 100).cast("int") % 4)).cast("double"))
        .otherwise(F.lit(5.0)),
        "day": _imaging_day(),
        # one condition all dead on its first day, one without dead objects in half its wells
        "ld": F.when((rf == "R") & (_imaging_day() == 0) & (F.col("c_mktsegment") == "FURNITURE"), "Dead")
        .when((rf == "A") & (F.col("l_suppkey") % 2 == 0) & (F.col("c_mktsegment") == "HOUSEHOLD"), "Live")
        .when(ls == "O", "Live").otherwise("Dead"),
        "plate_row": F.col("l_suppkey") % 2,
        "plate_col": F.col("l_linenumber") % 2 + 1,
        "region_area": F.col("l_quantity"),
        "region_intensity": F.col("l_extendedprice"),
        "region_texture": F.when(F.col("l_partkey") % 97 == 0, null_dbl).otherwise(F.col("l_tax")),
        "object_no": F.col("l_partkey"),
    }


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per segmented object (stands for the cleaned object workbooks)."""
    return object_base(spark, sf_dir).select(*[c.alias(n) for n, c in _object_columns().items()])


def objects_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``objects`` with reference-style feature headers (for the feature pipelines)."""
    df = objects(spark, sf_dir)
    return df.withColumnsRenamed(FEATURE_HEADERS)


def _numbered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as visits of a user on a date, with the day of each visit; some are missing."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    ev = ev.withColumn("vdate", F.col("ts").cast("date"))
    ev = sequence_index(ev, ["ts", "event_id"], groups=["user_id", "vdate"], name="pos0")
    pos = F.col("pos0") + 1
    day = (
        F.when(pos == 1, 0).when(pos == 2, 1).when(pos == 3, 2).when(pos == 4, 3).when(pos == 5, 7).otherwise(pos + 2)
    )
    return ev.where(F.col("event_id") % 11 != 0).withColumns({
        "id": F.concat(F.col("user_id").cast("string"), F.lit("_"), F.col("vdate").cast("string")),
        "compound": F.when(F.col("user_id") % 2 == 0, "Media").otherwise("STA"),
        "day": day.cast("long"),
        "ml_live": F.when(F.col("event_type").isin("click", "view", "purchase"), 1).otherwise(0),
        "vd_live": F.when(F.col("value") >= 10, 1).otherwise(0),
        "intensity": F.col("value"),
    })


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracked objects: one row per (object, visit)."""
    return _numbered_events(spark, sf_dir).select("id", "compound", "day", "ml_live", "vd_live", "intensity")


def event_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same visits with the kind of event as the state, missing for visits of no intensity below 1."""
    state = F.when(F.col("value") >= 1, F.col("event_type"))
    return _numbered_events(spark, sf_dir).select("id", "compound", "day", state.alias("state"), "intensity")


# Raw headers of a tracked-object table, as its instrument prints them.
TRACKED_HEADER = "Tracked Organoids Selected Selected - "


def tracked_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visits as the raw tracked-object table: position columns, seconds, long measurement headers."""
    ev = _numbered_events(spark, sf_dir)
    parts = {"Row": F.col("user_id"), "Column": F.year("vdate"), "Field": F.month("vdate"), "Object ID": F.day("vdate")}
    measured = {"Live": "ml_live", "Live (DRAQ7).": "vd_live", "Intensity Nucleus Mean Smoothed Mean": "intensity"}
    return ev.select(
        *[c.alias(n) for n, c in parts.items()],
        F.col("compound").alias("Compound"),
        F.col("pos0").alias("Timepoint"),
        (F.col("day") * 86400 + F.col("event_id") % 40000).alias("Time [s]"),
        *[F.col(c).alias(TRACKED_HEADER + n) for n, c in measured.items()],
        (F.col("intensity") * 2).alias(TRACKED_HEADER + "Area [µm²]"),
    )


def raw_sheets(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The objects as the instrument exports them: sheets of three layouts, with raw spellings and headers.

    Live and dead sheets name their columns differently, sheets of E3 lack one,
    patients carry a suffix, the control is spelled in four ways, and one column
    each holds truth values, dates and whole numbers as text.  The joined rows are
    written once, since every layout reads them.
    """
    df = objects(spark, sf_dir)
    control = F.when(F.col("plate_col") == 1, F.when(F.col("plate_row") == 0, "control").otherwise("media")).when(F.col("plate_row") == 0, "Media")
    raw = df.select(
        F.col("exp_id").alias("ExpID"), F.col("day").alias("Day"), F.col("ld").alias("LD"),
        F.concat("patient", F.lit(" CRC")).alias("Cell Type"),
        F.when(F.col("compound") == "Media", control).otherwise(F.col("compound")).alias("Compound"),
        F.col("concentration").cast("string").alias("Concentration"),
        F.col("plate_row").alias("Row"), F.col("plate_col").alias("Column"),
        F.col("region_area").alias("{} Region Area [µm²]"), F.col("region_texture").alias("Region Texture {}"),
        F.col("object_no").alias("- Object No"),
        F.when(F.col("object_no") % 5 != 0, F.when(F.col("object_no") % 2 == 0, "TRUE").otherwise("F")).alias("Focused"),
        F.date_add(F.lit("2020-01-01").cast("date"), F.col("day")).cast("string").alias("Imaged"),
    )
    raw = checkpointed(raw)
    out = []
    for call in ("Live", "Dead"):
        sheets = raw.where(F.col("LD") == call).withColumnsRenamed({c: c.format(call) for c in raw.columns})
        out += [sheets.where("ExpID <> 'E3'"), sheets.where("ExpID = 'E3'").drop(f"Region Texture {call}")]
    return out


#: Rows and columns of a surrogate plate: its wells are the positions of the vectors.
PLATE_SIDE = 8


def plate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(plate, ln, value): the lines of four plate layout files, four blocks each, from the mean vectors of four groups."""
    emb = read_table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 4).alias("plate"), F.posexplode("embedding").alias("at", "x"))
    wells = emb.groupBy("plate", "at").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("signal"), F.count(F.lit(1)).alias("n"))
    row, col = F.floor(F.col("at") / PLATE_SIDE).cast("int"), (F.col("at") % PLATE_SIDE).cast("int")
    blocks = {
        "Compound": F.when(row == 0, "Media").when(row == 1, "ATP").otherwise("STA"),
        "Concentration": F.when(col == PLATE_SIDE - 1, "NA").otherwise((col * 0.5).cast("string")),
        "Signal": F.col("signal").cast("string"),
        "Vectors": F.col("n").cast("string"),
    }
    cells = wells.withColumns({"row": row, "col": col})
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("block"), c.alias("cell")) for i, c in enumerate(blocks.values())]))
    cells = cells.select("plate", "row", "col", each.alias("b")).select("plate", "row", "col", "b.*")
    by_row = cells.groupBy("plate", "block", "row").agg(F.sort_array(F.collect_list(F.struct("col", "cell"))).alias("cells"))
    letter = F.char(F.col("row") + 65)
    lines = by_row.select("plate", (F.col("block") * 100 + F.col("row") + 1).alias("ln"), F.concat_ws(",", letter, F.transform("cells", lambda c: c["cell"])).alias("value"))
    numbers = ",".join(str(i + 1) for i in range(PLATE_SIDE))
    heads = F.explode(F.array(*[F.struct(F.lit(i * 100).alias("ln"), F.lit(f"{n},{numbers}").alias("value")) for i, n in enumerate(blocks)]))
    return lines.union(wells.select("plate").distinct().select("plate", heads.alias("h")).select("plate", "h.*"))


def plates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Luminescence assay plates, one row per well: three plates on each of three days.

    The control is spelled in four ways, one of them missing; a dose of 0.25
    occurs; background wells shine a hundredth of the others.
    """
    o = read_table(spark, sf_dir, "orders")
    pr, cust = F.col("o_orderpriority"), F.col("o_custkey")
    day = F.when(cust % 3 == 0, 1).when(cust % 3 == 1, 3).otherwise(7)
    control = F.when(cust % 4 == 0, "Media").when(cust % 4 == 1, "control").when(cust % 4 == 2, "media")
    price = F.col("o_totalprice")
    null_dbl = F.lit(None).cast(T.DoubleType())
    return o.select(
        F.concat("o_orderstatus", day.cast("string")).alias("plate"),
        day.alias("day"),
        F.when(pr == "1-URGENT", control)
        .when(pr == "2-HIGH", "IRI")
        .when(pr == "3-MEDIUM", "STA")
        .when(pr == "5-LOW", "ATP")
        .otherwise("NOC")
        .alias("compound"),
        F.when(pr == "1-URGENT", null_dbl)
        .when(pr == "2-HIGH", (F.lit(20) * (F.col("o_custkey") % 4)).cast("double"))
        .when(pr == "3-MEDIUM", F.lit(5.0))
        .when(pr == "5-LOW", (F.col("o_custkey") % 2).cast("double"))
        .otherwise(F.when(cust % 5 == 0, 0.25).otherwise(1.0))
        .alias("concentration"),
        F.lit("BUILDING").alias("patient"),
        F.when(pr == "5-LOW", price * 0.01).when(pr == "2-HIGH", price * 0.5).when(pr == "3-MEDIUM", price * 0.25)
        .otherwise(price).alias("signal"),
    )


def _side(spark: SparkSession, sf_dir: str, imaging: bool) -> DataFrame:
    base = object_base(spark, sf_dir)
    if imaging:
        base = base.where(F.col("l_suppkey") % 10 != 0)
        call = F.when(F.col("l_quantity") >= 20, "Live").otherwise("Dead")
    else:
        call = F.when(F.col("l_linestatus") == "O", "Live").otherwise("Dead")
    obj = {n: c.alias(n) for n, c in _object_columns().items()}
    return base.select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string")).alias("uid"),
        call.alias("ld"),
        F.col("l_quantity").alias("quantity"),
        obj["compound"],
        obj["concentration"],
        obj["day"],
        obj["patient"],
        obj["plate_row"],
        obj["plate_col"],
    )


def vd_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vital-dye calls per object (UIDs may repeat)."""
    return _side(spark, sf_dir, imaging=False)


def ml_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image-based calls per object; some objects have no imaging row."""
    return _side(spark, sf_dir, imaging=True)


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expert survey stand-in: one row per respondent, vote columns as text."""
    lab = read_table(spark, sf_dir, "labels")
    doc = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    j = lab.join(doc, "doc_id")
    return j.select(
        F.col("doc_id").cast("string").alias("respondent"),
        F.col("source").alias("grp"),
        F.col("lang"),
        F.col("quality").cast("string").alias("quality"),
        F.col("toxic").cast("string").alias("toxic"),
    )


def positions(emb: DataFrame, names) -> list:
    """The positions of the vectors as columns ``names(i)``, i from 1; the width is that of the longest vector."""
    width = emb.agg(F.max(F.size("embedding"))).first()[0] or 0
    return [F.try_element_at("embedding", F.lit(i)).cast("double").alias(names(i)) for i in range(1, width + 1)]


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide plate grid: vec_id is the plate row, array positions the plate columns."""
    emb = read_table(spark, sf_dir, "embeddings")
    return emb.select("vec_id", *positions(emb, str))
