"""Tracked objects: persistence cohort (T3), state-transition links (T1) and nodes.

The reference spells out 48 near-identical pipelines, one per (stage, source
state, target state).  Here one window numbers each object's visits, a second
(same partitioning, no new shuffle) looks one visit ahead, and a join to the
three-row stage table keeps the consecutive pairs that the stages name; a
single grouped count then yields every link at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitaplate.functions.names import quoted
from vitaplate.functions.nulls import key_concat
from vitaplate.functions.ranking import checkpointed, domain_codes
from vitaplate.operators.clean import (
    STATUS_DD,
    STATUS_DL,
    STATUS_LD,
    STATUS_LL,
    concordance_status,
    link_group,
    seconds_to_days,
)

# The three stages as (position of the source visit, its day, the next visit's day).
STAGES = ((1, 0, 1), (2, 1, 3), (3, 3, 7))
# The concordance states that make links, in their order ("0" makes none).
STATES = (STATUS_DD, STATUS_DL, STATUS_LD, STATUS_LL)
# Every value a concordance state can take ("0" when a call is missing or not 0/1).
STATUS_DOMAIN = ("0", STATUS_DD, STATUS_DL, STATUS_LD, STATUS_LL)


# What every measurement header of a tracked-object table begins with, and the rest of
# the headers of the two live calls (by image, by dye) and of the dye's intensity.
TRACKED_PREFIX = "Tracked.Organoids.Selected.Selected..."
ML_LIVE, VD_LIVE, INTENSITY = "Live", "Live..DRAQ7..", "Intensity.Nucleus.Mean.Smoothed.Mean"


def prepare_tracked(df: DataFrame) -> DataFrame:
    """P10 + P11 + P12 + P14: a tracked-object table (as read by ``read_tracked``) in visit form.

    The three measurements that the operators read keep short names, all other
    "Tracked..." columns are dropped, the object id is Row_Column_Field_Object.ID and the time in seconds becomes
    whole days (half to even).  Output columns: id, compound, day, ml_live,
    vd_live, intensity (plus the remaining input columns).
    """
    kept = [c for c in df.columns if not c.startswith("Tracked") and c != "Timepoint"]
    measured = {"ml_live": ML_LIVE, "vd_live": VD_LIVE, "intensity": INTENSITY}
    out = df.select(*map(quoted, kept), *[quoted(TRACKED_PREFIX + h).alias(n) for n, h in measured.items()])
    return out.withColumns({
        "id": key_concat("_", "Row", "Column", "Field", "Object.ID"),
        "compound": F.col("Compound"),
        "day": seconds_to_days(F.col("`Time..s.`")),
    })


def tracked_cohort(
    visits: DataFrame,
    obj: str = "id",
    group: str = "compound",
    day: str = "day",
    ml: str = "ml_live",
    vd: str = "vd_live",
    carry: tuple[str, ...] = ("intensity",),
    min_visits: int = 5,
    drop_day: int = 2,
) -> DataFrame:
    """Objects seen at >= ``min_visits`` visits, their concordance state, minus ``drop_day``.

    Visit counts are a grouped aggregate (partial counts per task, so an object
    with a huge number of rows is no hotter than any other) and a left-semi join
    keeps the qualifying objects' rows.  ``status_num`` is the state's code among
    the states present before the day filter (R factor codes), taken from the
    fixed state domain.  Rows are then made distinct.
    """
    counts = visits.groupBy(group, obj).agg(F.count(F.lit(1)).alias("_visits")).where(F.col("_visits") >= min_visits)
    counts = counts.select(F.col(group).alias("_g"), F.col(obj).alias("_o"))
    cond = visits[group].eqNullSafe(counts["_g"]) & visits[obj].eqNullSafe(counts["_o"])
    kept = visits.join(counts, cond, "left_semi").withColumn("status", concordance_status(ml, vd))
    coded = domain_codes(kept, "status", "status_num", STATUS_DOMAIN)
    return coded.where(F.col(day) != drop_day).select(obj, day, "status", "status_num", *carry, group).distinct()


def _stage_table(spark, stages) -> DataFrame:
    # One row per stage, given by the caller: a fixed, tiny table, safe to broadcast.
    return F.broadcast(spark.createDataFrame(
        [(i + 1, pos, d0, d1) for i, (pos, d0, d1) in enumerate(stages)],
        "stage int, _pos int, _d0 long, _d1 long",
    ))


def _state_order(state, states) -> Column:
    """A state's place: in ``states``, or by its text (the order of factor codes)."""
    return state if states is None else F.array_position(F.array(*map(F.lit, states)), state)


def link_table(
    cohort: DataFrame,
    obj: str = "id",
    group: str = "compound",
    day: str = "day",
    tiebreak: tuple[str, ...] = ("status", "intensity"),
    stages: tuple[tuple[int, int, int], ...] = STAGES,
    state: str = "status",
    states: tuple[str, ...] | None = STATES,
) -> DataFrame:
    """Per group, how many objects go from (day, state) at visit i to (day', state') at visit i+1.

    ``stages`` lists (source visit position, its day, the next visit's day).
    ``state`` is a text column; with ``states`` only these make links, in that
    order, and with None every state that occurs does, in the order of its text (a
    missing one prints "NA").  Visit positions follow ``day`` (then ``tiebreak`` for a stable order).  Only
    the visits the stages name matter (the first four by default), and a
    ``row_number() <=`` filter lets Spark keep that many rows per object on the
    map side before the shuffle.  Output rows
    are ordered per group by stage, source state descending and target
    state ascending (``link_order``); pairs that never occur are absent.
    """
    spark = cohort.sparkSession
    w = Window.partitionBy(group, obj).orderBy(F.col(day).asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in tiebreak])
    shown = F.coalesce(F.col(state), F.lit("NA"))
    last = max(pos for pos, _, _ in stages) + 1  # the latest visit any stage looks at
    first4 = cohort.withColumn("_pos", F.row_number().over(w)).where(F.col("_pos") <= last)
    paired = first4.withColumns({
        "_next_day": F.lead(day).over(w),
        "_state": shown,
        "_next_state": F.lead(shown).over(w),
    }).where(F.col("_next_day").isNotNull())
    st = _stage_table(spark, stages)
    hits = paired.join(
        st,
        (paired["_pos"] == st["_pos"]) & (paired[day] == st["_d0"]) & (paired["_next_day"] == st["_d1"]),
    )
    if states is not None:
        hits = hits.where(F.col("_state").isin(*states) & F.col("_next_state").isin(*states))
    links = hits.groupBy(group, "stage", F.col("_state").alias("src_state"), F.col("_next_state").alias("tgt_state"),
                         F.col(day).alias("src_day"), F.col("_next_day").alias("tgt_day")).agg(
        F.count(F.lit(1)).alias("count"))
    links = links.withColumns({
        "source": F.concat_ws("_", F.col("src_day").cast("string"), F.col("src_state")),
        "target": F.concat_ws("_", F.col("tgt_day").cast("string"), F.col("tgt_state")),
    })
    # A link for each pair of states, stage and group at most: a per-group window is bounded by the alphabet.
    order = Window.partitionBy(group).orderBy("stage", _state_order(F.col("src_state"), states).desc(), _state_order(F.col("tgt_state"), states).asc())
    links = links.withColumn("link_order", F.row_number().over(order).cast("int"))
    links = links.withColumn("group", link_group("source"))
    return links.select(group, "stage", "link_order", "source", "target", "count", "group")


def transition_links(
    cohort: DataFrame,
    obj: str = "id",
    group: str = "compound",
    day: str = "day",
    tiebreak: tuple[str, ...] = ("status", "intensity"),
    stages: tuple[tuple[int, int, int], ...] = STAGES,
    state: str = "status",
    states: tuple[str, ...] | None = STATES,
) -> DataFrame:
    """T1, materialised: :func:`link_table` written once (a row per pair of states, stage and group at most),
    since nodes and node ids read it several times."""
    return checkpointed(link_table(cohort, obj, group, day, tiebreak, stages, state, states))


def transition_nodes(links: DataFrame, group: str = "compound") -> DataFrame:
    """Node table per group: names in order of first appearance (sources, then targets), 0-based ids.

    Node group "a" when the state's two calls agree, "b" otherwise.  Returns
    (nodes, links_with_ids).
    """
    # all sources come before all targets, however many links there are
    ends = links.select(group, F.explode(F.array(
        F.struct(F.col("source").alias("name"), F.struct(F.lit(0).alias("side"), "link_order").alias("_k")),
        F.struct(F.col("target").alias("name"), F.struct(F.lit(1).alias("side"), "link_order").alias("_k")),
    )).alias("e")).select(group, "e.name", "e._k")
    first = ends.groupBy(group, "name").agg(F.min("_k").alias("_k"))
    # At most 16 nodes per group.
    w = Window.partitionBy(group).orderBy("_k")
    nodes = first.withColumn("node_id", (F.row_number().over(w) - 1).cast("int"))
    ml = F.regexp_extract("name", r"_(.)-ML_(.)", 1)
    vd = F.regexp_extract("name", r"_(.)-ML_(.)", 2)
    nodes = nodes.withColumn("node_group", F.when(ml == vd, "a").otherwise("b")).select(group, "name", "node_id", "node_group")
    src = nodes.select(F.col(group).alias("_g1"), F.col("name").alias("_n1"), F.col("node_id").alias("id_source"))
    tgt = nodes.select(F.col(group).alias("_g2"), F.col("name").alias("_n2"), F.col("node_id").alias("id_target"))
    with_ids = (
        links.join(src, links[group].eqNullSafe(src["_g1"]) & (links["source"] == src["_n1"]))
        .join(tgt, links[group].eqNullSafe(tgt["_g2"]) & (links["target"] == tgt["_n2"]))
        .drop("_g1", "_n1", "_g2", "_n2")
    )
    return nodes, with_ids


__all__ = ["tracked_cohort", "link_table", "transition_links", "transition_nodes", "STAGES", "STATES"]
