"""Feature tables: long form, heatmap matrices with row scaling, distances, densities.

Operators R1/R2 + F3/F5/P20 (feature_long), T6 = A4 + W5/W6 (+ R5/R6/R7 sample keys),
T12 (feature distance) and A16 (grouped density).

Feature columns are chosen from ``df.columns`` at plan time, so the Parquet scan
reads only the selected features; means are aggregated *wide* (one mean per
feature column, one shuffle of group partials) and only the small aggregate is
unpivoted.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitaplate.functions.names import clean_feature_label, feature_columns, is_id_like, quoted
from vitaplate.functions.nulls import join_null_safe, key_concat, mean_strict, nan_to_null
from vitaplate.functions.ranking import checkpointed
from vitaplate.operators.reshape import NUMERIC_TYPES, melt


def select_features(df: DataFrame, ids: Sequence[str] | None = None, drop_id_like: bool = True) -> list[str]:
    """F3 + F5 at plan time: feature columns by name pattern, minus id-like features.

    With ``ids`` None (inferred ids, R2) only numeric columns can be features.
    """
    ids = set(ids or [])
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)}
    feats = [c for c in feature_columns(df.columns) if c not in ids and c in numeric]
    if drop_id_like:
        feats = [c for c in feats if not is_id_like(c)]
    return feats


def label_map(features: Sequence[str]) -> dict[str, str]:
    """P20 and P21 at plan time: raw feature header, spaced or dotted -> cleaned label."""
    return {f: clean_feature_label(f, dotted=" " not in f and "." in f) for f in features}


def _label_expr(variable: Column, labels: dict[str, str]) -> Column:
    pairs = []
    for raw, clean in labels.items():
        pairs += [F.lit(raw), F.lit(clean)]
    return F.create_map(*pairs)[variable]


def feature_long(df: DataFrame, ids: Sequence[str] | None = None) -> DataFrame:
    """R1/R2 + F3 + F5 + P20: (ids..., variable, value) for the selected features, NA rows kept.

    ``ids`` None infers them (R2): text columns are ids, numeric columns are
    candidate values (so day and position columns are measured, then dropped by
    the feature pattern).
    """
    if ids is None:
        ids = [f.name for f in df.schema.fields if not isinstance(f.dataType, NUMERIC_TYPES)]
    feats = select_features(df, ids)
    long = melt(df, ids=list(ids), values=feats)
    return long.withColumns({
        "variable": _label_expr(F.col("variable"), label_map(feats)),
        "value": nan_to_null(F.col("value")),
    })


def condition_means(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """A4, wide: NA-propagating mean of every feature per condition, then unpivoted.

    Returns (keys..., variable, mean_val) with cleaned labels.
    """
    agg = df.groupBy(*keys).agg(*[mean_strict(quoted(f)).alias(f) for f in features])
    long = agg.unpivot(list(keys), list(features), "variable", "mean_val")
    return long.withColumn("variable", _label_expr(F.col("variable"), label_map(features)))


def _with_feature_stats(long: DataFrame, feature: str, *aggs: Column) -> DataFrame:
    # One row per feature, and features are columns of the input: the table's size is
    # bounded by the schema, so broadcasting it is safe.  Partial aggregates, no window.
    stats = long.groupBy(feature).agg(*aggs)
    return long.join(F.broadcast(stats), feature)


def zscore_rows(long: DataFrame, feature: str = "variable", value: str = "mean_val", name: str = "scaled") -> DataFrame:
    """Per feature, (x - mean) / sd across samples, missing skipped; sd 0 gives NULL."""
    v = F.col(value)
    out = _with_feature_stats(long, feature, F.avg(v).alias("_mu"), F.stddev_samp(v).alias("_sd"))
    return out.withColumn(name, nan_to_null((v - F.col("_mu")) / F.nullif(F.col("_sd"), F.lit(0.0)))).drop("_mu", "_sd")


def rms_scale(long: DataFrame, feature: str = "variable", value: str = "mean_val", name: str = "scaled") -> DataFrame:
    """Per feature, x / sqrt(sum(x^2) / max(1, n - 1)), uncentred, missing skipped."""
    v = F.col(value)
    out = _with_feature_stats(long, feature, F.sum(v * v).alias("_ss"), F.count(v).alias("_n"))
    rms = F.sqrt(F.col("_ss") / F.greatest(F.lit(1), F.col("_n") - 1))
    return out.withColumn(name, nan_to_null(v / F.nullif(rms, F.lit(0.0)))).drop("_ss", "_n")


def heatmap(
    df: DataFrame,
    keys: Sequence[str],
    sample_keys: Sequence[str],
    scale: str | None = "z",
    features: Sequence[str] | None = None,
) -> DataFrame:
    """Feature x sample matrix in long form, with the sample key text and scaled values.

    ``sample_keys`` build the sample name as the reference's ``unite`` does
    (missing parts print "NA", doses print like R).  ``scale`` is "z" (W5),
    "rms" (W6) or None.  Annotation columns are the key columns themselves.
    """
    feats = list(features) if features is not None else select_features(df, keys)
    means = condition_means(df, keys, feats)
    means = means.withColumn("sample", key_concat("_", *sample_keys, schema=means.schema))
    if scale == "z":
        return zscore_rows(means)
    if scale == "rms":
        return rms_scale(means)
    return means.withColumn("scaled", F.col("mean_val"))


def feature_distance(matrix: DataFrame, labels: Sequence[str], value: str = "scaled") -> DataFrame:
    """Euclidean distance between feature rows over samples, as R's ``dist``.

    The matrix is pivoted to one row per sample and handed to
    :func:`column_distance`; the plan does not grow with the pairs.
    """
    labels = sorted(labels)
    wide = matrix.groupBy("sample").pivot("variable", labels).agg(F.first(value))
    return column_distance(wide, labels)


def _pair_partials(k: int):
    def partial(batches):
        s, n, rows = np.zeros((k, k)), np.zeros((k, k), np.int64), 0
        for pdf in batches:
            x = pdf.to_numpy(dtype=float)
            rows += len(x)
            for i in range(k - 1):
                d = x[:, i + 1:] - x[:, i:i + 1]  # differences first: close columns keep their digits
                there = ~np.isnan(d)
                s[i, i + 1:] += np.square(np.where(there, d, 0.0)).sum(axis=0)
                n[i, i + 1:] += there.sum(axis=0)
        i, j = np.triu_indices(k, 1)
        yield pd.DataFrame({"i": i, "j": j, "s": s[i, j], "n": n[i, j], "rows": rows})

    return partial


def column_distance(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    """T12 on a wide numeric matrix (one row per sample): Euclidean distance between columns.

    Pairs where a sample misses either value are skipped and the sum is scaled
    up by (samples / usable samples).  Each task adds up the squared differences
    of its rows for every pair of columns (Arrow batches, numpy) and emits one
    row per pair, bounded by the schema; one grouped sum over tasks finishes the
    job in a single pass over the data.
    """
    columns = sorted(columns)
    sel = wide.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    partials = sel.mapInPandas(_pair_partials(len(columns)), "i int, j int, s double, n long, rows long")
    sums = partials.groupBy("i", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("rows").alias("rows"))
    labels = F.array(*[F.lit(c) for c in columns])
    return sums.select(
        F.element_at(labels, F.col("i") + 1).alias("feature_a"),
        F.element_at(labels, F.col("j") + 1).alias("feature_b"),
        F.when(F.col("n") > 0, F.sqrt(F.try_divide(F.col("s") * F.col("rows"), F.col("n")))).alias("distance"),
        F.col("n").alias("n_samples"),
    )


GRID_POINTS = 512  # density grid size of the violin layer
GRID_CUT = 3.0     # grid extends this many bandwidths beyond the data (untrimmed violins)


# Accuracy of the quantile sketches, and how many times its rank error an interval spans.
SKETCH = 10_000
MARGIN = 10


def _sketch_points() -> list[float]:
    out = []
    for p in (0.25, 0.75):
        out += [p - MARGIN / SKETCH, p + MARGIN / SKETCH]
    return out


def group_quartiles(values: DataFrame, groups: Sequence[str], value: str = "value") -> DataFrame:
    """Exact first and third quartiles per group (linear interpolation, R type 7).

    A quantile sketch per group (partial aggregate, bounded memory) brackets each
    quartile by an interval of a few thousandths of the group's ranks; a second
    aggregate counts the values below it and the distinct values inside, and only
    those are put in order.  Neither sorts the values nor writes them.
    """
    groups = list(groups)
    vals = values.select(*groups, F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    return _bracketed_quartiles(vals, _bracket_stats(vals, groups), groups)


def _bracket_stats(vals: DataFrame, groups: Sequence[str], *more: Column) -> DataFrame:
    sketch = F.percentile_approx("_v", F.array(*[F.lit(p) for p in _sketch_points()]), F.lit(SKETCH)).alias("_sk")
    return vals.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), sketch, *more)


def _bracketed_quartiles(vals: DataFrame, stats: DataFrame, groups: Sequence[str]) -> DataFrame:
    # an interval of a small group, where the sketch holds every value, is its whole range
    ends = [F.when(F.col("_n") <= SKETCH, F.col("_min" if k % 2 == 0 else "_max")).otherwise(F.col("_sk")[k]) for k in range(4)]
    r = join_null_safe(vals, stats.select(*groups, *[e.alias(f"_e{k}") for k, e in enumerate(ends)]), groups)
    # below the first interval, inside the first, between, inside the second, above: one count per value only inside
    v = F.col("_v")
    near = (v >= F.col("_e0")) & (v <= F.col("_e1")) | (v >= F.col("_e2")) & (v <= F.col("_e3"))
    zone = F.when(v < F.col("_e0"), 0).when(v <= F.col("_e1"), 1).when(v < F.col("_e2"), 2).otherwise(3)
    counts = r.where(v <= F.greatest("_e1", "_e3")).groupBy(*groups, zone.alias("_z"), F.when(near, v).alias("_at")).agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(*groups).orderBy("_z", F.col("_at").asc_nulls_first())
    placed = counts.withColumn("_end", F.sum("_c").over(upto))
    sizes = stats.select(*groups, "_n")
    r = join_null_safe(placed, sizes, groups)
    picks = []
    for name, p in (("q1", 0.25), ("q3", 0.75)):
        h = (F.col("_n") - 1) * p
        for end, k in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            picks.append(F.max(F.when((F.col("_end") - F.col("_c") <= k) & (k < F.col("_end")), F.col("_at"))).alias(f"_{name}_{end}"))
        picks.append(F.max(h - F.floor(h)).alias(f"_{name}_f"))
    q = r.groupBy(*groups).agg(*picks)

    def between(name):
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        return (lo + F.col(f"_{name}_f") * (hi - lo)).alias(name)

    return q.select(*groups, between("q1"), between("q3"))


def feature_density(long: DataFrame, groups: Sequence[str], value: str = "value") -> DataFrame:
    """Gaussian kernel density per group on a 512-point grid, as an untrimmed violin draws it.

    Bandwidth is R's rule of thumb, 0.9 * min(sd, IQR/1.34) * n^-0.2 (sd when
    the IQR is 0, the largest |x| when both are 0, else 1); groups with fewer
    than two values are dropped.  The grid spans [min - 3bw, max + 3bw].  Data
    are linearly binned onto the grid (a partial aggregate, so hot groups cost
    nothing extra); the bins of a group, GRID_POINTS + 1 at most, are folded into
    one array and convolved with the kernel there.
    Output: groups..., grid index ``g``, ``x``, ``density`` and ``scaled``
    (density / the group's maximum).
    """
    groups = list(groups)
    vals = long.select(*groups, F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    stats = _bracket_stats(vals, groups, F.stddev_samp("_v").alias("_sd"), F.max(F.abs("_v")).alias("_amax")).where(F.col("_n") >= 2)
    stats = checkpointed(stats)  # one row per group, read by the quartiles and the grid
    st = join_null_safe(stats.drop("_sk"), _bracketed_quartiles(vals, stats, groups), groups)
    lo = F.least(F.col("_sd"), (F.col("q3") - F.col("q1")) / 1.34)
    lo = F.when(lo > 0, lo).when(F.col("_sd") > 0, F.col("_sd")).when(F.col("_amax") > 0, F.col("_amax")).otherwise(1.0)
    st = st.withColumn("_bw", 0.9 * lo * F.pow(F.col("_n").cast("double"), -0.2))
    st = st.withColumns({
        "_g0": F.col("_min") - GRID_CUT * F.col("_bw"),
        "_step": (F.col("_max") - F.col("_min") + 2 * GRID_CUT * F.col("_bw")) / (GRID_POINTS - 1),
    })
    # the kernel at every distance between grid points
    far = F.col("_step") / F.col("_bw")
    kernel = F.transform(F.sequence(F.lit(0), F.lit(GRID_POINTS)), lambda d: F.exp(-0.5 * d * d * far * far))
    # one row per group, read by the binning and the convolution
    st = checkpointed(st.select(*groups, "_n", "_bw", "_g0", "_step", kernel.alias("_kernel")))

    # Linear binning: each value splits its unit weight between its two neighbouring grid points.
    binned = join_null_safe(vals, st.drop("_kernel"), groups)
    pos = (F.col("_v") - F.col("_g0")) / F.col("_step")
    binned = binned.withColumns({"_b": F.floor(pos).cast("int"), "_f": pos - F.floor(pos)})
    per_bin = binned.groupBy(*groups, "_b").agg(F.sum(1 - F.col("_f")).alias("_w0"), F.sum("_f").alias("_w1"))
    halves = F.array(F.struct(F.col("_b").alias("b"), F.col("_w0").alias("w")), F.struct((F.col("_b") + 1).alias("b"), F.col("_w1").alias("w")))
    points = per_bin.select(*groups, F.explode(halves).alias("p")).groupBy(*groups, F.col("p.b").alias("b")).agg(F.sum("p.w").alias("w"))
    bins = points.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct("b", "w"))).alias("_bins"))
    grid = join_null_safe(bins, st, groups)

    def at(g: Column) -> Column:
        return F.aggregate("_bins", F.lit(0.0), lambda acc, p: acc + p["w"] * F.get("_kernel", F.abs(g - p["b"])))

    grid = grid.withColumn("_d", F.transform(F.sequence(F.lit(0), F.lit(GRID_POINTS - 1)), at))
    grid = grid.withColumn("_top", F.array_max("_d"))
    dens = grid.select(*groups, "_n", "_bw", "_g0", "_step", "_top", F.posexplode("_d").alias("g", "_k"))
    return dens.select(
        *groups, "g",
        (F.col("_g0") + F.col("g") * F.col("_step")).alias("x"),
        (F.col("_k") / math.sqrt(2 * math.pi) / (F.col("_n") * F.col("_bw"))).alias("density"),
        (F.col("_k") / F.col("_top")).alias("scaled"),
    )
