"""T12 between samples: the nearest samples of each sample, in tiles of the distance matrix.

Samples are rows, so no schema bounds their number and no pass may hold all
pairs.  The rows are put in order of their norm and cut into tiles; a pair of
tiles is one square of the distance matrix.  A tile first compares its own rows:
the k-th distance found there is how far a sample may still have to look.  Two
vectors lie at least as far apart as their norms differ, so a tile only meets
the tiles whose norms lie within that reach; all other squares are skipped.

No square is written anywhere: the tiles are a table, and a task that holds a
few of them reads the table once and keeps the k nearest of each of its rows.
The disk this takes grows with the rows, whatever the number of squares.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitaplate.functions.names import quoted
from vitaplate.functions.ranking import checkpointed

#: Rows of a tile; the last one of a task holds up to twice as many.
TILE = 2048
# Bytes of a tile of doubles: wide vectors make shorter tiles, of 64 rows at least.
TILE_BYTES = 1 << 20
# Relative slack of the bounds, for the rounding of norms and of products.
SLACK = 1e-9
# Rows of a tile compared at once, numbers of a block of differences, and the most rows of a tile.
STEP, BLOCK, TILE_ROWS = 256, 1 << 22, 8192
# How tile numbers are packed; tiles of a file of the table, and of a task that compares.
TASK_TILES, FILE_TILES, GROUP_TILES = 1 << 20, 8, 4


def _ids(cell: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a tile, and which of them are missing."""
    return cell.values.fill_null(0).to_numpy().copy(), cell.values.is_null().to_numpy(zero_copy_only=False)


def _none(rows: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distance, id, id is missing) of the nearest k of each row, none found yet."""
    return np.full((rows, k), np.inf), np.zeros((rows, k), np.int64), np.zeros((rows, k), bool)


def _keep(best: tuple[np.ndarray, np.ndarray, np.ndarray], i: np.ndarray, d: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
    """Put the finds at a finite distance among the nearest of their rows; ties by id, missing ids last."""
    real = np.isfinite(d)
    rows = np.unique(i[real])
    if not len(rows):
        return
    k = best[0].shape[1]
    i = np.concatenate([np.repeat(rows, k), i[real]])
    found = [np.concatenate([old[rows].ravel(), new[real]]) for old, new in zip(best, (d, ids, missing))]
    order = np.lexsort((found[1], found[2], found[0], i))
    first = np.searchsorted(i[order], rows)
    order = order[first[:, None] + np.arange(k)]
    for old, new in zip(best, found):
        old[rows] = new[order]


def _first(x: np.ndarray, ids: np.ndarray, missing: np.ndarray, k: int) -> np.ndarray:
    """The rows among the first k ids of their vector; no row of another tile needs more of equal vectors."""
    group = np.unique(x, axis=0, return_inverse=True)[1].ravel()
    order = np.lexsort((ids, missing, group))
    group = group[order]
    return np.sort(order[np.arange(len(x)) - np.searchsorted(group, group) < k])


def _tiles(k: int, tile: int, width: int, kind: str):
    """Rows in order of norm to tiles, with the distance to each row's k-th nearest in the tile."""

    def one(number: int, ids: list, x: np.ndarray) -> pa.RecordBatch:
        norms = np.sqrt(np.square(x).sum(axis=1))
        best = _none(len(x), k)
        _search(best, x, x, np.zeros(len(x), np.int64), np.zeros(len(x), bool), best[0][:, -1], True)
        bound = best[0][:, -1]
        ids = pa.array([ids], pa.list_(pa.int64()))
        first = _first(x, *_ids(ids[0]), k).astype("<i4")
        cells = [number], [float(norms.min())], [float(norms.max())], [float(bound.max())], ids, [bound.tobytes()], [x.astype(kind).tobytes()], [first.tobytes()]
        kinds = (pa.int64(), pa.float64(), pa.float64(), pa.float64(), None, pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([c if t is None else pa.array(c, t) for c, t in zip(cells, kinds)], names=["tile", "lo", "hi", "reach", "ids", "bounds", "flat", "first"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() * TASK_TILES
        ids, x = [], np.zeros((0, width))
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float)
            ids += batch.column(0).to_pylist()
            x = np.concatenate([x, flat.reshape(-1, width)])
            while len(x) >= 2 * tile:
                yield one(number, ids[:tile], x[:tile])
                number, ids, x = number + 1, ids[tile:], x[tile:]
        if len(x):
            yield one(number, ids, x)

    return run


_NEAR = T.StructType([
    T.StructField("sample", T.LongType()), T.StructField("rank", T.IntegerType()),
    T.StructField("neighbour", T.LongType()), T.StructField("distance", T.DoubleType()),
])


def _distances(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The distances of rows ``i`` of ``x`` and ``j`` of ``y``, from their differences."""
    some = max(1, BLOCK // max(1, x.shape[1]))
    out = np.zeros(len(i))
    with np.errstate(over="ignore", invalid="ignore"):
        for at in range(0, len(i), some):
            part = slice(at, at + some)
            out[part] = np.sqrt(np.square(x[i[part]] - y[j[part]]).sum(axis=1))
    return out


def _rough(x: np.ndarray, y: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(u, v, least): rows within ``limit`` have ``u @ v >= least``, in single precision and with room for its rounding.

    The rows are moved to the middle of ``x`` and scaled by a power of two, and half the square of
    a row of ``y`` is one more column.  None where numbers are too large or too small for that.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        middle = x.mean(axis=0)
        u, v = x - middle, y - middle
        uu, vv = np.square(u).sum(axis=1), np.square(v).sum(axis=1)
        size = uu + vv.max(initial=0.0)
        top = size.max(initial=0.0)
    if not 1e-200 < top < 1e200:
        return None
    scale = 2.0 ** -np.round(np.log2(top) / 2)
    width = x.shape[1]
    moved = 8 * np.finfo(float).eps * math.sqrt(width) * max(np.abs(x).max(), np.abs(y).max())
    room = 2 * (width + 9) * np.finfo(np.float32).eps * size * scale ** 2 + 1e-30
    with np.errstate(over="ignore"):
        most = np.square((limit * (1 + SLACK) + moved) * scale) * (1 + SLACK) + room
        least = np.nextafter(((uu * scale ** 2 - most) / 2).astype(np.float32), np.float32(-np.inf))
    u = np.hstack([u * scale, np.ones((len(u), 1))]).astype(np.float32)
    v = np.hstack([v * scale, -0.5 * scale ** 2 * vv[:, None]]).astype(np.float32)
    return u, v.T, least


def _fine(x: np.ndarray, y: np.ndarray, limit: np.ndarray, k: int, own: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the rows of ``y`` within ``limit`` of a row of ``x``, by products in double precision."""
    with np.errstate(over="ignore"):
        xx, yy = np.square(x).sum(axis=1), np.square(y).sum(axis=1)
        size = xx + yy.max(initial=0.0)
    if np.isfinite(size).all() and size.max(initial=0.0) < 1e300:
        room = 8 * (x.shape[1] + 8) * np.finfo(float).eps * size + 1e-300
        d2 = xx[:, None] + yy[None, :] - 2 * (x @ y.T)
    else:  # products overflow where differences may not
        room = np.zeros(len(x))
        i, j = np.divmod(np.arange(len(x) * len(y)), max(1, len(y)))
        with np.errstate(over="ignore"):
            d2 = np.square(_distances(x, y, i, j)).reshape(len(x), len(y))
    if own is not None:
        at = np.arange(len(x))
        d2[at, at + own] = np.inf
    with np.errstate(over="ignore"):
        most = np.square(limit) * (1 + SLACK) + room
    many = np.flatnonzero((d2 <= most[:, None]).sum(axis=1) > k)
    if len(many):
        most[many] = np.minimum(most[many], np.partition(d2[many], k - 1, axis=1)[:, k - 1] * (1 + SLACK) + 2 * room[many])
    return np.nonzero((d2 <= most[:, None]) & np.isfinite(d2))


def _near(x: np.ndarray, y: np.ndarray, limit: np.ndarray, k: int, own: int | None, rough: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance) of the rows of ``y`` within ``limit`` of a row of ``x``, the nearest k of each and ties at least.

    ``own`` is the place of ``x`` in ``y`` where they are one tile.  Squared distances from a matrix
    product, with room for its rounding, leave few pairs; those get their distance from the differences.
    A product in single precision comes first if ``rough`` holds its factors and bounds.
    """
    inside = None if rough is None else rough[0] @ rough[1] >= rough[2][:, None]
    if inside is None or np.count_nonzero(inside) > 8 * (k + 1) * len(x):
        i, j = _fine(x, y, limit, k, own)
    else:
        i, j = np.divmod(np.flatnonzero(inside), len(y))
        if own is not None:
            i, j = i[j != i + own], j[j != i + own]
    return i, j, _distances(x, y, i, j)


def _search(best: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray, y: np.ndarray, ids: np.ndarray, missing: np.ndarray, limit: np.ndarray, same: bool) -> None:
    """Put the rows of ``y``, with their ids, among the nearest of the rows of ``x``; ``same`` if they are one tile."""
    k = best[0].shape[1]
    rough = _rough(x, y, limit) if np.isfinite(limit).any() else None
    for at in range(0, len(x), STEP):
        part = slice(at, at + STEP)
        i, j, d = _near(x[part], y, limit[part], k, at if same else None, rough and (rough[0][part], rough[1], rough[2][part]))
        _keep(best, i + at, d, ids[j], missing[j])


def _compare(k: int, width: int, kind: str):
    """Pairs of tiles to the nearest k rows of each row of the first; all pairs of a tile must come to one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = {}
        for batch in batches:
            for r in range(batch.num_rows):
                a, a_ids, bounds, x, b, b_ids, y, first = (batch.column(c)[r] for c in range(8))
                a, b = a.as_py(), b.as_py()
                x, y = (np.frombuffer(v.as_buffer(), kind).reshape(-1, width).astype(float) for v in (x, y))
                if a not in tiles:
                    tiles[a] = _ids(a_ids), _none(len(x), k)
                best = tiles[a][1]
                limit = np.minimum(np.frombuffer(bounds.as_buffer()) * (1 + SLACK), best[0][:, -1])
                ids, missing = _ids(b_ids)
                if a != b:
                    first = np.frombuffer(first.as_buffer(), "<i4")
                    y, ids, missing = y[first], ids[first], missing[first]
                _search(best, x, y, ids, missing, limit, a == b)
        for (ids, no_id), (d, near, missing) in tiles.values():
            row, place = np.nonzero(np.isfinite(d))
            cells = (pa.array(ids[row], mask=no_id[row]), pa.array((place + 1).astype(np.int32)),
                     pa.array(near[row, place], mask=missing[row, place]), pa.array(d[row, place]))
            yield pa.RecordBatch.from_arrays(list(cells), names=_NEAR.names)

    return run


def tile_pairs(stats: DataFrame) -> DataFrame:
    """(a, b): for each tile, the tiles whose range of norms lies within its reach.

    ``stats`` has (tile, lo, hi, reach).  Tiles meet by an equality of buckets of
    norm that are as wide as the widest reach, so a tile looks into four of them;
    a tile without k other rows has no bound and looks into all.
    """
    finite = F.when(F.col("reach") < float("inf"), F.col("hi") - F.col("lo") + F.col("reach"))
    seen = stats.agg(F.max(finite).alias("wide"), F.max(F.col("hi") - F.col("lo")).alias("span"), F.min("lo").alias("least"), F.max("hi").alias("most")).first()
    if seen.least is None:
        return stats.select(F.col("tile").alias("a"), F.col("tile").alias("b"))
    wide = max(seen.wide or 0.0, seen.span, (seen.most - seen.least) / 1e6) or 1.0
    slack = F.lit(SLACK * max(seen.most, 1.0))
    bucket = lambda c: F.floor((c - F.lit(seen.least)) / F.lit(wide)).cast("long")
    last = int((seen.most - seen.least) / wide)
    low = F.greatest(F.lit(0), bucket(F.col("lo") - F.col("reach") - F.lit(wide) - slack))
    high = F.least(F.lit(last), bucket(F.col("hi") + F.col("reach") + slack))
    open_ = F.col("reach") == float("inf")
    asks = stats.select("*", F.explode(F.when(open_, F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))).otherwise(F.sequence(low, high))).alias("bucket"))
    held = stats.select(F.col("tile").alias("b"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"), bucket(F.col("lo")).alias("bucket"))
    near = (F.col("b_lo") <= F.col("hi") + F.col("reach") + slack) & (F.col("b_hi") >= F.col("lo") - F.col("reach") - slack)
    return asks.join(held, "bucket").where(near).select(F.col("tile").alias("a"), "b")


def sample_neighbours(samples: DataFrame, id_col: str, vector_col: str, k: int = 10, tile: int = TILE) -> DataFrame:
    """T12 between samples: (sample, rank, neighbour, distance), the ``k`` nearest by Euclidean distance.

    ``id_col`` is a whole number, ``vector_col`` an array of numbers.  Equal
    distances go by the neighbour's id, missing ids last.  Every row is a sample
    of its own, also where ids repeat, and never its own neighbour.  Rows whose
    vector is missing, shorter than the longest or holds a missing value are left
    out.  With fewer than ``k`` other samples, all are listed.
    """
    if not 0 < tile <= TILE_ROWS // 2:
        raise ValueError(f"tile must lie between 1 and {TILE_ROWS // 2}")
    single = isinstance(samples.select(quoted(vector_col)).schema[0].dataType.elementType, T.FloatType)
    vec = quoted(vector_col) if single else F.transform(quoted(vector_col), lambda v: v.cast("double"))
    rows = samples.select(quoted(id_col).cast("long").alias("id"), vec.alias("vec"))
    seen = rows.agg(F.max(F.size("vec")).alias("width"), F.count("*").alias("n")).first()
    width, kind = seen.width or 0, "<f4" if single else "<f8"
    tile = min(tile, max(64, TILE_BYTES // (8 * max(1, width))))
    whole = (F.size("vec") == width) & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v))
    rows = rows.where(F.col("vec").isNotNull() & whole)
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))))
    files = max(1, math.ceil(seen.n / (FILE_TILES * tile)))
    ordered = rows.repartitionByRange(files, "norm", "id").sortWithinPartitions("norm", "id").select("id", "vec")
    tiles = checkpointed(ordered.mapInArrow(_tiles(k, tile, width, kind), "tile long, lo double, hi double, reach double, ids array<long>, bounds binary, flat binary, first binary"))
    groups = max(1, math.ceil(seen.n / (GROUP_TILES * tile)))
    pairs = tile_pairs(tiles.select("tile", "lo", "hi", "reach")).repartition(groups, "a")
    meets = pairs.groupBy("a").agg(F.collect_list("b").alias("meets"))
    a = tiles.select(F.col("tile").alias("a"), "ids", "bounds", "flat").repartition(groups, "a").join(meets.hint("shuffle_hash"), "a")
    # One partition that every task reads through for its own tiles: all squares of a tile come to one task, and none is shuffled.
    b = tiles.select(F.col("tile").alias("b"), F.col("ids").alias("b_ids"), F.col("flat").alias("b_flat"), "first").coalesce(1)
    squares = b.join(a.hint("shuffle_replicate_nl"), F.array_contains("meets", F.col("b")))
    return squares.select("a", "ids", "bounds", "flat", "b", "b_ids", "b_flat", "first").mapInArrow(_compare(k, width, kind), _NEAR)
