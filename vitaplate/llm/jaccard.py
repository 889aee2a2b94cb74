"""N-gram Jaccard join by a token-group matrix.

Sets of word shingles link when their Jaccard similarity reaches a percentage (90
unless the caller names another).  Equal sets are one class from the start; the
join runs over classes.

0. Support.  A set links only when p percent of its shingles lie in sets of
   other classes.  Shingles are dealt to buckets by their hash, four bytes each; a bucket
   counts what each of its classes shares, the counts return to the slices that dealt them,
   and classes that share too little go no further.
1. Candidate groups.  If A and B link at p percent, at most
   (|A| + |B|) (100 - p) / (100 + p) shingles (a 19th at 90) lie in one of them
   only.  Each set is cut into more parts than that bound allows
   for its size level, by ranges of the shingles' hash, so linked sets agree in
   at least one whole part that is not empty.  Sets that agree in such a part (directly or along a
   chain) and lie on one size level form a group of similar sets.  No link is
   lost: linked sets are in one group, or in groups of adjacent size levels.
2. Token-group matrix.  Groups are split into blocks of bounded size; for each
   block the union of its shingles is its row of the matrix.  For a pair of
   blocks, a set of one block is compared with the other only when its overlap
   with that block's union reaches p percent of its own size, and a block is
   opened only when some set qualifies.
3. Opened blocks count all their intersections by matrix products and emit the
   links as a spanning forest, so no list of pairs is ever made.
4. Components of the links, by alternating star contraction (``graph``).

Shingles, parts and classes are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitaplate.llm import common as C
from vitaplate.llm.graph import components

#: Word bytes: everything but the space and 09-0D.
WORD = np.ones(256, bool)
WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
VALUES = C.lowered_table(WORD)
#: Words of a shingle, unless the caller names another number.
SHINGLE = 3
#: Links need 100 * intersection >= PERCENT * union, unless the caller names another percentage.
PERCENT = 90
#: Sets of a block, and shingles of all its sets, at most (on average; members are dealt by hash).
BLOCK_SETS = 64
BLOCK_SHINGLES = 400_000
#: Shingles of a bucket that a task counts at once (on average).
BUCKET_SHINGLES = 4_000_000
#: Shingles that a task deals to the buckets at once, from there on (one step of texts may add its own).
SLICE_SHINGLES = 1_000_000
#: Columns of one step of the intersection product.
PRODUCT_WIDTH = 4096
#: A class with more than this part of a task's rows is large: SHARES * tasks of them at most.
SHARES = 4
#: Bits of the prefilter for the second reading of the texts (2 MB, whatever the input).
FILTER_BITS = 24
#: Orders in which a set is cut into parts, at most.
TURNS = 8


def shingle_sets(step: C.TextStep, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than a shingle make one, no words make none."""
    words, first = C.word_hashes(step, WORD, VALUES)
    rolled = C.mix64(words)
    grams = rolled.copy()
    for k in range(1, shingle):
        grams = C.mix64(grams[: len(words) - k] + rolled[k:] * np.uint64(2 * k + 1)) if len(words) > k else grams[:0]
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= shingle:
            x = np.sort(grams[a : b - shingle + 1])
            keep = np.ones(len(x), bool)
            keep[1:] = x[1:] != x[:-1]
            out.append(x[keep])
        elif b > a:
            with np.errstate(over="ignore"):
                whole = rolled[a] + np.uint64(b - a)
                for w in rolled[a + 1 : b]:
                    whole = C.mix64(np.array([whole * np.uint64(5) + w]))[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


#: Level starts by percentage, and cuts by number of parts.
_LEVELS: dict[int, list[int]] = {}
_CUTS: dict[int, np.ndarray] = {}


def _level_start(k: int, percent: int) -> int:
    """Smallest size of level ``k``; a set links only within its level and the ones beside it."""
    starts = _LEVELS.setdefault(percent, [1])
    while len(starts) <= k:
        low = starts[-1]
        starts.append(max(low + 1, 100 * (low - 1) // percent + 1))
    return starts[k]


def size_level(n: int, percent: int = PERCENT) -> int:
    """The level of a set of n shingles (n >= 1)."""
    starts = _LEVELS.setdefault(percent, [1])
    while starts[-1] <= n:
        _level_start(len(starts), percent)
    return int(np.searchsorted(starts, n, "right")) - 1


#: Parts by level and percentage: (shingles that linked sets can differ in, number of parts).
_PARTS: dict[tuple[int, int], tuple[int, int]] = {}


def _parts(level: int, percent: int) -> tuple[int, int]:
    """The most shingles in which a set of ``level`` differs from a linked one of its level or the next, and the parts to cut.

    There are more parts than that, with so many to spare that even the level's smallest sets seldom
    leave enough of them empty to have no more than that with shingles.
    """
    if (level, percent) not in _PARTS:
        low = _level_start(level, percent)
        ends = _level_start(level + 1, percent) + _level_start(level + 2, percent) - 2
        most = ends * (100 - percent) // (100 + percent)
        m = most + 1
        while m < 2 * (most + 1):
            # mean and variance of the parts that are not empty when low shingles fall into m of them
            one, two = (1 - 1 / m) ** low, (1 - 2 / m) ** low if m > 1 else 0.0
            spread = max(0.0, m * (m - 1) * two + m * one - (m * one) ** 2) ** 0.5
            if m * (1 - one) - 2 * spread > most:
                break
            m += 1
        _PARTS[level, percent] = most, m
    return _PARTS[level, percent]


def signatures(shingles: np.ndarray, level: int, percent: int = PERCENT) -> np.ndarray:
    """Hashes of the set's parts, for its own level and the level below as the lower one of a pair.

    Empty parts say nothing and are left out.  Linked sets still share a part: a set with shingles in more
    parts than linked sets can differ in keeps one that the other has as well.  A set with fewer is cut anew
    in another order of its shingles, until it has more (or TURNS orders are used up; then the empty
    parts of the last count as well).  Of two linked sets the other has used every order that the first to stop has.
    """
    out = []
    for low in (level, level - 1):
        if low < 0:
            continue
        most, m = _parts(low, percent)
        if m not in _CUTS:
            _CUTS[m] = np.array([(k << 64) // m for k in range(1, m)], np.uint64)
        for turn in range(TURNS):
            ordered = shingles if not turn else np.sort(C.mix64(shingles + np.uint64(turn * 0x9E3779B97F4A7C15 % (1 << 64))))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(C.mix64(ordered))])
            at = np.concatenate([[0], np.searchsorted(ordered, _CUTS[m]), [len(ordered)]])
            salt = np.arange(m, dtype=np.uint64) + np.uint64((low << 32) + (turn << 56))
            signs = C.mix64(sums[at[1:]] - sums[at[:-1]] + C.mix64(salt))
            filled = at[1:] > at[:-1]
            enough = int(filled.sum()) > most
            out.append(signs[filled] if enough or turn < TURNS - 1 else signs)
            if enough:
                break
    return np.concatenate(out)


def _class_key(shingles: np.ndarray) -> int:
    """One 64-bit key for equal sets."""
    return int(C.mix64(np.array([C.mix64(shingles).sum() + np.uint64(len(shingles))]))[0].astype(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


_SETS = [T.StructField("n", T.LongType()), T.StructField("key", T.LongType()), T.StructField("level", T.IntegerType())]


def _describe(step: C.TextStep, shingle: int, percent: int) -> list[pa.Array]:
    sets = shingle_sets(step, shingle)
    return [
        pa.array([len(s) for s in sets], pa.int64()),
        pa.array([_class_key(s) if len(s) else None for s in sets], pa.int64()),
        pa.array([size_level(len(s), percent) if len(s) else None for s in sets], pa.int32()),
    ]


def _buckets(slice_id: int, keys: list[int], sets: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """One row for each bucket with shingles of ``sets``: the classes, how many shingles each has there, and the shingles' low halves."""
    lengths = np.array(list(map(len, sets)))
    flat = np.concatenate(sets)
    bucket = ((flat >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    # runs of one bucket and class, by bucket
    run = bucket.astype(np.int64) * len(sets) + np.repeat(np.arange(len(sets)), lengths)
    order = np.argsort(run, kind="stable")
    run = run[order]
    begin = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    runs, counts = run[begin], np.diff(np.append(begin, len(run)))
    found, first = np.unique(runs // len(sets), return_index=True)
    cuts = np.append(first, len(runs))
    ends = np.append(begin, len(run))[cuts]
    low = flat[order].astype(np.uint32).view(np.int32)
    columns = [
        pa.array(np.full(len(found), slice_id)),
        pa.array(found.astype(np.int32)),
        _cut(cuts, np.array(keys, np.int64)[runs % len(sets)]),
        _cut(cuts, counts.astype(np.int32)),
        _cut(ends, low),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["slice", "bucket", "keys", "counts", "low"])


def _cut(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def _flat(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _shared(rows: pa.Table) -> pa.Table:
    """(slice, keys, shared) of one bucket, a row for each one dealt to it: how many shingles of each class another class has, where there are any."""
    keys, low = _flat(rows, "keys"), _flat(rows, "low")
    owner = np.repeat(np.arange(len(keys), dtype=np.int32), _flat(rows, "counts"))
    order = np.argsort(low, kind="stable")
    low, owner = low[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    of = keys[owner]
    several = np.minimum.reduceat(of, first) != np.maximum.reduceat(of, first)
    shared = np.bincount(owner[np.repeat(several, np.diff(np.append(first, len(low))))], minlength=len(keys))
    some = shared > 0
    ends = np.cumsum([0, *pc.list_value_length(rows.column("keys")).to_pylist()])
    cuts = np.concatenate([[0], np.cumsum(some)])[ends]
    return pa.table({"slice": rows.column("slice"), "keys": _cut(cuts, keys[some]), "shared": _cut(cuts, shared[some].astype(np.int32))})


def _totals(rows: pa.Table) -> pa.Table:
    """(key, shared) of one slice: the sums over all buckets."""
    keys, at = np.unique(_flat(rows, "keys"), return_inverse=True)
    return pa.table({"key": pa.array(keys), "shared": pa.array(np.bincount(at, _flat(rows, "shared"), len(keys)).astype(np.int64))})


def _supported(texts: DataFrame, classes: DataFrame, shingles: int, shingle: int, percent: int) -> DataFrame:
    """(key, level, n) of the classes that share ``percent`` percent of their shingles at least with others; ``shingles`` is the sum of all rows.

    Two shingles with equal halves of their hash count as shared, so a class may stay for nothing but none is lost.
    The buckets' counts go back by slice, the classes that a task dealt together: a class is all in one slice, so a row
    is made for each class of a slice, not for each class of a bucket (there are more buckets the larger the input).
    """
    buckets = shingles // BUCKET_SHINGLES + 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slice_id = TaskContext.get().partitionId() << 32
        once, waiting = {}, 0
        for batch in batches:
            for part in C.slices(batch, 0):
                for s in shingle_sets(C.TextStep(part.column(0)), shingle):
                    if len(s) and (key := _class_key(s)) not in once:
                        once[key] = s
                        waiting += len(s)
                if waiting >= SLICE_SHINGLES:
                    yield _buckets(slice_id, list(once), list(once.values()), buckets)
                    slice_id += 1
                    once, waiting = {}, 0
        if once:
            yield _buckets(slice_id, list(once), list(once.values()), buckets)

    dealt = texts.select("text").mapInArrow(deal, "slice long, bucket int, keys array<long>, counts array<int>, low array<int>")
    shared = dealt.groupBy("bucket").applyInArrow(_shared, "slice long, keys array<long>, shared array<int>")
    totals = shared.groupBy("slice").applyInArrow(_totals, "key long, shared long")
    # copies of a class have the same total in every slice
    enough = totals.groupBy("key").agg(F.max("shared").alias("shared"))
    return classes.join(enough, "key").where(F.col("shared") * 100 >= F.col("n") * percent).select("key", "level", "n")


def _with_parts(held: DataFrame, percent: int) -> DataFrame:
    """``held`` (key, shingles, level, n) with the signatures of each set."""
    schema = T.StructType([*held.schema.fields, T.StructField("parts", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.values.to_numpy().view(np.uint64) for s in batch.column("shingles")]
            parts = [signatures(s, level, percent) for s, level in zip(sets, batch.column("level").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(parts)], names=schema.names)

    return held.mapInArrow(run, schema)


def _forest(keys: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges from each row to the least key of its component."""
    label = np.argsort(np.argsort(keys, kind="stable"), kind="stable")
    big = len(keys)
    np.fill_diagonal(linked, True)
    while True:
        new = np.where(linked, label[None, :], big).min(axis=1)
        if (new == label).all():
            break
        label = new
    ordered = np.sort(keys, kind="stable")
    return [(int(k), int(ordered[x])) for k, x in zip(keys, label, strict=True) if k != ordered[x]]


def _links(keys: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between two blocks (side 0 and 1), or within one (side 0 only), as a spanning forest."""
    order = np.argsort(keys, kind="stable")
    keys, sets, side = keys[order], [sets[i] for i in order], side[order]
    n = np.array(list(map(len, sets)))
    row = np.repeat(np.arange(len(sets)), n)
    tokens, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    within = not side.any()
    if not within:
        # the matrix rows: which shingles each block's union holds, and how far each set overlaps the other's
        held = np.zeros((2, len(tokens)), bool)
        held[side[row], column] = True
        overlap = np.bincount(row, held[1 - side[row], column], len(sets))
        open_ = 100 * overlap >= percent * n
        if not (open_ & (side == 0)).any() or not (open_ & (side == 1)).any():
            return []
    else:
        open_ = np.ones(len(sets), bool)
    place = np.cumsum(open_) - 1
    use = open_[row] & (often[column] > 1)
    row, column = place[row[use]], column[use]
    _, column = np.unique(column, return_inverse=True)
    keys, n, side = keys[open_], n[open_], side[open_]
    both = np.zeros((len(keys), len(keys)), np.int64)
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    width = int(column[-1]) + 1 if len(column) else 0
    for a in range(0, width, PRODUCT_WIDTH):
        i, j = np.searchsorted(column, [a, a + PRODUCT_WIDTH])
        m = np.zeros((len(keys), PRODUCT_WIDTH), np.float32)
        m[row[i:j], column[i:j] - a] = 1
        both += np.rint(m @ m.T).astype(np.int64)
    linked = 100 * both >= percent * (n[:, None] + n[None, :] - both)
    if not within:
        linked &= side[:, None] != side[None, :]
    return _forest(keys, linked)


def _open_blocks(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    sets = [np.asarray(s, np.int64).view(np.uint64) for s in pdf["shingles"]]
    edges = _links(pdf["key"].to_numpy(), sets, pdf["side"].to_numpy(), percent)
    return pd.DataFrame(edges, columns=["u", "v"], dtype="int64")


def _bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """A bit for each value of the low FILTER_BITS of ``column`` that occurs: 2 MB at most on the driver."""
    low = F.col(column).bitwiseAND((1 << FILTER_BITS) - 1)
    words = keys.groupBy(F.shiftright(low, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({column} & 63L as int))")).alias("b"))
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for w, b in words.toLocalIterator():
        out[w] = b
    return out.view(np.uint64)


def _active_sets(texts: DataFrame, text_col: str, active: DataFrame, shingle: int) -> DataFrame:
    """(key, shingles) of the classes in ``active``, each once, from a second reading of the texts.

    A bitmap of fixed size drops most other texts inside the reading task; the
    join then settles membership exactly.
    """
    bits = texts.sparkSession.sparkContext.broadcast(_bitmap(active, "key"))
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: set[int] = set()  # copies often stand together: what this task sent already
        for batch in batches:
            for part in C.slices(batch, 0):
                keys, sets = [], []
                for s in shingle_sets(C.TextStep(part.column(0)), shingle):
                    if not len(s):
                        continue
                    key = _class_key(s)
                    low = key & ((1 << FILTER_BITS) - 1)
                    if (int(bits.value[low >> 6]) >> (low & 63)) & 1 and key not in last:
                        if len(last) > 100_000:
                            last.clear()
                        last.add(key)
                        keys.append(key)
                        sets.append(s)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), _lists(sets)], names=schema.names)

    sent = texts.select(text_col).mapInArrow(run, schema)
    once = sent.groupBy("key").agg(F.min("shingles").alias("shingles"))
    return once.join(active, "key")


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, block_sets: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    Sets of ``shingle`` words link from ``percent`` percent of their union on.
    Blocks hold about ``block_sets`` sets (BLOCK_SETS); a group of N sends N^2 / block_sets copies of sets at most.

    ``component_id`` is the smallest id that links reach, itself included.
    Texts without words (null, empty, white space) are linked with nothing and
    are their own component.  Rows of equal text, repeated ids and null ids are
    rows of their own; null ids do not count as smallest unless a component has
    no other.  An empty table gives no rows.  Other columns are left out.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sets = C.materialise(C.add_columns(texts, _SETS, "text", lambda step: _describe(step, shingle, percent)).drop("text"), "sets")

    # classes are formed before any join, so that copies never meet in one task
    worded = sets.where("key is not null")
    each_class = worded.groupBy("key").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"), F.max("level").alias("level"), F.max("n").alias("n"))
    classes = C.materialise(each_class, "classes")
    shingles = worded.agg(F.sum("n")).first()[0] or 0
    able = C.materialise(_supported(texts, classes.select("key", "level", "n"), shingles, shingle, percent), "supported")
    held = C.materialise(_with_parts(_active_sets(texts, "text", able, shingle), percent), "held-sets")

    # parts that two classes share: each such class is tied to the least class of the part
    parts = held.select("key", F.explode("parts").alias("part"))
    shared = parts.groupBy("part").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least <> most").select("part", "least")
    shared = C.materialise(shared, "shared-parts")
    ties = parts.join(shared, "part").where("key <> least").select(F.col("key").alias("u"), F.col("least").alias("v"))
    groups = C.materialise(components(ties), "groups")

    # blocks of each group and size level, dealt by hash; their number follows the group's size
    active = C.materialise(able.join(groups, F.col("key") == F.col("node")).select("key", "level", "n", F.col("root").alias("g")), "active")
    count = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(block_sets or BLOCK_SETS)), F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("int")
    sizes = C.materialise(active.groupBy("g", "level").agg(count.alias("blocks"), F.count(F.lit(1)).alias("members")), "block-counts")
    above = sizes.select("g", (F.col("level") - 1).alias("level"), F.col("blocks").alias("next_blocks"), F.col("members").alias("next_members"))
    below = sizes.select("g", (F.col("level") + 1).alias("level"), F.col("blocks").alias("last_blocks"))
    around = sizes.join(above, ["g", "level"], "left").join(below, ["g", "level"], "left").na.fill(0)

    # a member goes to every pair of blocks that its own is in: with each block of its level, and of those beside it
    block = F.pmod(F.xxhash64("key", F.lit(7)), F.col("blocks")).cast("int")
    member = held.select("key", "shingles").join(active, "key").join(around, ["g", "level"]).withColumn("block", block)
    own, none = F.col("block"), F.array().cast("array<struct<lower:int,a:int,b:int,side:int>>")

    def pair(lower, a, b, side):
        return F.struct(lower.cast("int").alias("lower"), a.cast("int").alias("a"), b.cast("int").alias("b"), F.lit(side).alias("side"))

    def each(n, make):
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), make)).otherwise(none)

    minus = F.lit(-1)
    same = each(F.col("blocks"), lambda k: F.when(k == own, pair(F.col("level"), own, minus, 0)).when(own < k, pair(F.col("level") + 100_000, own, k, 0)).otherwise(pair(F.col("level") + 100_000, k, own, 1)))
    up = each(F.col("next_blocks"), lambda k: pair(F.col("level") + 200_000, own, k, 0))
    down = each(F.col("last_blocks"), lambda k: pair(F.col("level") + 199_999, k, own, 1))
    alone = (F.col("members") == 1) & (F.col("next_blocks") == 0) & (F.col("last_blocks") == 0)
    pairs = member.where(~alone).select("key", "shingles", "g", F.explode(F.concat(same, up, down)).alias("p")).select("key", "shingles", "g", "p.*")
    edges = pairs.groupBy("g", "lower", "a", "b").applyInPandas(lambda pdf: _open_blocks(pdf, percent), "u long, v long")
    found = components(edges)

    # the least id of each class, then of each component
    named = classes.join(found, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "key"))
    named = C.materialise(named.select("key", "root", "class_id", "copies"), "named-classes")
    least = named.groupBy("root").agg(F.min("class_id").alias("component_id"))
    roots = C.materialise(named.join(least, "root").select("key", "component_id", "copies"), "roots")

    # rows of large classes meet their component by broadcast, not in one task: at most
    # SHARES classes a task can hold more than a task's SHARES-th part of all rows
    tasks = C.parallelism(docs.sparkSession)
    large = F.col("copies") * (SHARES * tasks) > sets.count()
    hot = F.broadcast(roots.where(large).drop("copies"))
    rows = worded.select("doc_id", F.col("n").alias("n_shingles"), "key")
    of_large = rows.join(hot, "key")
    of_others = rows.join(hot.select("key"), "key", "left_anti").join(roots.where(~large).drop("copies"), "key")
    wordless = sets.where("key is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return of_large.union(of_others.select(of_large.columns)).select("doc_id", "n_shingles", "component_id").union(wordless)


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, block_sets: int | None = None) -> DataFrame:
    """``docs`` with one document of each component: the one whose id names it.

    Rows without words all stay, and so do rows that repeat the id that stays.
    A row without an id stays only where its component has none with one; it
    goes by a hash of its text, so equal texts without ids all stay or all go.
    """
    by_text = F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseOR(F.lit(1 << 62)).bitwiseAND(F.lit((1 << 63) - 1))
    name = F.coalesce(F.col("doc_id").cast("long"), by_text)
    classes = jaccard_classes(docs.select(name.alias("doc_id"), "text"), shingle=shingle, percent=percent, block_sets=block_sets)
    stay = classes.where("doc_id = component_id").select(F.col("doc_id").alias("_stay")).distinct()
    return docs.join(stay, name == F.col("_stay"), "left_semi")


def brute_force(docs: list[tuple], shingle: int = SHINGLE, percent: int = PERCENT) -> list[tuple]:
    """The contract read literally, for tests: (doc_id, n_shingles, component_id)."""
    import re

    lower = {c: c + 32 for c in range(65, 91)}
    sets = []
    for _, text in docs:
        w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(lower))
        sets.append({tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [(doc_id, len(s), least[find(i)]) for i, ((doc_id, _), s) in enumerate(zip(docs, sets, strict=True))]
